"""Language-model scoring (10): tables grow with the corpus and equal plain Kneser-Ney."""

import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from llm_fixtures import ODD_ROWS, words

from tessera.llm import lm_scoring, queries, spill, wordlm
from tessera.llm.textvec import Words, text_bytes

HISTORIES = 20


def word_hash(word):
    return int(Words(*text_bytes(pa.array([word]))).hash.view("int64")[0])


def frequent_words(texts, k):
    counts = Counter(w for t in texts for w in words(t))
    least = sorted(counts.values())[-k]
    return {"=" + w for w, _ in sorted(((w, n) for w, n in counts.items() if n >= least), key=lambda x: (-x[1], word_hash(x[0])))[:k]}


def plain(texts, vocabulary, frequent):
    """Interpolated modified Kneser-Ney over pairs of history and word with dictionaries."""
    pairs = Counter(p for t in texts for p in named(t, frequent))
    before = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.01), k + 1) for k in range(3)]

    d2, d1 = discounts(pairs), discounts(before)
    total, back = defaultdict(int), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        back[v] += d2[min(c, 3)]
    spare = sum(d1[min(c, 3)] for c in before.values()) / vocabulary

    def log_prob(v, w):
        c = before.get(w, 0)
        p = (c - d1[min(c, 3)] + spare) / len(pairs)
        c = pairs.get((v, w), 0)
        return math.log((c - d2[min(c, 3)] + back[v] * p) / total[v] if v in total else p)

    return log_prob


def named(text, frequent):
    w = words(text)
    return list(zip(["start", *("=" + x if "=" + x in frequent else "other" for x in w)], w))


@pytest.mark.parametrize("head", [0, 500])
def test_scores_equal_plain_models(spark, corpus, sf_dir, head):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r.text for r in corpus.collect()}
    wanted = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    size, frequent = len({w for t in rows.values() for w in words(t)}) + 1, frequent_words(rows.values(), HISTORIES)
    background, target = plain(rows.values(), size, frequent), plain([t for d, t in rows.items() if d in wanted], size, frequent)
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(corpus, lm_scoring.target_ids(labels), n_histories=HISTORIES, head_limit=head).collect()}
    assert len(got) == len(rows)
    for d, text in rows.items():
        pairs = named(text, frequent)
        b, t = (-sum(m(*p) for p in pairs) / max(len(pairs), 1) for m in (background, target))
        assert got[d].n_tokens == len(pairs)
        assert got[d].background_loss == pytest.approx(b, abs=1e-4)
        assert got[d].score == pytest.approx(t - b, abs=1e-4)


def test_all_pairs_are_kept(corpus):
    texts = [r.text for r in corpus.collect()]
    known = wordlm.frequent_words(wordlm.word_counts(corpus), HISTORIES)
    frequent = frequent_words(texts, HISTORIES)
    pairs = Counter(p for t in texts for p in named(t, frequent))
    got = wordlm.pair_counts(corpus, known)
    assert sorted(r.n0 for r in got.collect()) == sorted(pairs.values())


def test_registered_scores_are_of_words(spark):
    """Held-out good documents score lower than bad ones; tokens are words."""
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, folder).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(got[d].n_tokens == len(words(t)) for d, t in text.items())
    out = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95, auc


def test_scores_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (8, 1, 0), (2, 1, None), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = lm_scoring.cross_entropy_difference(odd_documents, lm_scoring.target_ids(labels)).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r.score for r in rows if r.doc_id in (2, 3, 4)} == {0.0}
    assert all(math.isfinite(r.score) for r in rows)
    assert len(lm_scoring.cross_entropy_difference(odd_documents, lm_scoring.target_ids(labels.limit(0))).collect()) == len(ODD_ROWS)
    assert lm_scoring.cross_entropy_difference(no_documents, lm_scoring.target_ids(labels)).count() == 0


def test_every_word_is_a_history(spark, corpus, sf_dir):
    """By default no history stands for several words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r.text for r in corpus.collect()}
    wanted = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    every = {w for t in rows.values() for w in words(t)}
    assert len(every) > 1000
    named_ = {"=" + w for w in every}
    background, target = plain(rows.values(), len(every) + 1, named_), plain([t for d, t in rows.items() if d in wanted], len(every) + 1, named_)
    for r in lm_scoring.cross_entropy_difference(corpus, lm_scoring.target_ids(labels), head_limit=500).collect():
        pairs = named(rows[r.doc_id], named_)
        b, t = (-sum(m(*p) for p in pairs) / max(len(pairs), 1) for m in (background, target))
        assert r.background_loss == pytest.approx(b, abs=1e-4)
        assert r.score == pytest.approx(t - b, abs=1e-4)


def test_pairs_that_stand_once_take_no_room(spark, corpus, sf_dir, tmp_path, monkeypatch):
    """Only pairs of several occurrences have a row, and neither their counts nor totals stay on disk."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    pairs = Counter(p for t in (r.text for r in corpus.collect()) for p in named(t, {"=" + w for w in words(t)}))
    models = []
    monkeypatch.setattr(spill, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(lm_scoring, "text_log_probs", lambda docs, model, *args, **knobs: models.append(model) or wordlm.text_log_probs(docs, model, *args, **knobs))
    got = lm_scoring.cross_entropy_difference(corpus, lm_scoring.target_ids(labels)).collect()
    assert len(got) == corpus.count()
    assert models[0].count() == sum(n > 1 for n in pairs.values()) < len(pairs) / 2
    assert {f.name.rpartition("-")[0] for f in tmp_path.iterdir() if "-" in f.name} == {"target-ids", "pair-model", "text-sums"}


def test_parts_change_no_score(spark, corpus, sf_dir, monkeypatch):
    """Neither where pairs are dealt to nor in how many parts texts are scored shows in the result."""
    target = lm_scoring.target_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = corpus.where("doc_id % 5 = 0")
    one = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(texts, target, head_limit=500).collect()}
    monkeypatch.setattr(wordlm, "HOT_SHARE", 1)
    monkeypatch.setattr(wordlm, "WHOLE_MODEL", 0)
    rows = lm_scoring.cross_entropy_difference(texts, target, head_limit=500).collect()
    assert len(rows) == len(one)
    for r in rows:
        assert r.n_tokens == one[r.doc_id].n_tokens
        assert (r.background_loss, r.score) == pytest.approx((one[r.doc_id].background_loss, one[r.doc_id].score), abs=1e-5)

"""Toxicity (2): held-out accuracy, and what the labels may not reach."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from llm_fixtures import ODD_ROWS, prose
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.textvec import text_bytes

FOLDER = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    """With some 350 toxic training rows in four languages; with 1,500 the ranking is above 0.999."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    test = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if held_out(r.doc_id)]
    toxic, clean = [s for s, t in test if t == 1], [s for s, t in test if t == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) > 0.97 * len(toxic) * len(clean)
    assert np.mean([s >= 0.5 for s in toxic]) > 0.75
    assert np.mean([s >= 0.5 for s in clean]) < 0.02


def test_held_out_labels_change_nothing(spark, corpus, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity_scores(corpus, x).collect()} for x in (labels, flipped))
    assert a == b


def test_unseen_misspellings_lean_the_same_way():
    clean = [prose(i, 60) for i in range(60)]
    toxic = [prose(100 + i, 25) + " blockheaded fool " + prose(200 + i, 25) for i in range(60)]
    label = np.array([0] * 60 + [1] * 60)
    model = toxicity.SubwordClassifier().fit(toxicity.text_bags(clean + toxic), label)
    sums = toxicity.WordSums(model.scalars())
    new = [prose(300, 25) + f" {w} " + prose(301, 25) for w in ("blockheaded", "blokheaded", "blockheadedd", "harmless")]
    odds = sums.log_odds(*text_bytes(pa.array(new)), model.offset())
    assert odds[0] > 0 and odds[2] > 0 and odds[3] < 0
    assert odds[1] > odds[3] / 2  # a letter less: most of the way from harmless to toxic
    alone = [float(toxicity.WordSums(model.scalars()).log_odds(*text_bytes(pa.array([t])), model.offset())[0]) for t in new]
    assert np.allclose(alone, odds)  # what a slice holds besides does not matter


def mixed(x):
    """The splitmix64 finaliser."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def word_hash(word):
    total = 0
    for k in range(max(1, -(-len(word) // 8))):
        total += mixed(int.from_bytes(word[8 * k : 8 * k + 8], "little") ^ mixed(k + 1))
    return mixed((total + len(word) * 0xD6E8FEB86659FD93) % 2**64)


def brute_log_odds(text, scalar, bias):
    """The score of one text as the module describes it, a word at a time, from the trained table."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", lower)
    if not words:
        return bias
    grams = lambda w: [g[i : i + n] for g in (b" " + w + b" ",) for n in (3, 4, 5) for i in range(len(g) - n + 1)]
    bucket = lambda x: x >> 64 - toxicity.BUCKET_BITS
    adds = lambda w: scalar[bucket(word_hash(w))] + sum(scalar[bucket(mixed((int.from_bytes(g, "big") + len(g) * 0x9E3779B97F4A7C15) % 2**64))] for g in grams(w))
    step = math.ceil(len(words) / math.ceil(len(words) / 5))
    means = []
    for lo in range(0, len(words), step):
        passage = words[lo : lo + step]
        means.append(math.fsum(map(adds, set(passage))) / max(20, sum(1 + len(grams(w)) for w in passage)))
    top = sorted(means, reverse=True)[:3]
    return bias + math.fsum(top) / len(top)


def test_scores_equal_brute_force():
    """Every text's log odds, from a trained table, against plain Python."""
    texts = [prose(i, n) for i, n in enumerate((1, 2, 4, 5, 6, 11, 16, 21, 300))] + [t or "" for _, t, *_ in ODD_ROWS if t is None or len(t) < 30_000]
    texts += ["", " \t\n", "a", "Fool fool FOOL fool fool", "é" * 40 + " x", "<|endoftext|>", "antidisestablishmentarianism " * 7]
    label = np.array([0, 1] * 30)
    model = toxicity.SubwordClassifier().fit(toxicity.text_bags([prose(i, 30) + " fool" * (i % 2) for i in range(60)]), label)
    scalar = model.scalars()
    got = toxicity.WordSums(scalar).log_odds(*text_bytes(pa.array(texts)), model.offset())
    wanted = [brute_log_odds(t, scalar.astype(float), model.offset()) for t in texts]
    assert len(set(wanted)) > 10 and np.allclose(got, wanted, atol=1e-5)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(odd_documents, labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert {r.score for r in toxicity.toxicity_scores(odd_documents, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(no_documents, labels).count() == 0


def test_training_rows_are_whole_texts_in_drawn_order(spark):
    """Long texts are drawn like short ones; the sum of characters and the number of texts bound a class."""
    ids = [i for i in range(200) if not held_out(i)]
    rows = [(i, prose(i, 3 + 20_000 * (i % 40 == 1))) for i in ids] + [(ids[0], "z"), (ids[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(ids[0], 1 - ids[0] % 2)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels).collect()
    assert sorted(r.doc_id for r in every) == ids and {r.doc_id: r.text for r in every} == {i: min(t for d, t in rows if d == i and t) for i in ids}
    assert {r.doc_id: r.toxic for r in every} == {i: 1 if i == ids[0] else i % 2 for i in ids}
    for chars in (50, 150_000):
        some = toxicity.training_rows(docs, labels, chars=chars).collect()
        for k in (0, 1):
            wanted, total = [], 0
            for r in sorted((r for r in every if r.toxic == k), key=lambda r: (r.draw, r.doc_id)):
                if total < chars:
                    wanted.append(r.doc_id)
                total += len(r.text)
            assert sorted(r.doc_id for r in some if r.toxic == k) == sorted(wanted)
    assert len(toxicity.training_rows(docs, labels, sample=10).collect()) <= 20

import zlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import lowered
from pyspark.sql import functions as F

from tessera.llm import queries, spelling


def edits_apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between the words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts):
    """{word: (form, root, n, n_near, form_n)} by comparing all words with all."""
    near = {w: [v for v in counts if edits_apart(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def variants(spark, counts, repeat=True):
    rows = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n int").selectExpr("word", "explode(sequence(1, n)) AS i").select("word")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(rows).collect()}


def test_variants_equal_sql(same):
    assert len(same(queries.op11_spelling_variants, queries.OP11_SQL)) > 1000


def test_variants_equal_brute_force(spark):
    base = ["aabbb", "aaabbb", "ababa", "hello", "hallo", "hullo", "helloo", "heello", "hellö", "jello", "jelloo", "zzzzz", "zzzzzz", "zzzzzzz", "yzzzz", "single", "x" * 90, "x" * 91, "x" * 45 + "y" + "x" * 45, "ab" * 40, "ab" * 39 + "aa"]
    counts = {w: 3 + (i * 7) % 40 for i, w in enumerate(base)}
    for w in "abcdefghijklmnopqrstuvwxyzàé÷ÿ":  # one gap of the whole alphabet
        counts["pla" + w + "nt"] = 3 if w != "q" else 50
    assert variants(spark, counts) == brute_force(counts)


def test_ties_go_to_the_first_word_and_chains_to_their_end(spark):
    counts = {"abcde": 3, "abcdf": 10, "abcdg": 10, "abcfg": 30, "axcfg": 100, "axcfgh": 300}
    out = variants(spark, counts)
    assert out == brute_force(counts)
    assert out["abcde"][:2] == ("abcdf", "abcdf")
    assert out["abcdg"][1] == "axcfgh"


def test_slips_follow_the_hash(spark, corpus):
    rows = corpus.select("doc_id", "text").limit(40).collect()
    wanted = Counter()
    for r in rows:
        run = ""
        for c in lowered(r.text) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{r.doc_id}:{run}".encode())
                at = h % len(run)
                wanted[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r["count"] for r in spelling.slipped_words(docs, 97).groupBy("word").count().collect()} == wanted


def test_each_pair_meets_once(spark):
    vocabulary = spark.createDataFrame([(0, "aaaa", 5), (1, "aaaaa", 9), (2, "aaaab", 2)], "id long, word string, n long")
    keys = defaultdict(list)
    for r in spelling.rotations(vocabulary).collect():
        keys[r.key].append((r.id, r.whole, r.first))
    meetings = [1 for k in keys.values() for a in k for b in k if a[:2] == (0, True) and b[0] == 1 and not b[1] and b[2]]
    assert sum(meetings) == 1
    assert {r.id: r.n_near for r in spelling.near_words(vocabulary).collect()} == {0: 2, 1: 2, 2: 2}


def test_odd_rows(odd_documents, no_documents):
    found = spelling.spelling_variants(spelling.slipped_words(odd_documents, 97), least_count=2)
    counts = {r.word: r["count"] for r in spelling.slipped_words(odd_documents, 97).groupBy("word").count().collect() if len(r.word) >= 5 and r["count"] >= 2}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == brute_force(counts)
    assert spelling.spelling_variants(spelling.slipped_words(no_documents, 97)).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_result_is_the_same_in_any_layout(corpus, partitions):
    words = spelling.slipped_words(corpus.repartition(partitions), 97)
    state = spelling.spelling_variants(words).agg(F.bit_xor(F.xxhash64("word", "form", "root", "n", "n_near", "form_n"))).first()[0]
    again = spelling.spelling_variants(spelling.slipped_words(corpus, 97)).agg(F.bit_xor(F.xxhash64("word", "form", "root", "n", "n_near", "form_n"))).first()[0]
    assert state == again

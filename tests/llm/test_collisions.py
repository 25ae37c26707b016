"""Texts that are written to collide under the hashes that are public."""

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose, shingles

from tessera.llm import decontam, near_dedup, quality
from tessera.llm.textvec import Words, blocks, mix, secret_key, span_hash, text_bytes

#: Two texts without a word triple in common, and two long words: equal without a key.
TRIPLES = ("training sentence here", "vpebmnvp rf3mc.@4 here")
LONG_WORDS = ("internationalise", "mcyalgriy&7.);/e")


def unmixed(x):
    """The number that ``mix`` turns into ``x``."""
    inverse = lambda m: pow(m, -1, 2**64)
    shifted = lambda v, k: v ^ v >> k ^ (v >> 2 * k)
    v = shifted(int(x), 31)
    v = shifted(v * inverse(0x94D049BB133111EB) % 2**64, 27)
    return shifted(v * inverse(0xBF58476D1CE4E5B9) % 2**64, 30)


def colliding_spans(seed, rng):
    """Two spans of 16 bytes of the same hash under ``seed``: the second block is solved for a new first one."""
    one = lambda v: int(mix(np.array([v % 2**64], np.uint64))[0])
    a, b, c = (int.from_bytes(rng.bytes(8), "little") for _ in range(3))
    at = [one(k + seed) for k in (0, 1)]
    total = (one(a ^ at[0]) + one(b ^ at[1])) % 2**64
    d = unmixed((total - one(c ^ at[0])) % 2**64) ^ at[1]
    return [x.to_bytes(8, "little") + y.to_bytes(8, "little") for x, y in ((a, b), (c, d))]


def hashes(spans, seed):
    data = np.frombuffer(b"".join(spans), np.uint8)
    start = np.arange(len(spans)) * 16
    return span_hash(blocks(data), start, start + 16, seed).tolist()


def test_solved_spans_differ_under_a_key():
    rng = np.random.default_rng(1)
    for _ in range(50):
        spans = colliding_spans(1, rng)
        assert spans[0] != spans[1] and len(set(hashes(spans, 1))) == 1
        assert len(set(hashes(spans, 1 + secret_key()))) == 2


def test_known_pairs_collide_without_a_key_only():
    for pair in (TRIPLES, LONG_WORDS):
        data, off = text_bytes(pa.array(pair))
        for key, different in ((0, 1), (secret_key(), 2)):
            found, _ = Words(data, off, lower=True, key=key).shingles(3, short=True)
            assert len(set(found.tolist())) == different


def test_near_duplicates_are_confirmed_on_what_is_there(spark):
    rows = [(1, TRIPLES[0]), (2, TRIPLES[1]), (3, TRIPLES[0].upper()), (4, LONG_WORDS[0]), (5, LONG_WORDS[1])]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=85, den=100)
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_items_are_found_where_they_are(spark):
    items = spark.createDataFrame([(1, "training sentence one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "vpebmnvp rf3mc.@4 one two three"), (2, "a Training sentence one two three b")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contained_items(docs, items).collect()] == [(2, 1)]
    assert [r.doc_id for r in decontam.decontaminated(docs, items).collect()] == [1]


@pytest.mark.parametrize("filler", ["", prose(3, 30) + "\n"])
def test_lines_and_windows_are_repeated_only_if_they_are(spark, filler):
    lines = filler + "\n".join(LONG_WORDS)
    windows = filler + " ".join([*TRIPLES[0].split()[:2], "one two three", *TRIPLES[1].split()[:2], "one two three"])
    rows = [(1, lines, "en"), (2, windows, "en"), (3, filler + f"{LONG_WORDS[0]}\n{LONG_WORDS[0]}", "en")]
    out = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [out[k].n_dup_lines for k in (1, 2, 3)] == [0, 0, 1]
    assert [out[k].n_repeat_words for k in (1, 2)] == [0, 0]


def test_sets_are_as_large_as_their_shingles():
    texts = [prose(k, 300) for k in range(5)]
    data, off = text_bytes(pa.array(texts))
    found, o = Words(data, off, lower=True, key=secret_key()).shingles(3, short=True)
    assert [len(set(found[a:b].tolist())) for a, b in zip(o[:-1], o[1:], strict=True)] == [len(shingles(t, 3)) for t in texts]

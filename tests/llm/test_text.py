"""Vectorised words, shingles and pre-tokens against plain Python and the library."""

import random

import numpy as np
import pyarrow as pa
from llm_fixtures import BYTE_BPE, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.pretok import Pieces
from tessera.llm.textvec import Words, slices, text_bytes

LIBRARY = Tokenizer.from_file(BYTE_BPE)
PIECES = Pieces(BYTE_BPE)
TRICKY = st.text(st.sampled_from(list("ab'stremvdlABC  \n\t\r\x0b.,!19½é世́  ​\x1c\x85") + ["😀"]), max_size=25)


def encode(texts):
    ids, off = PIECES.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]


def by_library(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY | st.text(max_size=12), max_size=6))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(texts) == by_library(texts)


def test_special_strings_and_nulls():
    texts = ["a <|endoftext|> b", None, "", "<|endoftext|><|endoftext|>", "!<|endoftext|>'s x", "plain"]
    assert encode(texts) == by_library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=5), st.integers(1, 5))
def test_words_and_shingles(texts, k):
    data, off = text_bytes(pa.array(texts))
    w = Words(data, off, lower=True)
    assert w.count.tolist() == [len(words(t)) for t in texts]
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in texts for x in words(t)]
    found, o = w.shingles(k, short=True)
    assert [len(np.unique(found[a:b])) for a, b in zip(o[:-1], o[1:], strict=True)] == [len(shingles(t, k)) for t in texts]
    if len(texts) > 1:
        a, b = (set(found[o[i] : o[i + 1]].tolist()) for i in (0, 1))
        assert len(a & b) == len(shingles(texts[0], k) & shingles(texts[1], k))


def test_slices_cover_all_rows():
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "x" * rng.randint(0, 900) for _ in range(200)]
    batch = pa.record_batch([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"]).slice(7)
    back = []
    for rows, data, off in slices(batch, limit=1000):
        back += list(zip(rows.column(0).to_pylist(), (data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)), strict=True))
    assert back == [(i, texts[i] or "") for i in range(7, 200)]

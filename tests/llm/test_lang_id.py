import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lang_id, queries


def plain(model, text):
    """Probabilities of a text, position by position and window by window, with nothing shared between them."""
    p, n = model.p, model.hidden
    logistic = lambda v: 1 / (1 + np.exp(-v))
    data, total = text.encode(), np.zeros(model.classes)
    for a in range(0, len(data), lang_id.WINDOW):
        window = data[a : a + lang_id.WINDOW]
        states = {}
        for side in "fb":
            h, states[side] = np.zeros(n), [None] * len(window)
            for t in range(len(window)) if side == "f" else reversed(range(len(window))):
                x, g = p["in" + side][:, window[t]], p["rec" + side] @ h
                update, reset = logistic(x[:n] + g[:n]), logistic(x[n : 2 * n] + g[n : 2 * n])
                h = update * h + (1 - update) * np.tanh(x[2 * n :] + reset * g[2 * n :])
                states[side][t] = h
        for t, byte in enumerate(window):
            if byte >= 128 or chr(byte).isalpha():
                z = p["out"] @ np.concatenate([states["f"][t], states["b"][t]]) + p["bias"][:, 0]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return total / total.sum() if total.sum() else total


def test_probabilities_equal_plain_python():
    model = lang_id.ByteGru(3, dtype=np.float64)
    texts = ["abc", "", "x", "é世界 und mehr", "long text, " * 40, "12 345", "y" * 64, "z" * 65]
    data = [t.encode() for t in texts]
    got = lang_id.document_probabilities(model, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain(model, text), atol=1e-12)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    model = lang_id.ByteGru(3, hidden=4, dtype=np.float64)
    x = rng.integers(60, 130, (9, 6))
    inside = np.arange(9)[:, None] < np.array([9, 9, 4, 1, 7, 9])
    label, weight = rng.integers(0, 3, 6), rng.random(6)
    _, grad = model.gradient(x, inside, label, weight)
    for name, value in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in value.shape)
            at = (at[0], x[2, 1]) if name.startswith("in") else at
            old, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                losses.append(model.gradient(x, inside, label, weight)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grad[name][at]) < 1e-7


@pytest.fixture(scope="module")
def predicted(spark, corpus):
    return queries.op13_language_id(spark, "/root/testdata/sf0.001").join(corpus.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_documents_are_named_right(predicted, corpus):
    assert len(predicted) == corpus.count()
    held_out = [r for r in predicted if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    assert len(held_out) > 20 and np.mean([r.lang_pred == r.lang for r in held_out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in predicted)


def test_labels_of_held_out_rows_are_not_learned(spark, corpus):
    swapped = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    pieces = lang_id.training_pieces(swapped)
    assert pieces.where("lang = 'zz'").count() == 0
    assert lang_id.training_pieces(corpus, sample=5).groupBy("lang").count().agg(F.max("count")).first()[0] == 5


def test_odd_rows(odd_documents, no_documents):
    out = lang_id.language_predictions(odd_documents, steps=2).collect()
    texts = {(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()}
    assert len(out) == odd_documents.count()
    lettered = {i: any(c.isalpha() for c in t or "") for i, t in texts}
    for r in out:
        assert (r.lang_pred == "und") == (not lettered[r.doc_id])
        assert r.lang_pred != "und" or r.score == 0
    assert lang_id.language_predictions(no_documents, steps=2).collect() == []


def test_without_languages_and_with_one(odd_documents):
    none = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lang_id.language_predictions(none).collect()} == {("und", 0.0)}
    one = odd_documents.withColumn("lang", F.lit("xx"))
    assert {(r.lang_pred, r.score) for r in lang_id.language_predictions(one).collect()} == {("und", 0.0), ("xx", 1.0)}

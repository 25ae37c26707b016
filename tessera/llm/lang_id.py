"""Language identification: a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, one after another until its end.
Two gated recurrent layers read each window's bytes, one from either side, and
a softmax labels every position.  A document's probabilities are the mean over
all its positions that hold a letter (or a byte of a non-ASCII character).

The network is trained in numpy by backpropagation through time (Adam, clipped
gradients) on a bounded sample: at most ``SAMPLE`` pieces of ``PIECE`` characters a
language, each from another row at a place drawn by hash, never from held-out
rows.  Scoring covers every byte of every text; windows of a slice of rows
advance together, so numpy sees a few large steps.

Defined results for odd input: a null text and one without a letter give
``und`` and score 0, whatever was learned; a null ``doc_id`` keeps its row, is not
held out and lends no label; rows that repeat a ``doc_id`` have a result each; a
null ``lang`` lends no label; without any label every row is ``und``; with one
language all rows with a letter get it at 1; ties go to the first language in
code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.spill import bounded_broadcast, saved
from tessera.llm.textvec import slices
from tessera.llm.worker import held

WINDOW = 64
HIDDEN = 8
#: Pieces a language that are trained on, and their characters.
SAMPLE = 800
PIECE = 256
#: Batches that are trained on, of this many windows (or of all there are).
STEPS = 260
BATCH = 512
#: Languages whose sizes are broadcast; more are joined by a shuffle.
MAX_LANGUAGES = 100_000
#: Windows that advance together.
TOGETHER = 4096
#: Rows whose crc32(doc_id) has this remainder are held out of training.
HELD_OUT = (4, 2)
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all windows of the texts that ``offsets`` cut from ``data``, and the text of each."""
    per = -(-np.diff(offsets) // size)
    text = np.repeat(np.arange(len(per)), per)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * size
    return start, np.minimum(start + size, offsets[1:][text]), text


def columns(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (size, n) of the windows, a window a column, and where they are inside it."""
    at = start + np.arange(size)[:, None]
    inside = at < end
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.intp), inside


def _logistic(x: np.ndarray) -> None:
    """1 / (1 + exp(-x)) in place; numpy's exp is the fastest of its kind."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class ByteGru:
    """Two gated recurrent layers over bytes in opposite directions, and a softmax at each position.

    Arrays are (features, windows), so that each gate is one contiguous block.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p = {"out": rng.normal(0, 0.3, (classes, 2 * hidden)), "bias": np.zeros((classes, 1))}
        for side in "fb":
            self.p["in" + side] = rng.normal(0, 0.5, (3 * hidden, 256))
            self.p["rec" + side] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def _step(self, side: str, x: np.ndarray, inside: np.ndarray, h: np.ndarray):
        n = self.hidden
        a = np.take(self.p["in" + side], x, axis=1, mode="clip")
        g = self.p["rec" + side] @ h
        gates = a[: 2 * n]
        gates += g[: 2 * n]
        _logistic(gates)
        update, reset = gates[:n], gates[n:]
        new = a[2 * n :]
        new += reset * g[2 * n :]
        new *= 2
        _logistic(new)
        new *= 2
        new -= 1  # the hyperbolic tangent
        after = h - new
        after *= update
        after += new
        after *= inside
        return after, update, reset, new, g[2 * n :]

    def _run(self, side: str, x: np.ndarray, inside: np.ndarray, keep: bool = False):
        """States (bytes, hidden, windows) after each byte, and what training needs of each step."""
        order = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((self.hidden, x.shape[1]), self.p["out"].dtype)
        states, steps = np.empty((len(x), *h.shape), h.dtype), {}
        for t in order:
            before = h
            h, *rest = self._step(side, x[t], inside[t], h)
            states[t] = h
            if keep:
                steps[t] = (before, *rest)
        return states, steps

    def _labels(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        n = self.hidden
        z = self.p["out"][:, :n] @ forward + self.p["out"][:, n:] @ backward + self.p["bias"]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def pooled(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Sums (classes, windows) of the probabilities of all positions that hold a letter."""
        counted = inside & _LETTER[x]
        back, _ = self._run("b", x, inside)
        h = np.zeros((self.hidden, x.shape[1]), back.dtype)
        total = np.zeros((self.classes, x.shape[1]), back.dtype)
        for t in range(len(x)):
            h = self._step("f", x[t], inside[t], h)[0]
            labels = self._labels(h, back[t])
            labels *= counted[t]
            total += labels
        return total

    def gradient(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted loss over the positions that hold a letter, and its gradient."""
        n, p = self.hidden, self.p
        share = (inside & _LETTER[x]) * weight
        share = (share / max(share.sum(), 1e-9)).astype(p["out"].dtype)
        kept = {side: self._run(side, x, inside, keep=True) for side in "fb"}
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        above = {side: np.empty_like(kept[side][0]) for side in "fb"}
        loss, column = 0.0, np.arange(x.shape[1])
        for t in range(len(x)):
            z = self._labels(kept["f"][0][t], kept["b"][0][t])
            loss -= float((np.log(np.maximum(z[label, column], 1e-30)) * share[t]).sum())
            z[label, column] -= 1
            z *= share[t]
            grad["bias"][:, 0] += z.sum(axis=1)
            for k, side in enumerate("fb"):
                grad["out"][:, k * n : (k + 1) * n] += z @ kept[side][0][t].T
                above[side][t] = p["out"][:, k * n : (k + 1) * n].T @ z
        for side in "fb":
            order = range(len(x) - 1, -1, -1) if side == "f" else range(len(x))
            later = np.zeros_like(above[side][0])
            to_input = np.empty((len(x), 3 * n, x.shape[1]), later.dtype)
            for t in order:
                before, update, reset, new, recurrent = kept[side][1][t]
                d = (above[side][t] + later) * inside[t]
                d_new = d * (1 - update) * (1 - new * new)
                d_update = d * (before - new) * update * (1 - update)
                d_reset = d_new * recurrent * reset * (1 - reset)
                to_input[t] = np.concatenate([d_update, d_reset, d_new])
                to_state = np.concatenate([d_update, d_reset, d_new * reset])
                grad["rec" + side] += to_state @ before.T
                later = d * update + p["rec" + side].T @ to_state
            flat = x.ravel()
            for k in range(3 * n):
                grad["in" + side][k] = np.bincount(flat, to_input[:, k].ravel(), 256)
        return loss, grad

    def fit(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> ByteGru:
        """Adam over shuffled batches of windows; each class weighs the same in sum."""
        with np.errstate(over="ignore"):
            return self._fit(x, inside, label, steps, batch, rate, seed)

    def _fit(self, x, inside, label, steps, batch, rate, seed) -> ByteGru:
        rng = np.random.default_rng(seed)
        weight = (1 / np.maximum(np.bincount(label, minlength=self.classes), 1))[label]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        spread = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(label))
            for a in range(0, min(len(order), (steps - step) * batch), batch):
                some = order[a : a + batch]
                _, grad = self.gradient(x[:, some], inside[:, some], label[some], weight[some])
                norm = float(sum((g.astype(np.float64) ** 2).sum() for g in grad.values())) ** 0.5
                step += 1
                for k, g in grad.items():
                    g = g / max(1.0, norm)
                    mean[k] += 0.1 * (g - mean[k])
                    spread[k] += 0.01 * (g * g - spread[k])
                    self.p[k] -= (rate * (1 - 0.9 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return self


def document_probabilities(model: ByteGru, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities (texts, classes): the mean over all positions with a letter; 0 where there is none."""
    start, end, text = windows(data, offsets)
    total = np.zeros((len(offsets) - 1, model.classes))
    for a in range(0, len(start), TOGETHER):
        x, inside = columns(data, start[a : a + TOGETHER], end[a : a + TOGETHER])
        with np.errstate(over="ignore"):  # the exponential of a gate that is shut
            sums = model.pooled(x, inside).astype(np.float64)
        owner = text[a : a + TOGETHER]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[first]] += np.add.reduceat(sums, first, axis=1).T
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)


def training_pieces(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, draw, doc_id, piece): at most ``sample`` pieces of text a language, never of held-out rows."""
    mod, rest = HELD_OUT
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != rest)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30))
    at = 1 + F.pmod(F.xxhash64("doc_id", F.lit(57)), F.greatest(F.lit(1), F.length("text") - PIECE + 1))
    # thinned by hash to some sample rows a language before ranks are given, so that a language of a third of the rows is no hot key
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    thinned = rows.withColumn("draw", draw).join(bounded_broadcast(saved(sizes, "language-sizes"), MAX_LANGUAGES), "lang").where(F.col("draw") * F.col("n") < int(1.2 * sample + 60) * (1 << 30))
    pieces = thinned.select("lang", "draw", "doc_id", F.substring("text", at.cast("int"), F.lit(PIECE)).alias("piece"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "piece")))
    return saved(ranked.where(F.col("k") <= sample).drop("k"), "training-pieces")


def trained(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> tuple[list[str], ByteGru | None]:
    """The languages that were learned, in code-point order, and the network; None for fewer than two."""
    rows = training_pieces(docs, sample).toArrow().sort_by([("lang", "ascending"), ("draw", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
    langs = sorted(set(rows["lang"].to_pylist()))
    if len(langs) < 2:
        return langs, None
    texts = [t.encode() for t in rows["piece"].to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, text = windows(data, offsets)
    x, inside = columns(data, start, end)
    label = np.searchsorted(np.array(langs), np.array(rows["lang"].to_pylist()))[text]
    return langs, ByteGru(len(langs)).fit(x, inside, label, steps)


def _labeller(name: str, block, langs: list[str]):
    mod, rest = HELD_OUT
    unknown = len(langs)

    def label(batches):
        model = held("languages", "network", name, lambda: block.value)
        names = pa.array([*langs, UNKNOWN])
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids = rows.column(0).cast(pa.int64())
                out = [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids.to_pylist()]
                lettered = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if model is None:
                    best, score = np.zeros(len(out), np.int64), np.ones(len(out))
                else:
                    probable = document_probabilities(model, data, offsets)
                    best = probable.argmax(axis=1)
                    score = np.minimum(probable[np.arange(len(best)), best], 1.0)
                known = lettered & bool(langs)
                found = names.take(pa.array(np.where(known, best, unknown)))
                yield pa.record_batch([ids, pa.array(out, pa.bool_()), found, pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return label


def language_predictions(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text; lang to learn from)."""
    sc = docs.sparkSession.sparkContext
    langs, model = trained(docs, sample, steps)
    block = sc.broadcast(model)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(_labeller(f"{sc.applicationId}-{block._jbroadcast.id()}", block, langs), "doc_id bigint, held_out boolean, lang_pred string, score double")

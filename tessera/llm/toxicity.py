"""Toxicity: a subword-bag classifier with jointly trained embeddings.

Every word is the bag of itself and its character 3- to 5-grams, word ends
included, hashed into ``BUCKETS`` rows of an embedding table.  A passage is the
mean of its subword vectors (a word that comes again in it adds only to the
number), and a linear softmax gives its label.  Table and
softmax are trained together in numpy.  An unseen misspelling shares most
n-grams, and so most of its vector, with the word it comes from.

A document is scored by passages of ``PASSAGE`` words (a short document is one
passage): by the mean of its ``TOP`` most toxic ones, so that insults in a long
text are not averaged away, and one odd word alone decides little; training
follows the same rule.

Training reads whole texts of each class in an order drawn by hash (never held-out
rows), until ``SAMPLE`` texts or ``SAMPLE_CHARS`` characters in sum are reached:
documented bounds, since the classifier's table is of fixed size.  No text is left
out for its own length; the last one may reach over.  Scoring covers all rows.  Because the softmax is linear, a
worker needs one number per bucket (1 MB), not the vectors.

Defined results for odd input: a null, empty or blank text has no subwords
and gets the score of the bias alone; a null ``doc_id`` keeps its row, is not
held out and lends no label; rows that repeat a ``doc_id`` have a result each, and
the least of their texts is trained on; of two labels of one ``doc_id`` 1 holds;
without labels of both classes every score is 0; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.spill import bounded_broadcast, saved
from tessera.llm.textvec import Words, mix, slices, text_bytes
from tessera.llm.worker import held

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIM = 8
PASSAGE = 5
#: A document's score is the mean over so many of its most toxic passages.
TOP = 3
SAMPLE = 1500
#: Characters of a class that are trained on (some 30 bytes of driver memory each).
SAMPLE_CHARS = 8_000_000
EPOCHS = 12
NGRAMS = (3, 4, 5)
#: A passage of fewer subwords counts as so many, so that a word or two decide nothing.
LEAST = 20
#: Rows whose crc32(doc_id) is divisible by this are held out of training.
HELD_OUT = 5

_SHIFT = np.uint64(64 - BUCKET_BITS)


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, word_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the given words, and the word each belongs to, in no set order."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each word between two blanks, so that windows of bytes are n-grams with word ends
    size = end - start
    first = np.cumsum(size + 2) - (size + 2)
    total = int(first[-1] + size[-1] + 2)
    at = np.repeat(start - first - 1, size + 2) + np.arange(total)
    line = data[np.clip(at, 0, len(data) - 1)]
    line = np.where((line >= 65) & (line <= 90), line + 32, line).astype(np.uint8)
    line[first] = line[first + size + 1] = 32
    word = np.repeat(np.arange(len(size)), size + 2)
    found, owner = [(word_hash >> _SHIFT).astype(np.int64)], [np.arange(len(size))]
    for n in NGRAMS:
        i = np.flatnonzero(word[: total - n + 1] == word[n - 1 :]) if total >= n else np.zeros(0, np.int64)
        gram = np.zeros(len(i), np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | line[i + k]
        with np.errstate(over="ignore"):
            h = mix(gram + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        found.append((h >> _SHIFT).astype(np.int64))
        owner.append(word[i])
    return np.concatenate(found), np.concatenate(owner)


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The passage of each word, and the text of each passage (texts without words have none)."""
    per = -(-words.count // PASSAGE)
    first = np.cumsum(per) - per
    text = words.texts()
    within = np.arange(len(text)) - words.offsets[:-1][text]
    # even passages: no short rest that a single word could dominate
    length = -(-words.count // np.maximum(per, 1))
    return first[text] + within // np.maximum(length[text], 1), np.repeat(np.arange(words.n_texts), per)


def _fresh(words: Words, passage: np.ndarray) -> np.ndarray:
    """Marks the first occurrence of each word in its passage."""
    with np.errstate(over="ignore"):
        key = mix(words.hash + mix(passage.astype(np.uint64) + np.uint64(1)))
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


class SubwordClassifier:
    """Embedding table and softmax, trained jointly by mini-batch Adagrad."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.weight = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.rng = rng

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, batch: int = 32) -> "SubwordClassifier":
        """``bags``: for each text (passage bounds, buckets, weights), buckets sorted by passage."""
        g_table = np.full(BUCKETS, 1e-6, np.float32)
        g_weight, g_bias = np.full_like(self.weight, 1e-6), np.full_like(self.bias, 1e-6)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = self.rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                chosen = order[lo : lo + batch]
                scalar = self.scalars()
                picked = []
                for t in chosen:  # the passages that the model finds most toxic
                    bound, bucket, weight = bags[t]
                    means = np.add.reduceat(scalar[bucket] * weight, bound[:-1])
                    top = [slice(bound[k], bound[k + 1]) for k in np.argsort(-means, kind="stable")[:TOP]]
                    picked.append((np.concatenate([bucket[k] for k in top]), np.concatenate([weight[k] for k in top]) / len(top)))
                bucket, weight = np.concatenate([p[0] for p in picked]), np.concatenate([p[1] for p in picked])
                cut = np.cumsum([0] + [len(p[0]) for p in picked])
                hidden = np.add.reduceat(self.table[bucket] * weight[:, None], cut[:-1])
                logit = hidden @ self.weight + self.bias
                prob = np.exp(logit - logit.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                error = prob.copy()
                error[np.arange(len(chosen)), label[chosen]] -= 1
                d_weight, d_bias, d_hidden = hidden.T @ error / len(chosen), error.mean(axis=0), error @ self.weight.T
                owner = np.repeat(np.arange(len(chosen)), np.diff(cut))
                rows = d_hidden[owner] * weight[:, None]
                uniq, inverse = np.unique(bucket, return_inverse=True)
                grad = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(grad, inverse, rows)
                g_table[uniq] += (grad**2).mean(axis=1)
                self.table[uniq] -= step * grad / np.sqrt(g_table[uniq])[:, None]
                g_weight += d_weight**2
                g_bias += d_bias**2
                self.weight -= step * d_weight / np.sqrt(g_weight)
                self.bias -= step * d_bias / np.sqrt(g_bias)
        return self

    def scalars(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1, before the mean."""
        return self.table @ (self.weight[:, 1] - self.weight[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def text_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Training bags of texts that have words."""
    out = []
    for text in texts:
        data, offsets = text_bytes(pa.array([text]))
        words = Words(data, offsets, lower=True)
        passage, _ = passages(words)
        n = np.maximum(np.bincount(passage, subword_count(words.end - words.start)), LEAST)
        keep = _fresh(words, passage)
        bucket, owner = subwords(data, words.start[keep], words.end[keep], words.hash[keep])
        p = passage[keep][owner]
        order = np.argsort(p, kind="stable")
        out.append((np.concatenate([[0], np.cumsum(np.bincount(p))]), bucket[order].astype(np.int32), (1.0 / n[p[order]]).astype(np.float32)))
    return out


def subword_count(size: np.ndarray) -> np.ndarray:
    """How many subwords a word of ``size`` bytes has."""
    return 1 + sum(np.maximum(size + 2 - n + 1, 0) for n in NGRAMS)


class WordSums:
    """Sum over a word's subwords of what each adds to the log odds, kept by word hash.

    A direct-mapped table holds the sums between slices; only words that are
    not in it are cut into subwords.
    """

    def __init__(self, scalar: np.ndarray, bits: int = 20):
        self.scalar, self.shift = scalar, np.uint64(64 - bits)
        self.key = np.zeros(1 << bits, np.uint64)
        self.sum = np.zeros(1 << bits, np.float32)

    def of(self, words: Words, data: np.ndarray) -> np.ndarray:
        at = (words.hash >> self.shift).astype(np.int64)
        out = self.sum[at].astype(np.float64)
        miss = np.flatnonzero(self.key[at] != words.hash)
        if len(miss):
            uniq, first, inverse = np.unique(words.hash[miss], return_index=True, return_inverse=True)
            w = miss[first]
            bucket, owner = subwords(data, words.start[w], words.end[w], uniq)
            sums = np.bincount(owner, self.scalar[bucket], len(uniq)).astype(np.float32)
            out[miss] = sums[inverse]
            self.key[at[w]], self.sum[at[w]] = uniq, sums
        return out

    def log_odds(self, data: np.ndarray, offsets: np.ndarray, bias: float) -> np.ndarray:
        """Log odds of label 1 of each text of a slice."""
        words = Words(data, offsets, lower=True)
        out = np.full(words.n_texts, bias)
        if len(words.hash):
            passage, text = passages(words)
            n = np.maximum(np.bincount(passage, subword_count(words.end - words.start), len(text)), LEAST)
            mean = np.bincount(passage, self.of(words, data) * _fresh(words, passage), len(text)) / n
            order = np.lexsort((-mean, text))  # the texts' passages stay together, the most toxic first
            rank = np.arange(len(text)) - np.searchsorted(text, text[order])
            top = order[rank < TOP]
            out += np.bincount(text[top], mean[top], words.n_texts) / np.maximum(np.bincount(text[top], minlength=words.n_texts), 1)
        return out


def _worker_sums(name: str, scalar) -> WordSums:
    return held("toxicity", "sums", name, lambda: WordSums(scalar.value))


def _scorer(name: str, scalar, bias: float):
    def score(batches):
        sums = _worker_sums(name, scalar)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                odds = sums.log_odds(data, offsets, bias)
                ids = rows.column(0).cast(pa.int64())
                out = [i is not None and zlib.crc32(str(i).encode()) % HELD_OUT == 0 for i in ids.to_pylist()]
                prob = np.where(np.isneginf(odds), 0.0, 1 / (1 + np.exp(-np.clip(odds, -700, 700))))
                yield pa.record_batch([ids, pa.array(out), pa.array(prob), pa.array((prob >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic, draw) of at most ``sample`` labelled texts of each class, never held-out ones.

    Labels are thinned by hash before texts are read, so that what reaches
    the driver does not grow with the table.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT != 0)
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = lambda k: min(1.0, sample / max(1, sizes.get(k, 0))) * (1 << 30)
    chosen = usable.where(F.col("draw") < F.when(F.col("toxic") == 1, F.lit(limit(1))).otherwise(F.lit(limit(0)))).select("doc_id", "toxic", "draw")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.trim("text") != "").join(bounded_broadcast(chosen, 4 * sample), "doc_id")
    rows = saved(rows.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")), "labelled-texts")
    # at most some thousand narrow rows
    order = Window.partitionBy("toxic").orderBy("draw", "doc_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = rows.select("doc_id", "toxic", "draw", F.length("text").alias("n")).select("doc_id", before.alias("before"), F.row_number().over(order).alias("k"))
    taken = taken.where((F.col("before") < chars) & (F.col("k") <= sample)).select("doc_id")
    return rows.join(bounded_broadcast(taken, 2 * sample), "doc_id", "left_semi").select("doc_id", "text", "toxic", "draw")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    rows = training_rows(docs, labels, sample, chars).toArrow().sort_by([("toxic", "ascending"), ("draw", "ascending"), ("doc_id", "ascending")])
    label = rows["toxic"].to_numpy()
    texts = rows["text"].to_pylist()
    scalar, bias = np.zeros(BUCKETS, np.float32), -np.inf
    if len(set(label.tolist())) == 2:
        bags = text_bags(texts)
        full = [i for i, b in enumerate(bags) if len(b[1])]
        model = SubwordClassifier().fit([bags[i] for i in full], label[full], epochs)
        scalar, bias = model.scalars().astype(np.float32), model.offset()
    block = sc.broadcast(scalar)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_scorer(f"{sc.applicationId}-{block._jbroadcast.id()}", block, bias), "doc_id bigint, held_out boolean, score double, predicted int")

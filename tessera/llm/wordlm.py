"""Word n-gram models whose tables grow with the corpus.

Words are 64-bit hashes of their bytes as they are, without folding.  A word
stands after a history: the start of a text, or the word before it.  Spark
counts all pairs of history and word, and keeps every one of them; there is no
cut-off, and the table grows with the pairs of the corpus.  Pairs are smoothed by
interpolated modified Kneser-Ney of order 2: discounts come from counts of
counts, lower-order probabilities from the number of different histories of a
word.  Totals of histories and of words are joined to the pairs in Spark; what
reaches the driver are a row of counts of counts and one of sums.

A caller may name the words that are histories of their own (the most frequent
ones, say); all others are then one history.

Most pairs of a corpus stand in it once.  Of those the probability follows from the
totals of history and word alone, so they are counted like all others, but need no
row to be scored by.  Totals of the most frequent words and histories, at most
``HEAD_LIMIT`` each, are broadcast.  A pair of two of these is scored in place as
if it stood once; the model has what is to be added where it stands more than once, and
the whole log probability of each pair that has another word or history.  Of these rows the
most frequent, at most ``HEAD_LIMIT``, are broadcast, all others are joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.spill import bounded_broadcast, saved, settled
from tessera.llm.textvec import Words, mix, signed, slices
from tessera.llm.token_counts import Lookup, frequent
from tessera.llm.worker import held

#: Rows of the frequent keys, words and histories that are broadcast, at most (20 to 40 bytes each for two models).
HEAD_LIMIT = 1 << 19
#: Words that a task holds before it passes their counts on.
TASK_WORDS = 1 << 22

#: Frequent words of one text in ``HOT_SHARE`` whose pairs are dealt by history too, in so many parts.
HOT_WORDS, HOT_SHARE, HOT_PARTS = 1000, 64, 64

#: Words or histories whose totals are broadcast to the pairs (some 20 MB); more are joined by a shuffle.
MAX_TOTALS = 300_000

#: Beyond so many rows of the model, texts are scored in so many parts, one after another, so that the shuffle files of one part lie on disk at a time.
WHOLE_MODEL, TEXT_PARTS = 1_000_000, 2

START, OTHER = 0, 1  # histories before the frequent words


def frequent_words(table: DataFrame, k: int) -> np.ndarray:
    """The ``k`` most frequent words (ties: by key) of ``word_counts``, sorted."""
    top = table.orderBy(F.desc("total"), "key").limit(k).select("key").collect()
    return np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))


def histories(words: Words, known: np.ndarray) -> np.ndarray:
    """The history of each word: its number in ``known`` and 2, or ``START`` or ``OTHER``."""
    own = np.full(len(words.hash), OTHER, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
        hit = known[at] == words.hash
        own[hit] = at[hit] + 2
    out = np.full_like(own, START)
    out[1:] = own[:-1]
    out[words.offsets[:-1][words.count > 0]] = START
    return out


_OF_HISTORY = mix(np.arange(1, 1 << 12, dtype=np.uint64))


def pair_key(word: np.ndarray, history: np.ndarray) -> np.ndarray:
    """One key for a word after a history."""
    return word ^ _OF_HISTORY[history]


def words_before(words: Words, known: np.ndarray | None = None) -> np.ndarray:
    """The hash of the word before each word; a constant at the start of a text, and one for all words not in ``known`` if that is given."""
    own = words.hash
    if known is not None:
        own = np.where(np.isin(own, known), own, _OF_HISTORY[OTHER])
    out = np.empty_like(own)
    out[1:] = own[:-1]
    out[words.offsets[:-1][words.count > 0]] = _OF_HISTORY[START]
    return out


#: Bits that a history's hash is turned by before it meets its word's.
_TURN = 23


def word_pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One key for a word after another; ``_word_pair_key`` is the same in Spark."""
    return word ^ (before << np.uint64(_TURN) | before >> np.uint64(64 - _TURN))


def _word_pair_key():
    turned = F.shiftleft("h", _TURN).bitwiseOR(F.shiftrightunsigned("h", 64 - _TURN))
    return F.col("w").bitwiseXOR(turned)


def _counter(n_models: int, known: np.ndarray | None, hot: np.ndarray):
    def count(batches):
        parts, n, frequent_ = [], 0, Lookup(hot, hot)

        def flush():
            w, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            key = word_pair_key(w, h)
            order = np.argsort(key)
            key = key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            first = order[begin]
            counts = [np.diff(np.append(begin, len(key)))] + [np.add.reduceat(np.concatenate([p[2][k] for p in parts])[order], begin, dtype=np.int64) for k in range(n_models - 1)]
            part = np.where(frequent_.find(w[first]) >= 0, h[first] % np.uint64(HOT_PARTS), 0).astype(np.int32)
            # by word, part and counts, as rows that are alike take less room side by side
            alike = part.astype(np.uint64) << np.uint64(8) | np.minimum(counts[0], 15).astype(np.uint64) << np.uint64(4) | np.minimum(counts[-1], 15).astype(np.uint64)
            order = np.argsort(w[first] & ~np.uint64((1 << 14) - 1) | alike)
            for lo in range(0, len(first), 100_000):
                some = order[lo : lo + 100_000]
                at = first[some]
                yield pa.record_batch([pa.array(signed(w[at])), pa.array(part[some]), pa.array(signed(h[at])), *(pa.array(c[some].astype(np.int64)) for c in counts)], names=["w", "part", "h", *(f"n{k}" for k in range(n_models))])

        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = Words(data, offsets)
                marks = [np.repeat(rows.column(k).to_numpy(zero_copy_only=False).astype(bool), words.count) for k in range(1, n_models)]
                parts.append((words.hash, words_before(words, known), marks))
                n += len(words.hash)
                if n >= TASK_WORDS:
                    yield from flush()
                    parts, n = [], 0
        if n:
            yield from flush()

    return count


def pair_counts(docs: DataFrame, known: np.ndarray | None = None, members: list[str] = ()) -> DataFrame:
    """(w, h, n0, n1, ...) of all pairs of word and history, over all texts and over those that each boolean column marks.

    Pairs are dealt by word, and come sorted by it, which takes the least room.  Words that
    are frequent in some of the texts are dealt by history too, so they are no group; where they are
    dealt to changes no count.
    """
    n = 1 + len(members)
    schema = "w bigint, part int, h bigint, " + ", ".join(f"n{k} bigint" for k in range(n))
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), *members)
    hot = frequent_words(word_counts(docs.where(F.xxhash64("text") % HOT_SHARE == 0)), HOT_WORDS)
    found = docs.mapInArrow(_counter(n, known, hot), schema).repartition("w", "part")
    return found.groupBy("w", "part", "h").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(n))).sortWithinPartitions("w").drop("part")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney."""
    if min(n1, n2, n3, n4) == 0:  # too few rare ones to estimate from
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [float(min(max(x, 0.01), k)) for k, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def _discounted(count, d: list[float]):
    """The count less its discount; 0 for 0."""
    return F.when(count > 2, count - d[2]).when(count == 2, count - d[1]).when(count == 1, count - d[0]).otherwise(0.0)


def _times(count, name: str, limit: int = 4) -> list:
    """How many rows have a ``count`` of 1, 2, ... and of over two."""
    return [*(F.count(F.when(count == j, 1)).alias(f"{name}_{j}") for j in range(1, limit + 1)), F.count(F.when(count > 2, 1)).alias(f"{name}_more")]


class Totals:
    """Log probabilities of pairs from the totals of frequent words and histories."""

    def __init__(self, words: list[np.ndarray], histories: list[np.ndarray], upper: list[list[float]]):
        n = len(upper)
        self.word, self.history = (Lookup(t[0], np.arange(len(t[0]))) for t in (words, histories))
        self.low, self.share, self.back = words[1:], histories[1 : 1 + n], histories[1 + n :]
        self.off = [np.array([0.0, *d, d[2]]) for d in upper]

    def find(self, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pairs have totals of both, and the rows of these in the two tables."""
        w, h = self.word.find(w), self.history.find(h)
        both = np.flatnonzero((w >= 0) & (h >= 0))
        return both, self.word.value[w[both]], self.history.value[h[both]]

    def log_prob(self, k: int, w: np.ndarray, h: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """In model ``k``, of pairs that stand there ``count`` times."""
        less = count - self.off[k][np.minimum(count, 3)]
        return np.log(less * self.share[k][h] + self.back[k][h].astype(np.float64) * self.low[k][w])


def _arrays(table: DataFrame) -> list[np.ndarray]:
    """A key column and its values, on the driver."""
    key, *values = table.toArrow().columns
    return [key.to_numpy().view(np.uint64), *(v.to_numpy() for v in values)]


def _corrector(head, name: str, n_models: int):
    def correct(batches):
        totals = held("words", "totals", name, lambda: Totals(*head.value))
        for batch in batches:
            w, h = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            n = [batch.column(2 + k).to_numpy() for k in range(n_models)]
            both, at_w, at_h = totals.find(w, h)
            other = np.ones(len(w), bool)
            other[both] = False
            more = n[0][both] > 1
            both, at_w, at_h = both[more], at_w[more], at_h[more]
            p = lambda k, count: totals.log_prob(k, at_w, at_h, count)  # noqa: B023, E731
            add = [p(0, n[0][both]) - p(0, 1)] + [p(k, n[k][both]) - p(k, c) for k in range(1, n_models) for c in (0, 1)]
            other = np.flatnonzero(other)
            at = np.append(both, other)
            held_back = np.append(np.ones(len(both), bool), np.zeros(len(other), bool))
            key = word_pair_key(w[both], h[both])
            adds = [pa.array(np.append(a, np.zeros(len(other))).astype(np.float32), mask=~held_back) for a in add]
            rest = [pa.array(x[at], mask=held_back) for x in (signed(w), signed(h), *n[1:])]
            yield pa.record_batch([pa.array(np.append(signed(key), np.zeros(len(other), np.int64)), mask=~held_back), pa.array(n[0][at]), *adds, *rest], names=["key", "total", *_added(n_models), "w", "h", *(f"n{k}" for k in range(1, n_models))])

    return correct


def _added(n_models: int) -> list[str]:
    """What a row adds in the first model, and in each other one to texts outside and inside it."""
    return ["d0", *(f"{c}{k}" for k in range(1, n_models) for c in ("out", "in"))]


def pair_model(counts: DataFrame, head_limit: int = HEAD_LIMIT, max_totals: int = MAX_TOTALS) -> tuple[DataFrame, tuple]:
    """(key, total, d0, out1, in1, ...) of saved ``pair_counts``, which it reads no more, and the arguments of ``Totals`` of its frequent words and histories.

    A pair of two of these adds to its log probability as of one occurrence, which a text of
    model k holds there and another text does not; it has no row if it stands once.  Other pairs add all of theirs.
    All models have one vocabulary: the words of the corpus and one unknown word.
    """
    spark = counts.sparkSession
    models = range(sum(c[0] == "n" for c in counts.columns))
    pairs = counts.agg(*(x for k in models for x in _times(F.col(f"n{k}"), f"n{k}"))).first()
    upper = [_discounts(*(pairs[f"n{k}_{j}"] for j in (1, 2, 3, 4))) for k in models]
    histories = counts.groupBy("h").agg(*(x for k in models for x in (F.sum(f"n{k}").alias(f"all{k}"), *_times(F.col(f"n{k}"), f"n{k}", 2))))
    held_back = lambda k: sum(d * F.col(f"n{k}_{j}") for d, j in zip(upper[k], (1, 2, "more"), strict=True))
    share = [F.when(F.col(f"all{k}") > 0, 1 / F.col(f"all{k}")).otherwise(0.0).cast("float").alias(f"share{k}") for k in models]
    back = [F.when(F.col(f"all{k}") > 0, held_back(k) / F.col(f"all{k}")).otherwise(1.0).cast("float").alias(f"back{k}") for k in models]
    histories = saved(histories.select("h", F.col("all0").alias("total"), *share, *back), "history-totals")
    words = saved(counts.groupBy("w").agg(*(F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"c{k}") for k in models)), "word-totals")
    settled(spark)
    sums = words.agg(F.count("*").alias("words"), *(x for k in models for x in (F.sum(f"c{k}").alias(f"all{k}"), *_times(F.col(f"c{k}"), f"c{k}")))).first()
    vocabulary = sums["words"] + 1
    low = []
    for k in models:
        lower, total = _discounts(*(sums[f"c{k}_{j}"] for j in (1, 2, 3, 4))), sums[f"all{k}"]
        spare = sum(d * sums[f"c{k}_{j}"] for d, j in zip(lower, (1, 2, "more"), strict=True)) / vocabulary
        low.append(((_discounted(F.col(f"c{k}"), lower) + F.lit(spare)) / F.lit(float(total)) if total else F.lit(1.0 / vocabulary)).cast("float").alias(f"low{k}"))
    words = words.select("w", F.col("c0").alias("total"), *low)
    heads = [_arrays(t.where(F.col("total") >= frequent(t, head_limit)).drop("total")) for t in (words, histories)]
    head = spark.sparkContext.broadcast((*heads, upper))
    names = _added(len(models))
    schema = "key bigint, total bigint, " + ", ".join(f"{c} float" for c in names) + ", w bigint, h bigint" + "".join(f", n{k} bigint" for k in models[1:])
    found = saved(counts.mapInArrow(_corrector(head, f"{spark.sparkContext.applicationId}-{head._jbroadcast.id()}", len(models)), schema), "pair-corrections")
    rows = found.where("w is not null").withColumn("n0", F.col("total"))
    rows = rows.join(bounded_broadcast(words.drop("total"), max_totals), "w").join(bounded_broadcast(histories.drop("total"), max_totals), "h")
    p = [F.log(_discounted(F.col(f"n{k}"), upper[k]) * F.col(f"share{k}") + F.col(f"back{k}").cast("double") * F.col(f"low{k}")).cast("float") for k in models]
    adds = [p[0].alias("d0"), *(p[k].alias(f"{c}{k}") for k in models[1:] for c in ("out", "in"))]
    return found.where("w is null").select("key", "total", *names).union(rows.select(_word_pair_key().alias("key"), "total", *adds)), (*heads, upper)


def _word_counter(batches):
    parts, n = [], 0

    def flush():
        word, count = np.unique(np.concatenate(parts), return_counts=True)
        for lo in range(0, len(word), 100_000):
            yield pa.record_batch([pa.array(signed(word[lo : lo + 100_000])), pa.array(count[lo : lo + 100_000])], names=["key", "n"])

    for batch in batches:
        for _, data, offsets in slices(batch):
            parts.append(Words(data, offsets).hash)
            n += len(parts[-1])
            if n >= TASK_WORDS:
                yield from flush()
                parts, n = [], 0
    if n:
        yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, total) of all different words."""
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_word_counter, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("total"))


def frequency_lists(text: np.ndarray, key: np.ndarray, n: int) -> list[pa.Array]:
    """Two list columns for ``n`` texts: the different keys of each, and how often it has them."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    freq = np.diff(np.append(first, len(key)))
    off = pa.array(np.searchsorted(text[first], np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(off, pa.array(signed(key[first]))), pa.ListArray.from_arrays(off, pa.array(freq.astype(np.int32)))]


def _sum_head(totals, rows_, name: str, known: np.ndarray | None, n_models: int):
    def score(batches):
        table = held("words", "totals", name, lambda: Totals(*totals.value))
        key, *added = rows_.value
        lookup = held("words", "frequent", name, lambda: Lookup(key, np.arange(len(key))))
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=1 << 19):
                n, words = len(offsets) - 1, Words(data, offsets)
                text, before, row = words.texts(), words_before(words, known), rows.column(0).to_numpy()
                inside = [rows.column(3 + k).to_numpy(zero_copy_only=False).astype(bool) for k in range(n_models - 1)]
                both, at_w, at_h = table.find(words.hash, before)
                key_ = word_pair_key(words.hash, before)
                at = lookup.find(key_)
                found, tail = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                near, often, at = text[both], text[found], lookup.value[at[found]]
                sums = [np.bincount(near, table.log_prob(0, at_w, at_h, 1), n) + np.bincount(often, added[0][at], n)]
                for k, mark in enumerate(inside, 1):
                    once = table.log_prob(k, at_w, at_h, mark[near].astype(np.int64))
                    sums.append(np.bincount(near, once, n) + np.bincount(often, np.where(mark[often], added[2 * k][at], added[2 * k - 1][at]), n))
                # a row of each text, under a key of no pair, and a row of each word that is left
                whole = pa.StructArray.from_arrays([rows.column(1), pa.array(words.count), *(pa.array(m) for m in inside), *(pa.array(x.astype(np.float64)) for x in sums)], [f.name for f in _whole(n_models)])
                yield pa.record_batch([pa.array(row), pa.array(signed(mix(row.view(np.uint64)))), whole], names=["row", "key", "whole"])
                yield pa.record_batch([pa.array(row[text[tail]]), pa.array(signed(key_[tail])), pa.nulls(len(tail), whole.type)], names=["row", "key", "whole"])

    return score


def _whole(n_models: int) -> T.StructType:
    marks = [T.StructField(f"inside{k}", T.BooleanType()) for k in range(1, n_models)]
    sums = [T.StructField(f"s{k}", T.DoubleType()) for k in range(n_models)]
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), *marks, *sums])


def text_log_probs(docs: DataFrame, model: DataFrame, totals: tuple, known: np.ndarray | None = None, members: list[str] = (), head_limit: int = HEAD_LIMIT) -> DataFrame:
    """(doc_id, n_tokens, p0, ...): summed log probabilities of each row's words under a ``pair_model``.

    ``docs`` has a number of each ``row``, its bigint ``doc_id``, its ``text`` and the columns by which the pairs were counted.
    """
    sc = docs.sparkSession.sparkContext
    n = 1 + len(members)
    names = _added(n)
    least = frequent(model, head_limit)
    top, head = _arrays(model.where(F.col("total") >= least).select("key", *names)), sc.broadcast(totals)
    rows = sc.broadcast(top)
    whole = _whole(n)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("whole", whole)])
    docs = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"), *members)
    score = _sum_head(head, rows, f"{sc.applicationId}-{rows._jbroadcast.id()}", known, n)
    tail = model.where(F.col("total") < least).select("key", *names).hint("shuffle_hash")
    # a text's own row adds nothing, whatever its key is
    added = [F.sum(F.when(F.col("whole").isNull(), F.col(c))).alias(c) for c in names]
    more = [F.col("d0"), *(F.when(F.col(f"inside{k}"), F.col(f"in{k}")).otherwise(F.col(f"out{k}")) for k in range(1, n))]
    parts = TEXT_PARTS if model.count() > WHOLE_MODEL else 1
    out = []
    for part in range(parts):
        found = docs.where(F.col("row") % parts == part).mapInArrow(score, schema)
        sums = found.join(tail, "key", "left").groupBy("row").agg(*(F.max(f"whole.{f.name}").alias(f.name) for f in whole), *added)
        out.append(saved(sums.select("doc_id", "n_tokens", *((F.col(f"s{k}") + F.coalesce(m, F.lit(0.0))).alias(f"p{k}") for k, m in enumerate(more))), "text-sums"))
        if parts > 1:
            settled(docs.sparkSession)
    return reduce(DataFrame.union, out)

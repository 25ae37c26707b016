"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents hold at least ``threshold`` of a test item's distinct word
shingles, however long the document is?

Items are partitioned by the size of their shingle sets (powers of two).  An
item's sketch is its ``m`` least MinHash values, where ``m`` is fixed by the
partition: ``floor((1 - threshold) * largest size) + 1``.  A document that holds
``threshold`` of the shingles lacks fewer than ``m``, so it holds at least one
sketched value: the search is complete, for documents of any length, where
banded whole-document signatures would need thousands of permutations for a
20-shingle item in a 20,000-word text.  Documents that hit a sketch are
verified on the item's whole shingle set.

The sketches are broadcast in blocks of at most ``BLOCK_SHINGLES`` shingles, a
fixed size; a larger benchmark takes one narrow pass over the corpus for each
block.  Documents are not shuffled, neither to find items nor to cut rows.

Defined results for odd input: a null, empty or blank text has no shingles;
an item of 1 to 4 words is one shingle, found as that sequence of words;
rows with a null ``doc_id`` or ``item_id`` give no pair (``decontaminated`` judges rows
with a null ``doc_id`` too); equal items are one; rows that repeat a ``doc_id`` give a
pair each; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textvec import Words, mix, secret_key, signed, slices
from tessera.llm.token_counts import Lookup
from tessera.llm.worker import held

#: Shingles of the items that are broadcast at once (8 bytes each, and as much again for their sketches).
BLOCK_SHINGLES = 2_000_000

PAIR_SCHEMA = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_found bigint"


def _item_sets(shingle: int, key: int):
    """Distinct shingles of each item and the window length they were cut with."""

    def build(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = Words(data, offsets, lower=True, key=key)
                found, off = words.shingles(shingle)
                sets = [np.unique(found[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                length = np.full(len(sets), shingle, np.int32)
                for k in range(1, shingle):
                    short = np.flatnonzero(words.count == k)
                    if len(short):
                        own, o = words.shingles(k)
                        for t in short:
                            sets[t], length[t] = own[o[t] : o[t] + 1], k
                lists = pa.array([signed(s) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array(length), lists], names=["item_id", "window", "shingles"])

    return build


class SketchIndex:
    """Sketches of a block of items, by size partition, and their whole sets."""

    def __init__(self, item_id: np.ndarray, window: np.ndarray, sets: list[np.ndarray], key: int, threshold: float):
        self.item_id, self.sets, self.key = item_id, sets, key
        size = np.array([len(s) for s in sets], np.int64)
        partition = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.by_window: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        for w in np.unique(window):
            value, owner = [], []
            for p in np.unique(partition[window == w]):
                members = np.flatnonzero((window == w) & (partition == p))
                m = int(np.floor((1 - threshold) * size[members].max() + 1e-9)) + 1
                for i in members:
                    low = np.argsort(mix(sets[i]))[:m]  # the m least MinHash values
                    value.append(sets[i][low])
                    owner.append(np.full(len(low), i))
            value, owner = np.concatenate(value), np.concatenate(owner)
            order = np.argsort(value, kind="stable")
            uniq, first = np.unique(value[order], return_index=True)
            self.by_window[int(w)] = (Lookup(uniq, np.arange(len(uniq))), np.append(first, len(value)), owner[order])


def _index(name: str, block, threshold: float) -> SketchIndex:
    return held("decontamination", "index", name, lambda: SketchIndex(*block.value, threshold))


def _contained(index: SketchIndex, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(text, item, shingles found), sorted, of the texts of a slice."""
    words = Words(data, offsets, lower=True, key=index.key)
    pairs: list[tuple[int, int, int]] = []
    for window, (lookup, first, owner) in index.by_window.items():
        hashes, off = words.shingles(window)
        at = lookup.find(hashes)
        hit = np.flatnonzero(at >= 0)
        text = np.searchsorted(off, hit, "right") - 1
        touched = set(zip(text.tolist(), at[hit].tolist(), strict=True))
        held, last = np.zeros(0, np.uint64), -1
        for t, i in sorted({(t, int(i)) for t, h in touched for i in owner[first[h] : first[h + 1]]}):
            if t != last:
                held, last = np.unique(hashes[off[t] : off[t + 1]]), t
            n = int(np.isin(index.sets[i], held, assume_unique=True).sum())
            if n >= threshold * len(index.sets[i]) - 1e-9:
                pairs.append((t, i, n))
    return sorted(pairs)


def _search(name: str, block, threshold: float):
    def search(batches):
        index = _index(name, block, threshold)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                if pairs := _contained(index, data, offsets, threshold):
                    t, i, n = map(np.array, zip(*pairs, strict=True))
                    size = np.array([len(index.sets[k]) for k in i])
                    yield pa.record_batch([rows.column(0).cast(pa.int64()).take(pa.array(t)), pa.array(index.item_id[i]), pa.array(size), pa.array(n)], names=["doc_id", "item_id", "n_item_shingles", "n_found"])

    return search


def _without(name: str, block, threshold: float):
    """The rows of a batch that hold no item of the block."""

    def keep(batches):
        index = _index(name, block, threshold)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                clean = np.ones(rows.num_rows, bool)
                clean[[t for t, _, _ in _contained(index, data, offsets, threshold)]] = False
                yield rows.filter(pa.array(clean))

    return keep


def _blocks(spark, items: DataFrame, shingle: int):
    """(name, broadcast) of the items, in blocks of at most about ``BLOCK_SHINGLES`` shingles."""
    items = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # under a key of this call, so that no text can be written to collide with an item
    key = secret_key()
    sets = items.mapInArrow(_item_sets(shingle, key), "item_id bigint, window int, shingles array<bigint>").where(F.size("shingles") > 0).dropDuplicates(["item_id", "window", "shingles"])
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_SHINGLES)
    for b in range(n_blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toArrow()
        if rows.num_rows:
            content = (rows["item_id"].to_numpy(), rows["window"].to_numpy(), [np.array(s.values, dtype=np.int64).view(np.uint64) for s in rows["shingles"]], key)
            block = spark.sparkContext.broadcast(content)
            yield f"{spark.sparkContext.applicationId}-{block._jbroadcast.id() if block._jbroadcast is not None else id(block)}", block


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_found) with n_found >= threshold * n_item_shingles."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = [docs.mapInArrow(_search(name, block, threshold), PAIR_SCHEMA) for name, block in _blocks(spark, items, shingle)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], PAIR_SCHEMA)


def decontaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns as they were.

    Each row is judged by its own text, in the pass that reads it; nothing is shuffled.
    """
    names = docs.columns
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(docs[c] for c in names)).alias("r"))
    for name, block in _blocks(docs.sparkSession, items, shingle):
        rows = rows.mapInArrow(_without(name, block, threshold), rows.schema)
    return rows.select("r.*")

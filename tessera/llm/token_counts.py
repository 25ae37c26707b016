"""Token counts without token ids.

1. Every task collects the distinct pre-tokens of its texts; a shuffle by
   pre-token hash brings equal ones together, and the library's model counts
   the pieces of each distinct pre-token once.  Pre-tokens are told apart by
   their bytes: where two share a hash, that hash is marked, and the texts'
   own bytes are counted wherever it occurs.
2. The most frequent pre-tokens, at most ``head_limit`` of them, are broadcast
   as sorted arrays (12 bytes each).  That fixed bound covers the hot keys
   without moving a row for them.
3. All others are joined to the per-document frequencies by a shuffle, and
   the sums meet again per document.

Results equal the library's count of ids per text.  Texts in which a special
string occurs are counted by the library as they are.

Defined results for odd input: a null text is empty (0 tokens); a null or
repeated ``doc_id`` keeps its rows, one result row per input row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pretok import keys, worker_pieces
from tessera.llm.spill import saved
from tessera.llm.textvec import signed, slices
from tessera.llm.worker import held

#: Rows of the frequent pre-tokens that are broadcast, at most (12 MB).
HEAD_LIMIT = 1 << 20
#: Distinct pre-tokens that a task holds before it passes them on.
TASK_DISTINCT = 1 << 20


class Lookup:
    """Values by 64-bit key: a direct-mapped table before a binary search."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.bits = max(4, int(2 * len(key) + 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[(self.key >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(len(key))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is absent."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = self.table[(key >> np.uint64(64 - self.bits)).astype(np.int64)]
        odd = np.flatnonzero((at >= 0) & (self.key[at] != key))
        near = np.minimum(np.searchsorted(self.key, key[odd]), len(self.key) - 1)
        at[odd] = np.where(self.key[near] == key[odd], near, -1)
        return at


def _piece_rows(key: np.ndarray, piece: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(signed(key)), pa.array(piece, pa.binary()), pa.array(n)], names=["key", "piece", "n"])


def _distinct(batches):
    """Distinct pre-tokens of a task's texts: (key, piece, n).

    A pre-token whose key another one had first (its second key shows that) goes out by itself.
    """
    known: dict[int, int] = {}
    parts: list[tuple[np.ndarray, list[bytes]]] = []
    counts, checks = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)

    def flush():
        key = np.concatenate([p[0] for p in parts])
        piece = [b for p in parts for b in p[1]]
        for lo in range(0, len(key), 50_000):
            yield _piece_rows(key[lo : lo + 50_000], piece[lo : lo + 50_000], counts[lo : min(lo + 50_000, len(key))])

    for batch in batches:
        for _, data, offsets in slices(batch):
            start, end, _, key, check = keys(data, offsets)
            uniq, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            slot = np.fromiter((known.get(k, -1) for k in uniq.tolist()), np.int64, len(uniq))
            new = np.flatnonzero(slot < 0)
            slot[new] = len(known) + np.arange(len(new))
            known.update(zip(uniq[new].tolist(), slot[new].tolist(), strict=True))
            while len(known) > len(counts):
                counts, checks = (np.concatenate([x, np.zeros_like(x)]) for x in (counts, checks))
            raw, at = data.tobytes(), where[new]
            checks[slot[new]] = check[at]
            parts.append((uniq[new], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
            other = np.flatnonzero(checks[slot][inverse] != check)
            if len(other):
                yield _piece_rows(key[other], [raw[start[i] : end[i]] for i in other], np.ones(len(other), np.int64))
            counts[slot] += np.bincount(np.delete(inverse, other), minlength=len(uniq))
            if len(known) > TASK_DISTINCT:
                yield from flush()
                known, parts = {}, []
                counts[:] = 0
    if parts:
        yield from flush()


def _count_pieces(tokenizer_file: str):
    """Merge equal pre-tokens, which arrive as neighbours, and count the pieces of each once.

    A key that different pre-tokens share gets -1 pieces; its occurrences are counted one by one.
    """

    def rows(pieces, key, raw, n, shared):
        size = [-1 if k in shared else len(pieces.piece(r)) for k, r in zip(key, raw, strict=True)]
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["key", "pieces", "total"])

    def count(batches):
        pieces = worker_pieces(tokenizer_file)
        open_: tuple[int, bytes, int] | None = None  # the last key so far may go on in the next batch
        shared: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, piece = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1)
            shared.update(key[1:][(key[1:] == key[:-1]) & pc.not_equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)].tolist())
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            raw = piece.take(pa.array(first)).to_pylist()
            key, n = key[first].tolist(), np.add.reduceat(n, first).tolist()
            if open_ is not None:
                if key[0] == open_[0]:
                    if raw[0] != open_[1]:
                        shared.add(key[0])
                    n[0] += open_[2]
                else:
                    key, raw, n = [open_[0], *key], [open_[1], *raw], [open_[2], *n]
            open_ = (key[-1], raw[-1], n[-1])
            yield rows(pieces, key[:-1], raw[:-1], n[:-1], shared)
        if open_ is not None:
            yield rows(pieces, *([x] for x in open_), shared)

    return count


def piece_counts(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per distinct pre-token: key, pieces, total occurrences."""
    found = docs.select("text").mapInArrow(_distinct, "key bigint, piece binary, n bigint")
    return found.repartition(F.col("key")).sortWithinPartitions("key", "piece").mapInArrow(_count_pieces(tokenizer_file), "key bigint, pieces int, total bigint")


def frequent(table: DataFrame, limit: int) -> int:
    """The least total, a power of two, that at most ``limit`` rows reach."""
    sizes = {r["b"]: r["n"] for r in table.groupBy(F.floor(F.log2("total")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    b, rows = 63, 0
    while b > 0 and rows + sizes.get(b - 1, 0) <= limit:
        b -= 1
        rows += sizes.get(b, 0)
    return 1 << b


def _sum_head(tokenizer_file: str, head):
    def score(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        lookup, pieces = _worker_lookup(head), worker_pieces(tokenizer_file)
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=1 << 19):
                n = len(offsets) - 1
                start, end, count, key, _ = keys(data, offsets)
                text, raw = np.repeat(np.arange(n), count), data.tobytes()
                at = lookup.find(key)
                size = np.where(at >= 0, lookup.value[at], 0) if len(lookup.value) else np.zeros(len(key), np.int64)
                for i in np.flatnonzero(size < 0):
                    size[i] = len(pieces.piece(raw[start[i] : end[i]]))
                total = np.bincount(text, size, n).astype(np.int64)
                rest = at < 0
                text, key = text[rest], key[rest]
                special = pieces.special_texts(raw, offsets)
                for t in special:
                    total[t] = len(pieces.tokenizer.encode(raw[offsets[t] : offsets[t + 1]].decode("utf-8"), add_special_tokens=False).ids)
                if special:
                    text, key = text[keep := ~np.isin(text, list(special))], key[keep]
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                freq = np.diff(np.append(first, len(key)))
                off = pa.array(np.searchsorted(text[first], np.arange(n + 1)), pa.int32())
                yield pa.record_batch(
                    [pa.array(row + np.arange(n)), rows.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(total), pa.ListArray.from_arrays(off, pa.array(signed(key[first]))), pa.ListArray.from_arrays(off, pa.array(freq.astype(np.int32)))],
                    names=["row", "doc_id", "n_bytes", "head", "keys", "freqs"],
                )
                row += n

    return score


def _worker_lookup(head) -> Lookup:
    """The broadcast table, indexed once per Python worker."""
    key, value = head.value
    return held("tokens", "frequent", (len(key), int(key.sum()), int(value.sum())), lambda: Lookup(key, value))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) per row."""
    spark = docs.sparkSession
    table = saved(piece_counts(docs, tokenizer_file), "piece-counts")
    least = frequent(table, head_limit)
    top = table.where((F.col("total") >= least) | (F.col("pieces") < 0)).select("key", "pieces").toArrow()
    head = spark.sparkContext.broadcast((top["key"].to_numpy().view(np.uint64), top["pieces"].to_numpy()))
    sums = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sum_head(tokenizer_file, head), "row bigint, doc_id bigint, n_bytes bigint, head bigint, keys array<bigint>, freqs array<int>")
    sums = saved(sums, "token-sums")
    rare = sums.select("row", F.explode(F.arrays_zip("keys", "freqs")).alias("z")).select("row", F.col("z.keys").alias("key"), F.col("z.freqs").alias("n"))
    tail = rare.join(table.where((F.col("total") < least) & (F.col("pieces") >= 0)), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("tail"))
    n_tokens = F.col("head") + F.coalesce("tail", F.lit(0))
    return sums.select("row", "doc_id", "n_bytes", "head").join(tail, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))

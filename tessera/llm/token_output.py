"""Token ids as ORC: run-length encoded id lists, row indexes, Bloom filters.

``write_token_ids`` encodes every text and writes one ORC file per range of
document ids.  ORC's integer run-length encoding packs the ids, its row
indexes hold the id range of every stride of rows, and Bloom filters on
``doc_id`` let a point read skip stripes.  Stripes are read in parallel, and
a filter on ``doc_id`` is answered from file metadata first.

File columns: ``doc_id``; ``part`` (rank of the file in id order); ``local_start``
(ids before this document inside its file); ``n_tokens``; ``ids``.  A document's
global start is ``local_start`` plus the totals of the files before it, so no
task ever sees all rows, ids are encoded once, and the totals come from the two
number columns alone.

Defined results for odd input: a null text is an empty one (only the end id);
a null ``doc_id`` sorts first; rows that repeat a ``doc_id`` follow one another,
ordered by text; an empty table gives files without rows; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.pretok import worker_pieces
from tessera.llm.spill import bounded_broadcast, saved, shared_dir
from tessera.llm.textvec import slices

FILE_SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"

#: At most so many files' totals are broadcast.
BROADCAST_FILES = 1_000_000

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encoder(tokenizer_file: str, end_id: int):
    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces = worker_pieces(tokenizer_file)
        done = 0
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, off = pieces.encode(data, offsets)
                n = len(offsets) - 1
                out = np.insert(ids, off[1:], end_id)  # the end id after each text
                off = off + np.arange(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out.astype(np.int32, copy=False)))
                yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(done + off[:-1]), pa.array(np.diff(off)), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                done += int(off[-1])
        pa.default_memory_pool().release_unused()

    return encode


def encode_ids(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Rows of the file format, one Spark partition per range of ``doc_id``.

    Texts are dealt by range before they are encoded, so encoding runs once.
    The beginning of the text is part of the range, so that rows of one id can
    be spread.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_encoder(tokenizer_file, end_id), FILE_SCHEMA)


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> str:
    """Encode ``docs`` and write the ORC files below ``path``."""
    encode_ids(docs, tokenizer_file, end_id).write.options(**ORC_OPTIONS).orc(path)
    return path


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with their global ``start`` and ``n_tokens``."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("_total"))
    # one row per file, so this single window is as small as the file listing
    # that the driver holds in any case
    base = totals.select("part", F.coalesce(F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    base = bounded_broadcast(saved(base, "file-totals"), BROADCAST_FILES)
    return rows.join(base, "part").select("doc_id", (F.col("local_start") + F.col("_base")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column(3)
        if not len(ids):
            continue
        off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_id_digest(stored: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and crc32 of its ids."""
    return stored.mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Write to the shared folder, read the files back and digest them."""
    spark = docs.sparkSession
    path = write_token_ids(docs, f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}", tokenizer_file, end_id)
    return token_id_digest(read_token_ids(spark, path))

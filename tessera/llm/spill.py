"""Cutting lineage and sharing intermediate tables in the cluster's own folder.

Everything goes below the folder that ``spark.checkpoint.dir`` names, which
all executors and the driver share.  Only where a session on one machine has
none (tests, a laptop) a fresh local folder is taken; on a cluster that is an
error.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set up for ``checkpoint()`` too."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.getCheckpointDir() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Where the paths of saved tables are noted, if anyone wants them.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """The paths of all tables that are saved inside are put on the list."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def removed(spark: SparkSession, paths: list[str], reader: DataFrame) -> list[str]:
    """Delete the saved tables at ``paths`` but for those that ``reader`` still reads; returns these."""
    if not paths:
        return []
    used = {f.rpartition("/")[0] for f in reader.inputFiles()}
    bare = {re.sub(r"^file:/+", "/", f) for f in used}
    left = []
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.makeQualified(folder).toString() in used or re.sub(r"^file:/+", "/", path) in bare:
            left.append(path)
        else:
            store.delete(folder, True)
    return left


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside are deleted at its end, but for those that the one passed to the yielded function reads."""
    paths: list[str] = []
    readers: list[DataFrame] = []
    with noted(paths):
        yield lambda df: readers.append(df) or df
    left = removed(spark, paths, readers[0])
    if (outer := _noted.get()) is not None:
        outer.extend(left)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder, and read back.

    A lost executor then costs a re-read, not a recomputation, and every later
    use reads only the columns that it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _noted.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now.

    Spark deletes them when the driver's garbage is collected, which may be long
    after their last use; until then they lie beside those of the next step.  Python
    lets go of its objects in the JVM up to a second late, and what is finalized
    goes with the second collection only.
    """
    gc.collect()
    for seconds in (1.2, 0.4):
        time.sleep(seconds)
        spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (for small, iterated tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    Larger tables come back without the hint, so that the join shuffles.  The
    count is summed up in all tasks; a limit would gather rows in one.
    """
    return F.broadcast(df) if df.count() <= max_rows else df

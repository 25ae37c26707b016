"""Sinks for parsed documents: a run is visible only when it is whole.

A write goes to a folder of its own (an attempt) and counts for nothing until a
mark names it; a mark is one row in one small file, which appears at once or not at
all.  Readers start from the marks, so beside a writer that is at work, or has
failed, they see the run as it was.  Run ids are values of the marks and never
parts of a path, so "007" or "1e3" come back as they are.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A mark: which attempt is a run, how many rows it has, and when it was made (ns).
MARK = "run_id string, attempt string, n_rows bigint, made bigint"
#: Marks that are broadcast to find attempts (some 60 bytes each); more are joined by a shuffle.
MAX_MARKS = 100_000


def write_parsed(df: DataFrame, out: str, run_id: str) -> None:
    """Write the rows of ``df`` as the run ``run_id`` of the table in the folder ``out``.

    A run that is repeated replaces its own rows, once it is whole; other runs
    stay as they are.  A column ``run_id`` of ``df`` gives way to the run's id.
    """
    if run_id is None:
        raise ValueError("a run needs an id")
    spark, attempt = df.sparkSession, f"a{uuid.uuid4().hex}"
    folder = f"{out}/data/_attempt={attempt}"
    df.drop("run_id").write.parquet(folder)
    rows = spark.read.parquet(folder).count()  # from the files' footers; a file that is missing or cut fails here
    spark.createDataFrame([(str(run_id), attempt, rows, time.time_ns())], MARK).coalesce(1).write.mode("append").parquet(f"{out}/marks")


def runs(spark: SparkSession, out: str) -> DataFrame:
    """(run_id, attempt, n_rows) of every run: the attempt that was marked last."""
    marks = spark.read.schema(MARK).parquet(f"{out}/marks")
    last = marks.groupBy("run_id").agg(F.max_by(F.struct("attempt", "n_rows"), F.struct("made", "attempt")).alias("m"))
    return last.select("run_id", "m.*")


def read_parsed(spark: SparkSession, out: str, run_id: str | None = None) -> DataFrame:
    """Stored outcomes, of one run or of all; a run that was never marked has no rows."""
    known = runs(spark, out)
    if run_id is not None:
        found = known.where(F.col("run_id") == run_id).first()
        if found is not None:
            return spark.read.parquet(f"{out}/data/_attempt={found['attempt']}").withColumn("run_id", F.lit(run_id))
        known = known.where(F.lit(False))
    known = known.select("run_id", F.col("attempt").alias("_attempt"))
    rows = spark.read.option("mergeSchema", True).parquet(f"{out}/data")
    known = F.broadcast(known) if known.count() <= MAX_MARKS else known
    return rows.join(known, "_attempt").drop("_attempt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a fresh local one only on one machine where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="spark-shared-")).rstrip("/")

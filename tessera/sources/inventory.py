"""Path inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.resolve import ancestors


def path_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, parents) of every file below ``folder``; contents are not read.

    Only files are listed, so a folder counts as present if a file lies below
    it; an empty one does not show.  Spark lists files on the driver: for very
    large trees keep a stored listing and use ``with_parents`` on it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return with_parents(files.select("path", "length"))


def with_parents(listing: DataFrame) -> DataFrame:
    """A listing with (path, length) plus all folders above each path."""
    return listing.select("path", "length", ancestors(F.col("path")).alias("parents"))


def present_paths(inventory: DataFrame) -> DataFrame:
    """(path, is_dir) of every file and every folder that holds one."""
    folders = inventory.select(F.explode("parents").alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return inventory.select("path", F.lit(False).alias("is_dir")).union(folders)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framescan.session import ship_package, written_once

# what separates words in every operator here: space, tab, LF, VT, FF, CR
SPACES = "[\\x20\\x09-\\x0D]+"


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with this package shipped to its Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session without one (tests) gets a scratch folder, a cluster without
    one is refused.  The files survive lost executors and are removed by
    Spark's context cleaner where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    return written_once(df)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text as string, null as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def salted_rank(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 256) -> DataFrame:
    """0-based rank of each row within ``group``, in an order fixed by ``order``.

    A plain ``row_number`` sends a whole group to one task.  Here each group is
    cut into ``salts`` slices by a hash of ``order``; a slice is ranked by one
    task, and the slices' counts (one row a slice) give where each begins.
    Rows equal in ``order`` get different ranks in no set order.
    ``group`` columns must not be null.
    """
    d = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = d.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = W.partitionBy(*group, "_slice").orderBy(*order)
    ranked = d.withColumn("_rank", F.row_number().over(local) - 1)
    return ranked.join(starts, [*group, "_slice"]).withColumn(out, F.col("_start") + F.col("_rank")).drop("_slice", "_start", "_rank")


def range_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """0-based rank over all rows in the order of ``order`` (nulls last), without one task seeing them all:
    range partitions are ranked apart and begin at the sum of the counts before them."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    d = materialise(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = d.withColumn("_rank", F.row_number().over(W.partitionBy("_pid").orderBy(*keys)) - 1)
    return ranked.join(starts, "_pid").withColumn(out, F.col("_start") + F.col("_rank")).drop("_pid", "_start", "_rank")

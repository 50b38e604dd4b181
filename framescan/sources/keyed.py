"""Tables of one row a key that are kept up to date by batches: only the parts that a batch touches are read and written.

A key belongs to one of ``parts`` parts by its hash.  Batch ``n`` writes
``of=<parts>/version=<n>/part=<p>`` for the parts it touches, each with all of
its rows; the newest version of a part is the part.  The folder of a version
counts once Spark's own success mark is in it, so a batch that died leaves
nothing behind, and one that is run again reads what was there before it and
replaces itself: merging may add up, and the result is still exact.  Versions
that a later finished one has replaced are deleted, but for what the newest
batch would need to be run again: a part is stored twice at most, however many
batches there were.  A table has one writer; who reads it must be done before
the second batch after.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_once

PARTS = 64  # parts of a table; choose them so that one, read and written whole, holds some 100 MB
Merge = Callable[[DataFrame, list[str]], DataFrame]  # rows and what to group them by -> one row a group, of the same columns


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _hadoop(spark, path)
    return [e.getPath().getName() for e in fs.listStatus(folder)] if fs.exists(folder) else []


def _numbers(names: list[str], column: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{column}="))


def _base(spark: SparkSession, path: str, parts: int) -> str:
    others = [n for n in _numbers(_names(spark, path), "of") if n != parts]
    if others:
        raise ValueError(f"{path} is kept in {others[0]} parts, not in {parts}")
    return os.path.join(path, f"of={parts}")


def _stored(spark: SparkSession, base: str) -> dict[int, list[int]]:
    """Version -> its parts, for the finished versions: two folders a part at most."""
    found = {}
    for version in _numbers(_names(spark, base), "version"):
        names = _names(spark, os.path.join(base, f"version={version}"))
        if "_SUCCESS" in names:
            found[version] = _numbers(names, "part")
    return found


def part_of(keys: Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def touched(rows: DataFrame, keys: Sequence[str], parts: int = PARTS) -> list[int]:
    """The parts that the keys of ``rows`` are in: ``parts`` numbers at most come to the driver."""
    return [r[0] for r in rows.select(part_of(keys, parts).alias("p")).distinct().collect()]


def read_keyed(spark: SparkSession, path: str, schema: T.StructType | str, *, parts: int = PARTS, before: int | None = None,
               only: Sequence[int] | None = None) -> DataFrame:
    """The table (``before`` a batch), or ``only`` some of its parts; the other parts' files are not opened."""
    base = _base(spark, path, parts)
    newest: dict[int, int] = {}
    for version, held in _stored(spark, base).items():
        if before is None or version < before:
            newest |= dict.fromkeys(held, version)
    wanted = newest if only is None else {p: newest[p] for p in only if p in newest}
    folders = [os.path.join(base, f"version={v}", f"part={p}") for p, v in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_keyed(rows: DataFrame, path: str, keys: Sequence[str], merge: Merge, *, parts: int = PARTS, version: int | None = None) -> int:
    """Merge a batch of ``rows`` into the table as ``version`` (by default one
    more than the last); returns the version.

    The rows of one key are merged where they are before they are shuffled; a
    part is shuffled once to one task, which writes one file.  A key of NULLs is a key like any other."""
    spark, keys = rows.sparkSession, list(keys)
    base = _base(spark, path, parts)
    if version is None:
        version = max(_stored(spark, base), default=-1) + 1
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    batch = written_once(merge(rows, keys).select(*rows.columns))
    old = read_keyed(spark, path, schema, parts=parts, before=version, only=touched(batch, keys, parts))
    both = batch.unionByName(old).withColumn("part", part_of(keys, parts)).repartition("part")
    out = merge(both, ["part", *keys]).select(*rows.columns, "part")
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(os.path.join(base, f"version={version}"))
    _forget(spark, base, version)
    return version


def _forget(spark: SparkSession, base: str, version: int) -> None:
    """Delete the parts that a version before ``version`` has replaced, and versions that hold no part any more."""
    later: set[int] = set()
    for v, held in sorted(_stored(spark, base).items(), reverse=True):
        if v >= version:
            continue
        gone = held if later.issuperset(held) else [p for p in held if p in later]
        doomed = [f"version={v}"] if gone is held else [os.path.join(f"version={v}", f"part={p}") for p in gone]
        for name in doomed:
            folder, fs = _hadoop(spark, os.path.join(base, name))
            fs.delete(folder, True)
        later.update(held)

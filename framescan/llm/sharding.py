"""Sharding by extendible hashing, with DataFrame functions only.

A document's key is hashed to 60 bits.  A bucket is a prefix of the hash; all
documents begin in the empty prefix, and a bucket whose documents hold more
than ``limit`` bytes splits on its next bit, until every bucket fits.  The
directory is found from byte counts by prefix: a document's bucket is the
shortest prefix of its hash that fits.  Counts are taken for ``STEP`` bits at a
time, and only buckets still too large are counted on further bits.

Only (key, bytes, hash) and the directory are shuffled, never texts.

Edge cases: a null text has 0 bytes and a null key counts as the empty key; a
document larger than the limit cannot fit any shard and gets one of its own
(``overflow`` = its rank among those of its hash, from 1); documents that share
all 60 bits (rows that repeat a key) and exceed the limit together are dealt to
overflow shards of as many rows as surely fit; an empty table gives an empty
result; other columns pass through ``assign`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_of

BITS = 60
STEP = 12
LIMIT = 32 << 20


def hash_of(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a hash."""
    return F.call_function("shiftright", h, F.lit(BITS) - bits)


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directories by number of counted bits: cell (prefix of so many bits) -> depth, prefix, shard_bytes.

    ``sized``: n_bytes and h.  Depth is null for cells that the next directory covers.
    """
    out: list[tuple[int, DataFrame]] = []
    left = sized.where(F.col("n_bytes") <= limit).groupBy("h").agg(F.sum("n_bytes").alias("n_bytes"))
    for bits in range(STEP, BITS + 1, STEP):
        cells = left.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        depths = F.explode(F.sequence(F.lit(bits - STEP), F.lit(bits))).alias("depth")
        paths = materialise(cells).select("cell", "n_bytes", depths)
        paths = paths.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")))
        sums = paths.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
        fits = F.min(F.when(F.col("shard_bytes") <= limit, F.struct("depth", "prefix", "shard_bytes")))
        found = materialise(paths.join(sums, ["depth", "prefix"]).groupBy("cell").agg(fits.alias("leaf")).select("cell", "leaf.*"))
        out.append((bits, found))
        if bits == BITS or found.where("depth is null").isEmpty():
            break
        open_cells = found.where("depth is null").select("cell")
        left = left.withColumn("cell", _prefix(F.col("h"), bits)).join(open_cells, "cell", "left_semi").drop("cell")
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Documents that no prefix makes fit: shards of as many rows as surely fit, one at least."""
    same = W.partitionBy("_h")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("_bytes").over(same)))
    nth = F.row_number().over(same.orderBy("_bytes")) - 1
    dealt = rows.withColumn("_overflow", (F.floor(nth / per) + 1).cast("long"))
    shard = F.sum("_bytes").over(W.partitionBy("_h", "_overflow"))
    return dealt.select("row", "_bytes", F.lit(BITS).alias("depth"), F.col("_h").alias("prefix"), F.col("_overflow").alias("overflow"), shard.alias("shard_bytes"))


def _assigned(docs: DataFrame, limit: int, key: str) -> DataFrame:
    n_bytes = F.octet_length(text_of("text")).cast("long")
    sized = docs.select(n_bytes.alias("n_bytes"), hash_of(F.col(key)).alias("h"))
    tables = directory(sized, limit)
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), n_bytes.alias("_bytes"), hash_of(docs[key]).alias("_h"))
    large = left.where(F.col("_bytes") > limit)
    left = left.where(F.col("_bytes") <= limit)
    done = []
    for bits, table in tables:
        joined = left.withColumn("_cell", _prefix(F.col("_h"), bits)).join(table.withColumnRenamed("cell", "_cell"), "_cell")
        done.append(joined.where("depth is not null").select("row", "_bytes", "depth", "prefix", F.lit(0).cast("long").alias("overflow"), "shard_bytes"))
        left = joined.where("depth is null").select("row", "_bytes", "_h")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if len(tables) * STEP == BITS:
        out = out.unionByName(_overflow(left, limit))
    return out.unionByName(_overflow(large, limit))


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """The documents as a struct ``row`` with ``shard``, a name that says depth, prefix and overflow."""
    name = F.concat_ws("-", F.format_string("%02d", "depth"), F.format_string("%015x", "prefix"), F.col("overflow").cast("string"))
    return _assigned(docs, limit, key).select("row", name.alias("shard"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write every shard to a folder of its own below ``path``, as Parquet."""
    named = assign(docs, limit, key).select("row.*", F.col("shard").alias("_shard"))
    named.repartition("_shard").write.partitionBy("_shard").parquet(path)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, depth, prefix, overflow, shard_bytes."""
    narrow = docs.select("doc_id", "text")
    out = _assigned(narrow, limit, "doc_id")
    return out.select("row.doc_id", F.col("_bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "prefix", "overflow", "shard_bytes")


def sql(limit: int = LIMIT) -> str:
    """DuckDB SQL for the query; every document's hash is counted at every depth."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, row_number() OVER () AS r,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h
  FROM documents),
p AS (SELECT r, h, n_bytes, CAST(k AS INTEGER) AS depth, h >> ({BITS} - k) AS prefix FROM d, range({BITS + 1}) AS o(k) WHERE n_bytes <= {limit}),
s AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM p GROUP BY ALL),
leaf AS (SELECT r, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) WHERE shard_bytes <= {limit} GROUP BY r),
o AS (
  SELECT *, greatest(1, {limit} // greatest(1, max(n_bytes) OVER (PARTITION BY h, n_bytes > {limit}))) AS per,
    row_number() OVER (PARTITION BY h, n_bytes > {limit} ORDER BY n_bytes) - 1 AS nth
  FROM d WHERE r NOT IN (SELECT r FROM leaf)),
x AS (SELECT doc_id, n_bytes, h, CAST(nth // per + 1 AS BIGINT) AS overflow FROM o)
SELECT d.doc_id, d.n_bytes, leaf.depth, d.h >> ({BITS} - leaf.depth) AS prefix, CAST(0 AS BIGINT) AS overflow, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM d JOIN leaf USING (r) JOIN s ON s.depth = leaf.depth AND s.prefix = d.h >> ({BITS} - leaf.depth)
UNION ALL
SELECT doc_id, n_bytes, CAST({BITS} AS INTEGER), h, overflow, CAST(sum(n_bytes) OVER (PARTITION BY h, n_bytes > {limit}, overflow) AS BIGINT) FROM x"""

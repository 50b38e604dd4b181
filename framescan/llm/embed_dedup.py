"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale of their
own; ``e`` is the length of what quantisation took away.  For unit vectors x, y
with quantised x', y' the cosine differs from x'.y' by at most
e_x + e_y + e_x * e_y, so only pairs whose int8 product comes within that of
the threshold can reach it, and only those are computed again in double
precision.

Different vectors are dealt to blocks, and every pair of blocks is one task
(a tile): the two blocks' vectors are multiplied as matrices, a strip at a
time.  A tile returns, for each of its vectors that has a link, the number of
rows it links to and the least vector of its group in the tile, not its links;
groups are joined across tiles as connected components.  Equal vectors are one
row with a count, so a vector that fills a third of the table costs no more
than another.  Blocks hold an eighth of the different vectors, between 2,048
(``least_block``) and 65,536: each vector is sent to as many tiles as there are blocks.

All pairs are compared, so time grows with the square of the number of
different vectors; no exact method prunes vectors spread evenly over 64
dimensions at this threshold.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing and are components of their own; vectors of
different length link with nothing; a null vec_id has no links, no component
and is not kept; rows that repeat a vec_id are vectors each, and belong to one
component as they share the id.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session
from .components import components

STRIP = 1 << 22  # pairs held at once


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, lengths of the error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yield (i, j) index arrays of the linked rows of ``a`` and ``b`` (unit rows, double). ``same``: one block, i < j."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = (qa, sa, ea) if same else quantise(b)
    # products of int8 values are whole numbers, exact in float32 up to 2 ** 24
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    ia, ib = qa.astype(exact), qb.astype(exact).T.copy()
    rows = max(1, STRIP // max(1, len(b)))
    for i0 in range(0, len(a), rows):
        part = slice(i0, i0 + rows)
        product = ia[part] @ ib
        product *= sa[part, None].astype(exact)
        # the least product that may be a link, by column, with the strip's largest row error and room for rounding
        worst = ea[part].max()
        least = (threshold - worst - eb - worst * eb - 1e-5) / sb
        i, j = np.nonzero(product >= least.astype(exact)[None, :])
        i += i0
        if same:
            i, j = i[i < j], j[i < j]
        cos = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
        yield i[cos >= threshold], j[cos >= threshold]


def _group(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked indices the least label of their group, in place."""
    while len(i):
        li, lj = label[i], label[j]
        apart = li != lj
        if not apart.any():
            return
        i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label[:] = flat


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    first = np.array(table["first"])
    node, rows = np.array(table["node"]), np.array(table["n"])
    dims = np.array(table["dim"])
    v = table["v"].combine_chunks()
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), int(dims[0]))
    # lengths are taken of the largest component's multiple, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = table["t"][0].as_py() == table["u"][0].as_py()  # not: only rows of the first block are here
    order = np.argsort(~first, kind="stable")
    cut = int(first.sum())
    x, node, rows = x[order], node[order], rows[order]
    a, b = (x, x) if same else (x[:cut], x[cut:])
    shift = 0 if same else cut
    label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    for i, j in tile_links(a, b, threshold, same) if len(a) and len(b) else ():
        j = j + shift
        links += np.bincount(i, rows[j], len(node)).astype(np.int64) + np.bincount(j, rows[i], len(node)).astype(np.int64)
        _group(label, i, j)
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "least": node[label[some]]})


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", least_block: int = 2048) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    session(vectors)
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall("v", lambda c: c == 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & ~zero)
    different = usable.groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    reps = materialise(different.withColumn("node", F.monotonically_increasing_id()))
    count = reps.count()
    block_rows = min(65536, max(least_block, -(-count // 8)))
    blocks = max(1, -(-count // block_rows))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    tiled = reps.select("node", "n", "v", F.size("v").alias("dim"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    tiled = tiled.select("node", "n", "v", "dim", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), (F.col("own") <= F.col("other")).alias("first"))

    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, threshold)

    # a link's rows across tiles; the tile of a block with itself counts the block's own
    found = materialise(tiled.groupBy("t", "u", "dim").applyInArrow(tile, "node long, links long, least long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    shared = reps.groupBy("least_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    ids = reps.join(shared.select("least_id", F.col("a").alias("to")), "least_id").select(F.col("node").alias("a"), F.col("to").alias("b"))
    comp = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(ids))
    named = (
        reps.join(links, "node", "left").join(comp, "node", "left")
        .select("v", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_vector = named.join(least, "component").select("v", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return (
        rows.join(by_vector, "v", "left")
        .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )

"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words; a source's target is its share of
all sizes, at most ``ceiling`` times its own size (the excess goes to the
others by weight).  The mix takes every document of a source as often as the
target holds the source whole, and fits the rest of the budget exactly: the
source's documents are counted by length, most of the rest is handed out in
proportion to the counts, and a bounded knapsack over lengths (dynamic
programming on reachable sums) closes the gap.  Which documents of a length are
taken is set by a seeded hash of doc_id and text, so reruns agree.

Only counts by (source, length) reach a Python function, one source at a time:
a row for each different length, which is bounded by the longest document and
not by the number of documents.  No rows are sampled; no documents reach the
driver.

Edge cases: a null text has size 0; sources are ordered by code point with the
null source last, as a source of its own; a document of size 0 is never taken;
of rows that repeat a doc_id and text within a source as many are taken as the
budget holds (any of them); an empty table gives an empty result.  Columns other than doc_id,
text and source pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, range_rank, salted_rank, session, text_of, words_of

SEED = 20
SLICES = 256


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum is as large as possible, at most ``budget``.

    Lengths are different and positive.  All but what eight longest documents
    hold is handed out in proportion; what is left is filled exactly, by the
    largest sum that can be reached.
    """
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    take = np.zeros(len(size), np.int64)
    if total <= budget:
        take = have.copy()
    elif budget > 0:
        span = 8 * int(size[0])
        take = np.floor(have * (max(0, budget - span) / total)).astype(np.int64)
        gap = budget - int((take * size).sum())
        for i in range(len(size)):  # long ones first, until the gap is short enough to be searched
            if gap <= span:
                break
            more = min(int(have[i] - take[i]), (gap - span // 2) // int(size[i]))
            take[i] += more
            gap -= more * int(size[i])
        take += _knapsack(size, have - take, gap)
    out = np.empty_like(take)
    out[order] = take
    return out


def _knapsack(size: np.ndarray, have: np.ndarray, gap: int) -> np.ndarray:
    """Bounded knapsack: the largest sum up to ``gap``. Counts are cut into bundles of 1, 2, 4, ... documents."""
    took = np.zeros(len(size), np.int64)
    if gap <= 0:
        return took
    reach = np.zeros(gap + 1, bool)
    reach[0] = True
    by = np.full(gap + 1, -1, np.int64)  # the first bundle that reached a sum
    bundles: list[tuple[int, int]] = []
    for i in range(len(size)):
        left, n = min(int(have[i]), gap // int(size[i])), 1
        while left > 0 and not reach[gap]:
            n_now = min(n, left)
            w = n_now * int(size[i])
            new = reach[: gap + 1 - w] & ~reach[w:]
            by[w:][new] = len(bundles)
            reach[w:] |= new
            bundles.append((i, n_now))
            left -= n_now
            n *= 2
        if reach[gap]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = bundles[by[at]]
        took[i] += n
        at -= n * int(size[i])
    return took


def _targets(totals: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, capped, the excess reshared by weight."""
    ranked = range_rank(totals, ["source"], "_nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    s = materialise(ranked.withColumn("_w", weight))
    cap = F.col("source_size") * float(ceiling)
    total, w = s.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = (total or 0) / (w or 1.0), -1
    while True:  # the level only rises; each round caps at least one more source or ends
        over = cap <= F.lit(level) * F.col("_w")
        n, spent, free = s.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if n == capped or not free:
            break
        level, capped = (total - spent) / free, n
    return s.select("source", "source_size", F.least(cap, F.lit(float(level)) * F.col("_w")).alias("target"))


def _plan(sized: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """For every (source, size): source_size, target, epochs, and ``cut``: documents whose hash is at most it are taken once more, of those whose hash is the cut only ``ties`` where that is not null."""
    hist = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = _targets(totals, weights, ceiling)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        epochs = int(target // total) if total else 0
        pdf = pdf[["source", "size", "n", "source_size", "target"]].assign(epochs=epochs, extra=0)
        some = pdf["size"].to_numpy() > 0
        rest = int(np.floor(target - epochs * total))
        pdf.loc[some, "extra"] = fit_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], rest)
        return pdf

    fitted = materialise(
        hist.alias("h").join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
        .select("h.source", "h.size", "h.n", "t.source_size", "t.target")
        .groupBy("source")
        .applyInPandas(fit, "source string, size long, n long, source_size long, target double, epochs long, extra long")
    )
    # the cut hash of each (source, size) that is taken in part: first the slice of the hash range where it lies, then the row
    part = fitted.where("extra > 0 and extra < n").select("source", "size", "extra")
    sliced = sized.select("source", "size", "h", F.shiftright("h", 56).alias("slice"))
    at = [F.col("s.source").eqNullSafe(F.col("p.source")), F.col("s.size") == F.col("p.size")]
    upto = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = sliced.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    edge = (
        counts.alias("s").join(part.alias("p"), at)
        .where("s.upto >= p.extra and s.upto - s.n < p.extra")
        .select("s.source", "s.size", "s.slice", (F.col("p.extra") - (F.col("s.upto") - F.col("s.n"))).alias("nth"))
    )
    # rows with the same hash are one row with a count
    upto_h = W.partitionBy("source", "size").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    hashes = (
        sliced.alias("s").join(edge.alias("p"), [*at, F.col("s.slice") == F.col("p.slice")])
        .groupBy("s.source", "s.size", "s.h", "p.nth").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto_h))
    )
    cuts = hashes.where("upto >= nth and upto - n < nth").select("source", "size", F.col("h").alias("cut"), F.when(F.col("upto") > F.col("nth"), F.col("nth") - F.col("upto") + F.col("n")).alias("ties"))
    lowest, highest = F.lit(None).cast("long"), F.lit((1 << 63) - 1)
    cut = F.when(F.col("s.extra") == 0, lowest).when(F.col("s.extra") == F.col("s.n"), highest).otherwise(F.col("p.cut")).alias("cut")
    return materialise(fitted.alias("s").join(cuts.alias("p"), at, "left").select("s.source", "s.size", "s.source_size", "s.target", "s.epochs", cut, "p.ties"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.size(words_of(text_of("text"))).cast("long")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text_of("text")).alias("h"))


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    at = [F.col("r.source").eqNullSafe(F.col("q.source")), F.col("r.size") == F.col("q.size")]
    joined = rows.alias("r").join(plan.alias("q"), at).select("r.*", "q.source_size", "q.target", "q.epochs", "q.cut", "q.ties")
    copies = lambda more: (F.col("epochs") + F.when(more, 1).otherwise(0)).alias("copies")
    out = [*rows.columns, "source_size", "target"]
    if plan.where("ties is not null").isEmpty():
        return joined.select(*out, copies(F.col("h") <= F.col("cut")))
    # rows that cannot be told apart, of which only some are taken: numbered once, ranked in slices
    tied = F.coalesce((F.col("h") == F.col("cut")) & F.col("ties").isNotNull(), F.lit(False))
    numbered = materialise(joined.where(tied).withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("_id", F.monotonically_increasing_id()))
    ranked = salted_rank(numbered, ["_group", "size"], ["_id"], "_nth")
    return joined.where(~tied).select(*out, copies(F.col("h") <= F.col("cut"))).unionByName(ranked.select(*out, copies(F.col("_nth") < F.col("ties"))))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    session(docs)
    sized = materialise(_sized(docs, seed).select("doc_id", "source", "size", "h"))
    return _planned(sized, _plan(sized, weights, ceiling)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of ``docs``."""
    session(docs)
    sized = _sized(docs, seed)
    plan = _plan(materialise(sized.select("doc_id", "source", "size", "h")), weights, ceiling)
    return _planned(sized, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("nth")).select("row.*")

"""Gradient-boosted trees for a binary label, on binned features, fitted to rows that Spark holds.

A level of a tree is one pass: each task adds up the gradients of its rows by
node, feature and bin, Spark adds up the tasks, and the driver gets those sums
(nodes x features x bins, however many rows there are) and picks the cuts.
Gradients are whole multiples of 2**-24, so the trees do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BINS = 32
_UNIT = 2.0**24
FEW = 16  # the sums of so many tasks are added up by the driver


@dataclass
class BoostedTrees:
    """Trees of equal depth, each as (feature, threshold) a level-order node and a value a leaf."""

    bias: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def leaf_of(self, x: np.ndarray, tree: int = 0) -> np.ndarray:
        feature, threshold, _ = self.trees[tree]
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        return node - (2**self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for i, (_, _, leaf) in enumerate(self.trees):
            out += leaf[self.leaf_of(x, i)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def bin_edges(values: DataFrame, features: int) -> list[np.ndarray]:
    """Cuts of each feature: its exact quantiles, each once; ``values``: (feature, v, n), n rows having that value."""
    at = [i / BINS for i in range(1, BINS)]
    found = values.groupBy("feature", "v").agg(F.sum("n").alias("n")).groupBy("feature").agg(F.percentile("v", at, F.col("n")).alias("q"))
    edges = [np.zeros(0)] * features
    for r in found.collect():
        edges[r["feature"]] = np.unique(np.array(r["q"], np.float64))
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value, as bytes."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def bins_of(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def _sums(rows: DataFrame, recent: BoostedTrees, tree: BoostedTrees, features: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the rows by node of the level under ``tree``, feature and bin."""
    width = 2**tree.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, features, width * BINS), np.int64)
        for b in batches:
            x = bins_of(b.column(0), features)
            y, n, margin = (b.column(i).to_numpy() for i in (1, 2, 3))
            prob = 1 / (1 + np.exp(-(margin + recent.margin(x))))
            node = tree.leaf_of(x) * BINS
            for i, v in enumerate((prob - y, prob * (1 - prob))):
                v = np.rint(v * _UNIT) * n
                for j in range(features):
                    sums[i, j] += np.bincount(node + x[:, j], v, width * BINS).astype(np.int64)
        g, h = sums.reshape(2, -1)
        at = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at]), pa.array(h[at])], ["at", "g", "h"])

    found = rows.select("bins", "y", "n", "margin").mapInArrow(run, "at long, g long, h long")
    if tasks > FEW:
        # a fixed few tasks add up, so that the driver gets features x nodes x bins sums, however many rows
        found = found.repartition(8, "at").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    got = found.toArrow()
    at, g, h = (got.column(c).to_numpy() for c in ("at", "g", "h"))
    out = np.zeros((2, features * width * BINS), np.int64)
    np.add.at(out[0], at, g)
    np.add.at(out[1], at, h)
    g, h = out.reshape(2, features, width, BINS) / _UNIT
    return g, h


def fit_trees(rows: DataFrame, edges: list[np.ndarray], rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, written: int = 10) -> tuple[BoostedTrees, BoostedTrees]:
    """Newton boosting of the logistic loss; ``rows``: bins (a byte a feature), y (0 or 1), n (how many rows these are).

    Returns the trees over values and the same over bins.  The rows' margins are written down every ``written`` rounds."""
    ones, total = rows.agg(F.sum(F.col("n") * F.col("y")), F.sum("n")).first()
    p = float(np.clip((ones or 0) / (total or 1), 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    model, coded, recent = BoostedTrees(bias, depth), BoostedTrees(bias, depth), BoostedTrees(0.0, depth)
    if not total or ones in (0, total):
        return model, coded
    rows = rows.select("bins", F.col("y").cast("long").alias("y"), "n", F.lit(bias).alias("margin"))
    features, inner, tasks = len(edges), 2**depth - 1, rows.rdd.getNumPartitions()
    for i in range(rounds):
        if i and i % written == 0:
            rows = materialise(_with_margin(rows, recent, features))
            recent = BoostedTrees(0.0, depth)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            g, h = _sums(rows, recent, BoostedTrees(0.0, level, [(feature, cut, np.zeros(width))]), features, tasks)
            g, h = g.cumsum(axis=2), h.cumsum(axis=2)
            gain = g**2 / (h + ridge) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + ridge) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + ridge)
            for node in range(width):
                best = 0.0
                for j in np.flatnonzero([len(e) for e in edges]):
                    k = int(gain[j, node, : len(edges[j])].argmax())
                    if gain[j, node, k] > best + 1e-9:
                        best = gain[j, node, k]
                        feature[first + node], threshold[first + node], cut[first + node] = j, edges[j][k], k
        # the sums of the last level, cut, are those of the leaves
        leaf = np.zeros(2**depth)
        for node in range(2 ** (depth - 1)):
            at = 2 ** (depth - 1) - 1 + node
            j, k = feature[at], int(min(cut[at], BINS - 1))
            both = [(g[j, node, k], h[j, node, k]), (g[j, node, -1] - g[j, node, k], h[j, node, -1] - h[j, node, k])]
            leaf[2 * node : 2 * node + 2] = [-rate * a / (b + ridge) for a, b in both]
        model.trees.append((feature, threshold, leaf))
        coded.trees.append((feature, cut, leaf))
        recent.trees.append((feature, cut, leaf))
    return model, coded


def _with_margin(rows: DataFrame, recent: BoostedTrees, features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = b.column(3).to_numpy() + recent.margin(bins_of(b.column(0), features))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(margin)], ["bins", "y", "n", "margin"])

    return rows.select("bins", "y", "n", "margin").mapInArrow(run, "bins binary, y long, n long, margin double")

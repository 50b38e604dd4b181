"""Quality classifier: similarity-weighted votes of labelled latent-semantic vectors.

A text becomes a vector of term frequencies; its terms are pairs of
neighbouring character classes over the whole text, and pseudo-terms for words
that repeat one of the few words before them and for words seen before in the
text.  A truncated singular value decomposition of the labelled texts gives the
latent space.  The labelled vectors are broadcast, every document's cosine with
all of them is computed in blocks, and the ``neighbours`` nearest vote for
their label with a weight that grows with the cosine.

Bounds: at most ``per_label`` labelled texts of each label are used (the lowest
by a hash of doc_id, so the choice neither depends on order nor on the number
of machines), which bounds the matrix the driver decomposes (2 * per_label rows
of N_TERMS floats) and the broadcast (2 * per_label rows of ``rank`` floats).
The votes are scaled to the labels' true shares in the training rows.

Edge cases: a null text counts as empty; a text without any term (empty) gets
the training rows' share of label 1; labels other than 0 and 1, null labels and
null ids are not learned from; an id labelled twice counts once (its least
label); without training rows every score is 0.5.  Rows that repeat are scored
each; other columns are ignored whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session, text_of

_CLASSES = 38
_LAGS = 4
N_TERMS = _CLASSES * _CLASSES + _LAGS + 2


def _class_table() -> np.ndarray:
    """Byte -> character class: each letter its own whatever its case, with capitals, digits, spaces, marks and symbols apart."""
    t = np.full(256, 37, np.int32)
    for i in range(26):
        t[ord("a") + i] = i
        t[ord("A") + i] = 26
    for k, chars in enumerate((b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",", b"!?", b"#*$%&<>|^~=+_@\\/{}[]`", b"\"'()-:;")):
        for c in chars:
            t[c] = 27 + k
    t[0xC0:0x100] = 35
    t[0x80:0xC0] = 36
    return t


_TABLE = _class_table()


def text_terms(text: str) -> np.ndarray:
    """Frequencies of the terms of a whole text, square-rooted; zeros for the empty text."""
    out = np.zeros(N_TERMS, np.float32)
    raw = text.encode()
    if not raw:
        return out
    c = _TABLE[np.frombuffer(raw, np.uint8)]
    n = _CLASSES * _CLASSES
    if len(c) > 1:
        out[:n] = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=n)
    out[:n] /= len(c)
    words = raw.split()
    if words:
        for lag in range(1, _LAGS + 1):
            out[n + lag - 1] = sum(map(operator.eq, words[lag:], words)) / len(words)
        out[n + _LAGS] = 0.25 * (1 - len(set(words)) / len(words))
        out[n + _LAGS + 1] = 0.25 / len(words)
    return np.sqrt(out)


@dataclass
class VoteModel:
    mean: np.ndarray  # of the training rows' terms
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    votes: np.ndarray  # labelled rows: weight of the label's share
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, terms: np.ndarray) -> np.ndarray:
        x = (terms - self.mean) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), self.prior)
        some = np.flatnonzero(terms.any(axis=1))
        if not len(self.labels) or not len(some):
            return out
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(some), 512):
            rows = some[i : i + 512]
            cos = self.latent(terms[rows]) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.exp(20.0 * (np.take_along_axis(cos, near, axis=1).astype(np.float64) - 1)) * self.votes[near]
            out[rows] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit_votes(terms: np.ndarray, labels: np.ndarray, shares: tuple[float, float], rank: int = 48, neighbours: int = 25) -> VoteModel:
    """``shares``: the number of training rows of label 0 and of label 1."""
    prior = shares[1] / sum(shares) if sum(shares) else 0.5
    some = terms.any(axis=1) if len(terms) else np.zeros(0, bool)
    terms, labels = terms[some], labels[some].astype(np.float64)
    if not len(terms):
        return VoteModel(np.zeros(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), labels, prior, neighbours)
    mean = terms.mean(axis=0)
    x = (terms - mean).astype(np.float64)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)[:rank]].astype(np.float32)
    used = np.array([max(1, int((labels == y).sum())) for y in (0, 1)])
    model = VoteModel(mean, axes, np.zeros((0, 1)), (np.array(shares) / used)[labels.astype(int)], labels, prior, neighbours)
    model.vectors = model.latent(terms).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2048, rank: int = 48, neighbours: int = 25, label_col: str = "quality") -> VoteModel:
    """Learn from the labelled documents; ``labels`` holds the rows that may be learned from (doc_id, label)."""
    session(docs)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    known = materialise(known.join(docs.select("doc_id").distinct(), "doc_id"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    ids = {r["doc_id"]: r["y"] for c in chosen for r in c.collect()}  # 2 * per_label at most
    if not ids:
        return fit_votes(np.zeros((0, N_TERMS), np.float32), np.zeros(0), (0, 0), rank, neighbours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                terms = pa.array([text_terms(t.as_py()).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), terms], ["doc_id", "terms"])

    few = docs.sparkSession.createDataFrame([(k,) for k in sorted(ids)], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(F.broadcast(few), "doc_id")
    rows = texts.mapInArrow(run, "doc_id long, terms binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    terms = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows])
    return fit_votes(terms, np.array([ids[r["doc_id"]] for r in rows]), (shares.get(0, 0), shares.get(1, 0)), rank, neighbours)


def score(docs: DataFrame, model: VoteModel) -> DataFrame:
    """``docs`` as a struct column ``row`` with its ``score``."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(0.0).alias("score"), F.lit("").alias("_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = part.column(1)
                s = m.score(np.stack([text_terms(t.as_py()) for t in texts])) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of("text").alias("_text"))
    out = type(schema)([schema["row"], schema["score"]])
    return rows.mapInArrow(run, out)


def trainable(labels: DataFrame) -> DataFrame:
    """The label rows outside the held-out fold."""
    return labels.where(~held_out("doc_id"))


def held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. A null doc_id is not held out."""
    model = train(docs, trainable(labels), **params)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents the classifier does not reject, with their columns."""
    model = train(docs, trainable(labels), **params)
    return score(docs, model).where("score >= 0.5").select("row.*")

"""Packing documents into sequences of equal length by cutting-stock column generation.

Every document is tokenized whole and followed by an end id.  What is longer
than a sequence is cut into full sequences; the rest of each document is one
piece.  The pieces are counted by length in classes of ``unit`` tokens, each
piece counted as its class's longest; of those of at most ``SHORT`` tokens,
``unit`` pieces of one length make one item of that many units, so that short
pieces lose no room.  A linear program over patterns of
classes is solved by column generation, and the rounded patterns are handed to
the pieces by their rank within their class, so only the histogram of at most
``SHORT + length / unit`` classes reaches the driver.

Tokens are looked up by word: the tokenizer's normalisation and splitting never
look across white space, so the ids of a text are those of its words in turn.
Each Python worker keeps the ids of words it has met lately, in two generations
of about ``CACHE_WORDS``.

Edge cases: a null text counts as empty and gives the end id alone; texts of
any length are read whole; rows that repeat are packed each; an empty table
gives an empty result; columns other than doc_id and text are passed by.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, salted_rank, session, text_of
from .cutting import plan_bins

LENGTH = 2048
END_ID = 1
SHORT = 32  # tokens of a piece that is put together with others of its length
CACHE_WORDS = 400_000
MARKS = b".,!?;:*$%&#|"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# byte-level vocabularies spell a byte as the character of its number if that is a visible one of Latin-1, else as the next from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _plain_symbols(word: bytes) -> str | None:
    """A word of Latin letters only as its vocabulary symbols: normal, lower-case and one piece; None for any other word."""
    if word.isalpha():  # A-Z are lower-cased already, if no special token may be meant
        return word.decode() if word.islower() else None
    s = word.decode()
    if not s.isalpha() or max(s) >= "\u0250":
        return None
    s = s.lower()
    return s.encode().decode("latin-1").translate(_SPELLING) if s.isalpha() and max(s) < "\u0250" else None


class WordIds:
    """Token ids of whole texts, as unsigned 32-bit numbers, by way of their words."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, new: set[bytes]) -> None:
        """Add words to the cache. Marks at the end of a word are a piece of their own, so only what comes before them is looked up or encoded."""
        known = [w for w in new if w in self.old]
        self.ids.update((w, self.old.pop(w)) for w in known)
        new.difference_update(known)
        split = {}
        for w in new:
            stem = w.rstrip(MARKS)
            split[w] = (stem, w[len(stem) :]) if stem and stem != w and stem[-1:].isalnum() else (w, b"")
        parts = list({p for pair in split.values() for p in pair if p and p not in self.ids})
        others = []
        for p in parts:
            if (symbols := _plain_symbols(p)) is None:
                others.append(p)
            else:
                self.ids[p] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)
        self.ids.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, coded, strict=True))
        self.ids.update((w, self.ids[stem] + self.ids[tail]) for w, (stem, tail) in split.items() if tail)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            raw = text.encode()
            # the tokenizer lower-cases anyway; only the spelling of its special tokens must stay as it is
            split.append((raw if b"<|" in raw else raw.lower()).split())
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids = self.ids, {}
        new = set().union(*split).difference(self.ids)
        if new:
            self._learn(new)
        ids = self.ids.__getitem__
        return [b"".join(map(ids, words)) for words in split]


_WORD_IDS: dict[int, WordIds] = {}


def _word_ids(definition: str) -> WordIds:
    key = hash(definition)
    if key not in _WORD_IDS:
        _WORD_IDS[key] = WordIds(definition)
    return _WORD_IDS[key]


def pieces(docs: DataFrame, definition: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(definition)
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _word_ids(shared.value)
        for b in batches:
            rows: list[tuple] = []
            for i in range(0, b.num_rows, 128):
                few = b.slice(i, 128)
                for key, ids in zip(few.column(0).to_pylist(), coder.encode(few.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((key, start, len(part) // 4, zlib.crc32(part), total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, PIECES)


def _slots(histogram: dict[int, int], units: int) -> dict[int, list[tuple[int, int, int]]]:
    """For every class: (first rank, items a bin, first bin) of each run of bins that share a pattern."""
    out: dict[int, list[tuple[int, int, int]]] = {k: [] for k in histogram}
    given = dict.fromkeys(histogram, 0)
    first = 0
    sizes = np.array(sorted(k for k in histogram if k < units), np.int64)
    plan = plan_bins(sizes, np.array([histogram[int(k)] for k in sizes], np.int64), units)
    for pattern, uses in plan:
        for k, a in zip(sizes.tolist(), pattern.tolist(), strict=True):
            if a:
                out[k].append((given[k], a, first))
                given[k] += a * uses
        first += uses
    if units in histogram:
        out[units].append((0, 1, first))
    return out


class Items:
    """How pieces, known by group and rank inside it, make up the items that are packed. A group is a class of
    ``unit`` tokens, or, negative, the exact length of a short piece."""

    def __init__(self, pieces: dict[int, int], unit: int):
        self.unit = unit
        self.count: dict[int, int] = {k: n for k, n in pieces.items() if k > 0}
        self.bundles: dict[int, tuple[int, int, int]] = {}  # of a length: how many, first item, first item of those left
        for k, n in sorted(pieces.items()):
            if k < 0:
                size, whole = -k, n // unit
                first = self._add(size, whole)
                self.bundles[size] = (whole, first, self._add(-(-size // unit), n % unit))

    def _add(self, units: int, n: int) -> int:
        first = self.count.get(units, 0)
        if n:
            self.count[units] = first + n
        return first

    def of(self, group: int, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(units, rows, items) of a group's pieces."""
        if group > 0:
            yield group, np.arange(len(rank)), rank
            return
        whole, first, rest = self.bundles[-group]
        together = rank < whole * self.unit
        yield -group, np.flatnonzero(together), first + rank[together] // self.unit
        yield -(group // self.unit), np.flatnonzero(~together), rest + rank[~together] - whole * self.unit


def pack(docs: DataFrame, definition: str | None = None, length: int = LENGTH, unit: int = 8, end_id: int = END_ID) -> DataFrame:
    """One row a piece with its sequence_id and its offset there (gapless from 0)."""
    if length % unit:
        raise ValueError("unit must divide length")
    if definition is None:
        with open(tokenizer_path(), encoding="utf-8") as f:
            definition = f.read()
    short = F.col("length") <= min(SHORT, length // unit)
    group = F.when(short, -F.col("length")).otherwise(F.ceil(F.col("length") / unit)).cast("long")
    cut = materialise(pieces(docs, definition, length, end_id).withColumn("class", group))
    items = Items({r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}, unit)
    slots = _slots(items.count, length // unit)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = {k: np.array(v, np.int64).reshape(-1, 3) for k, v in slots.items()}
        for pdf in batches:
            sequence = np.zeros(len(pdf), np.int64)
            for group, rows in pdf.groupby("class").indices.items():
                for k, some, item in items.of(group, pdf["rank"].to_numpy()[rows]):
                    if len(some):
                        r = runs[k]
                        at = np.searchsorted(r[:, 0], item, side="right") - 1
                        sequence[rows[some]] = r[at, 2] + (item - r[at, 0]) // r[at, 1]
            yield pdf.drop(columns=["class", "rank"]).assign(sequence_id=sequence)

    key = F.coalesce("doc_id", F.lit(-1))
    ranked = salted_rank(cut.withColumn("_key", key), ["class"], ["_key", "start", "ids_crc32"], "rank").drop("_key")
    placed = ranked.select(*[c.split()[0] for c in PIECES.split(", ")], "class", "rank").mapInPandas(place, f"{PIECES}, sequence_id long")
    before = W.partitionBy("sequence_id").orderBy("doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))

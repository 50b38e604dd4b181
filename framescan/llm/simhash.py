"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check.

A text's fingerprint has a bit set where more than half of its word shingles'
hashes have it.  Two fingerprints within ``max_bits`` differing bits agree in
at least ``blocks - max_bits`` of their blocks, so they share a key made of
that many blocks; a join on these keys proposes pairs and the Hamming distance
is checked on each.

Only different fingerprints are joined; copies share one row.  A key with more
than ``bucket_rows`` fingerprints is not paired up: there, every fingerprint
lists itself and what single bit flips make of it, and the listed values are
grouped.  Two fingerprints within 2 bits meet in a listed value (each is within
1 bit of it) and fingerprints that meet are within 2 bits, so linking each to
the least of its group loses no link and adds none; the work is linear in the
size of the bucket.

Edge cases: a null text counts as empty; a text without words has fingerprint
zero, which links like any other; rows with equal doc_id are kept apart and
all returned; a null doc_id keeps its row, and the component's id is the least
doc_id that is not null (null if there is none).  An empty table gives an
empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, session, text_of
from .components import components

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long."""
    return _fingerprinted(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), shingle)


def _fingerprinted(d: DataFrame, shingle: int) -> DataFrame:
    """The last column, a text, replaced by its fingerprint ``fp``; the others are longs."""
    session(d)
    names = [*d.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.columns[-1]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names)

    return d.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _keys(fp: Column, max_bits: int, blocks: int) -> list[Column]:
    """A key for each choice of blocks that must agree: the fingerprint with all other blocks cleared."""
    width = -(-64 // blocks)
    masks = [((1 << min(64, (i + 1) * width)) - 1) ^ ((1 << (i * width)) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [reduce(lambda x, y: x | y, c) for c in combinations(masks, blocks - max_bits)]
    return [F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(chosen)]


def hamming_edges(fps: DataFrame, max_bits: int = 2, blocks: int = 4, bucket_rows: int = 32) -> DataFrame:
    """Edges (a, b) that connect all fingerprints linked by ``max_bits`` or fewer differing bits.

    ``fps`` has one row a distinct fingerprint, column ``fp``.  Every edge is a
    link; within a bucket of more than ``bucket_rows`` the edges are a star per
    shared neighbour, elsewhere all links.
    """
    if not 0 < max_bits <= 2 or blocks <= max_bits:
        raise ValueError("max_bits must be 1 or 2, and blocks larger")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # one row per (key, fingerprint); buckets with a single fingerprint propose nothing
    keyed = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), max_bits, blocks))).alias("key")).select("key.t", "key.k", "fp")
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialise(keyed.join(shared, ["t", "k"]).select("t", "k", "fp", "n"))
    few = member.where(F.col("n") <= bucket_rows)
    pairs = (
        few.select("t", "k", F.col("fp").alias("a"))
        .join(few.select("t", "k", F.col("fp").alias("b")), ["t", "k"])
        .where((F.col("b") < F.col("a")) & near)
        .select("a", "b")
    )
    # half a link away: with 2 bits, each end is within one flip of a common value; with 1 bit, one of the ends is itself the value
    flips = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    many = member.where(F.col("n") > bucket_rows).select("fp").distinct()
    listed = many.select(F.col("fp").alias("a"), F.explode(F.array(*[F.lit(x) for x in flips])).alias("x")).select("a", F.col("a").bitwiseXOR(F.col("x")).alias("v"), (F.col("x") == 0).alias("own"))
    if max_bits == 2:
        least = listed.groupBy("v").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = listed.join(least, "v")
    else:
        least = listed.where("own").select("v", F.col("a").alias("b"))
        stars = listed.where("not own").join(least, "v")
    return pairs.unionByName(stars.where((F.col("a") != F.col("b")) & near).select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    docs_fp = materialise(fingerprints(docs, shingle, id_col, text_col))
    fps = materialise(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    comp = components(hamming_edges(fps.select("fp"), max_bits, blocks))
    named = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return docs_fp.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 4) -> DataFrame:
    """The documents, one of each group: the least by doc_id (null last) and hash of the text.

    A row is known by its doc_id and text, so rows that repeat a doc_id with
    other texts, or have none, are told apart.  Of rows that repeat both one
    stays (any of them).
    """
    key = [F.col("doc_id").cast("long"), F.xxhash64(F.lit(SEED), text_of("text"))]
    found = _fingerprinted(docs.select(key[0].alias("doc_id"), key[1].alias("h"), text_of("text").alias("text")), shingle)
    rows = found.groupBy("fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("least")
    fps = materialise(rows.groupBy("fp").agg(least))
    comp = components(hamming_edges(fps.select("fp"), max_bits, blocks))
    named = fps.join(comp, fps["fp"] == comp["node"], "left").select("least", F.coalesce("component", "fp").alias("component"))
    keep = materialise(named.groupBy("component").agg(F.min("least").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h"), F.col("k.n").alias("_n")))
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key[0].alias("_doc_id"), key[1].alias("_text"))
    at = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))
    kept = d.join(keep.where("_n = 1"), at, "left_semi")
    more = keep.where("_n > 1")
    if not more.isEmpty():
        kept = kept.unionByName(d.join(more, at, "left_semi").dropDuplicates(["_doc_id", "_text"]))
    return kept.select("row.*")

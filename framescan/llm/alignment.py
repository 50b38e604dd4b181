"""Alignment of two tokenizers' tokens, over each different text once.

Copies of a text are counted first (a shuffle by the full text), so a text that
fills a third of the table is tokenized and aligned once.  Both tokenizers cut
a text at a single space between two other characters whatever stands around,
so the stretches between such spaces are aligned one by one, and each worker
remembers those it has met lately.  Byte offsets where tokens of both end cut a
stretch into groups; each stretch of bytes between neighbouring ends of either
kind is one link, an A token and a B token that share those bytes.

Links are counted by pair within blocks of texts, weighted by the texts'
copies, and the blocks' counts are added up over the corpus.  Each block then
gets the totals of just the pairs it holds, works out its texts' measures, and
these go to the documents by the text's SHA-256.

Edge cases: null and empty texts have no tokens, nor have texts whose A or B
tokens do not spell the text back (U+2581 in a text, which the piece vocabulary
reads as a space): all measures 0, ``groups`` empty; texts of any length are
aligned whole; rows that repeat, null or repeated doc_ids are a row each; the
spelling of special tokens is plain text; an empty table gives an empty result;
columns other than doc_id and text are passed by.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import _spelling
from .common import materialise, session, text_of

# a space between two other characters; Python counts more characters as spaces than either tokenizer
CUT = re.compile(r" (?=\S)(?<=\S )")
STRETCHES = 400_000  # remembered by a worker
REMEMBERED = 6_000_000  # characters in them
ROWS = 128
BLOCK_PAIRS = 1 << 18  # different pairs, text by text, after which a block of texts is closed
ALIGNED = "block long, digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Both tokenizers: ids of stretches and bytes of ids."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = _spelling()
        self.a_size = np.zeros(self.a.get_vocab_size(), np.int64)
        for s, i in self.a.get_vocab().items():
            self.a_size[i] = sum(c in byte for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        # a piece that goes on after a space would join two stretches; such a vocabulary is given whole texts
        self.cuts = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i))

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def split(self, text: str) -> list[str]:
        """The text in stretches, each without the space before it."""
        return CUT.split(text) if self.cuts else [text]


class Aligner:
    """Stretches met lately, with what their alignment gives."""

    def __init__(self, a: str, b: bytes):
        self.tokens = Tokens(a, b)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0  # characters
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.whole = np.zeros(0, bool)  # the tokens spell the stretch back
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # where each stretch's pairs begin

    def learn(self, new: list[str]) -> None:
        """Align stretches, all in one row of bytes behind one another."""
        t = self.tokens
        # what neither begins nor ends with a space is coded in one go, as the parts of one text
        plain = [s for s in new if t.cuts and not (s[:1].isspace() or s[-1:].isspace() or "▁" in s)]
        inner = " ".join(plain)
        a, b = (t.a_ids(" " + inner), t.b.encode(inner)) if plain else ([], [])
        if b"".join(map(t.b_bytes.__getitem__, b)) != (" " + inner if plain else "").encode():
            plain, a, b = [], [], []
        apart = sorted(set(new).difference(plain)) if len(plain) < len(new) else []
        new = plain + apart
        size = np.array([1 + len(s) if s.isascii() else 1 + len(s.encode()) for s in new], np.int64)
        whole = np.ones(len(new), bool)
        for i, s in enumerate(apart, len(plain)):
            alone = t.b.encode(s)
            whole[i] = b"".join(map(t.b_bytes.__getitem__, alone)) == (" " + s).encode()
            if whole[i]:
                a += t.a_ids(" " + s)
                b += alone
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        # ends of tokens, and of each link: every end of either kind
        ends_a, ends_b = np.cumsum(t.a_size[ids_a]), np.cumsum(t.b_size[ids_b])
        ends = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        until = np.cumsum(np.where(whole, size, 0))
        n_a, n_b, groups, links = (np.diff(np.searchsorted(e, until, "right"), prepend=0) for e in (ends_a, ends_b, common, ends))
        pairs = ids_a[link_a] * len(t.b_bytes) + ids_b[link_b]
        # text of the groups
        cut_a, cut_b = np.searchsorted(ends_a, common, "right").tolist(), np.searchsorted(ends_b, common, "right").tolist()
        said_a, said_b = list(map(str, a)), list(map(str, b))
        said, p, q = [], 0, 0
        for i, j in zip(cut_a, cut_b, strict=True):
            said.append((said_a[p] if i == p + 1 else ",".join(said_a[p:i])) + "|" + (said_b[q] if j == q + 1 else ",".join(said_b[q:j])))
            p, q = i, j
        upto = np.cumsum(groups).tolist()
        start = len(self.groups)
        self.held += sum(map(len, new))
        self.groups += [";".join(said[i:j]) for i, j in zip([0, *upto[:-1]], upto, strict=True)]
        self.at.update(zip(new, range(start, start + len(new)), strict=True))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, links], axis=1)])
        self.whole = np.concatenate([self.whole, whole])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])

    def align(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """For each text: its four counts, its groups as text, its different pairs and how often each links."""
        if len(self.at) > STRETCHES or self.held > REMEMBERED:
            self.clear()
        stretches = [self.tokens.split(t) for t in texts]
        new = list(set().union(*stretches).difference(self.at))
        if new:
            self.learn(new)
        for parts in stretches:
            at = np.array(list(map(self.at.__getitem__, parts)), np.int64)
            if not self.whole[at].all():
                yield [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int32)
                continue
            n = self.first[at + 1] - self.first[at]
            # the pairs of each stretch in turn: its first, and one more for each step inside it
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs, times = np.unique(self.pairs[np.repeat(self.first[at], n) + inside], return_counts=True)
            yield self.counts[at].sum(axis=0).tolist(), ";".join(map(self.groups.__getitem__, at.tolist())), pairs, times.astype(np.int32)


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(given: tuple[str, bytes]) -> Aligner:
    key = hash(given)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*given)
    return _ALIGNERS[key]


def align_texts(texts: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each row (text, copies): its block, SHA-256, counts, ``groups`` as text (``a1,a2|b1;a3|b2,b3``), different pairs and their numbers."""
    a, b = paths or tokenizer_paths()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        given = (f.read(), g.read())
    shared = session(texts).sparkContext.broadcast(given)
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(shared.value)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                few = batch.slice(i, ROWS)
                rows = []
                for counts, groups, pairs, times in aligner.align(few.column("text").to_pylist()):
                    if held and held + len(pairs) > BLOCK_PAIRS:
                        block, held = block + 1, 0
                    held += len(pairs)
                    rows.append((block, *counts, groups, pairs.tobytes(), times.tobytes()))
                made = dict(zip([n for n in names if n not in ("digest", "copies")], zip(*rows, strict=True), strict=True))
                kind = {"groups": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
                columns = [few.column(n) if n in ("digest", "copies") else pa.array(made[n], kind.get(n, pa.int64())) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("text", "digest", "copies").mapInArrow(run, ALIGNED)


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair in each block of a batch, weighted by the texts' copies."""
    for b in batches:
        blocks = b.column("block").to_numpy()
        for block in np.unique(blocks).tolist():
            rows = b.take(pa.array(np.flatnonzero(blocks == block)))
            pairs = [np.frombuffer(p, np.int64) for p in rows.column("pairs").to_pylist()]
            weights = [np.frombuffer(t, np.int32).astype(np.int64) * c for t, c in zip(rows.column("times").to_pylist(), rows.column("copies").to_pylist(), strict=True)]
            pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
            if len(pair):
                links = np.zeros(len(pair), np.int64)
                np.add.at(links, at, np.concatenate(weights))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(links)], ["block", "pair", "links"])


def _text_measures(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
    """Measures of a block's texts from the totals of its pairs."""
    pair, at = np.unique(totals["pair"].to_numpy(), return_index=True)
    total, best = totals["total"].to_numpy()[at], totals["best"].to_numpy(zero_copy_only=False)[at]
    n_best, count_sum = [], []
    for p, t in zip(texts["pairs"].to_pylist(), texts["times"].to_pylist(), strict=True):
        where = np.searchsorted(pair, np.frombuffer(p, np.int64))
        times = np.frombuffer(t, np.int32).astype(np.int64)
        n_best.append(int(times[best[where]].sum()))
        count_sum.append(int((times * total[where]).sum()))
    return pa.table({"digest": texts["digest"], "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})


def pair_totals(counts: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): links of each pair over the corpus, and whether no pair of its B id has more."""
    totals = counts.groupBy("pair").agg(F.sum("links").alias("total"))
    same_b = W.partitionBy((F.col("pair") % width).alias("b"))  # as many rows as A has ids, at most
    return totals.withColumn("best", F.col("total") == F.max("total").over(same_b))


def alignment_measures(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = paths or tokenizer_paths()
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    different = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest)
    said = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    aligned = materialise(align_texts(different, paths).select("block", "digest", "copies", "n_a", "n_b", "n_groups", "n_links", said, "pairs", "times"))
    counts = aligned.select("block", "copies", "pairs", "times").mapInArrow(_block_counts, "block long, pair long, links long")
    wanted = counts.select("block", "pair").join(pair_totals(counts, width), "pair")
    found = aligned.select("block", "digest", "pairs", "times").groupBy("block").cogroup(wanted.groupBy("block"))
    per_text = found.applyInArrow(_text_measures, "digest binary, n_best long, count_sum long")
    measures = aligned.drop("block", "copies", "pairs", "times").join(per_text, "digest")
    known = rows.where("text <> ''").select("doc_id", digest.alias("digest")).join(measures, "digest").drop("digest")
    none = rows.where("text = ''").select("doc_id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    return known.select("doc_id", *MEASURES, "groups_sha256").unionByName(none)

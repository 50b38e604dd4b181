"""Language-model scoring of whole documents with a gated recurrent network.

Words are counted over all training documents.  The commonest ``softmax_words``
form head classes; every other word falls in a tail class by its spelling (its
last mark, its first letter beyond ASCII, its last letter), so words never seen
have a class too.  The network (see ``gru``) gives the class from the state
before a word, and the word within a head class; within a tail class a word has
the share (c + 1) / (N_k + V_k + 1) of the class's counts over all training
documents, so that the probabilities of the words counted and of one unseen
word a class sum to one.  A document's score is the sum of the logarithms over
all its words and its end, whatever its length: the state is carried from
window to window.

Counts, classes, shares and weights come from all training documents.  The
weights are learned by data-parallel truncated backpropagation: every training
document goes to one replica by hash, which passes once over its about
``replica_tokens`` tokens.  The replicas run in ``waves``: each wave starts
from the mean of the weights of the wave before.  Documents are coded once, as
one number a token.

Bounds: the driver and the workers hold the commonest words of up to
``MAX_BYTES`` bytes and their counts, fewer than ``head_words``; the counts of all other words stay
in Spark and are joined to the words of the documents by key.  Weights have a
fixed size.  Replicas' weights are averaged in groups of 16.  Copies of a row
are dealt evenly to all replicas, so that none holds them all.

Edge cases: a null text counts as empty: its end is its only token; a null
doc_id is not held out; rows that repeat are scored each; without training
documents every count is 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import materialise, session, text_of

MAX_BYTES = 64
END = b"\n"  # no word holds white space
N_TAIL = 96
_FLUSH = 200_000
_SLICE = 1 << 25  # bytes of texts taken to words at once


def held_out(col: str) -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 7 == 2, F.lit(False))


def words(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode().lower().split()


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of ``_SLICE`` bytes, or one longer text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + _SLICE, side="right")))
        yield texts.slice(start, end - start)
        start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, A-Z lower-cased; how many each text has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy(zero_copy_only=False)]))
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(before[offsets])


def tail_class(word: bytes) -> int:
    """A class from 0 to 95 by spelling alone."""
    last = word[-1:]
    mark = 1 if last in b".!?" else 2 if last in b",;:" else 0 if last.isalnum() or last >= b"\x80" else 3
    stem = word if mark == 0 else word[:-1]
    far = next((1 + word[i + 1] % 5 for i in range(len(word) - 1) if word[i] >= 0xC0), 0)
    return 24 * mark + 4 * far + (stem[-1] % 4 if stem else 0)


_MARKS = np.array([1 if c in b".!?" else 2 if c in b",;:" else 0 if bytes([c]).isalnum() or c >= 128 else 3 for c in range(256)])


def tail_classes(words_: pa.Array) -> np.ndarray:
    """``tail_class`` of each word, none of them empty."""
    words_ = pa.concat_arrays([words_.cast(pa.binary())])
    ends = np.cumsum(pc.binary_length(words_).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends):
        return ends
    start = np.frombuffer(words_.buffers()[1], np.int32)[words_.offset]
    data = np.frombuffer(words_.buffers()[2], np.uint8)[start : start + ends[-1]]
    last = data[ends - 1]
    mark = _MARKS[last]
    alone = np.diff(ends, prepend=0) == 1
    stem = np.where(mark == 0, last, np.where(alone, 0, data[np.maximum(ends - 2, 0)]))
    leads = np.flatnonzero(data >= 0xC0)
    owner = np.searchsorted(ends, leads, side="right")
    inside = leads + 1 < ends[owner]
    far = np.zeros(len(ends), np.int64)
    far[owner[inside][::-1]] = 1 + data[leads[inside][::-1] + 1] % 5  # the first of a word is written last
    return 24 * mark + 4 * far + stem % 4


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``docs``, with one end a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in slices(b.column(0)):
                found = split_words(texts)[0].value_counts()
                words_, n = found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([words_, n], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([len(texts)], pa.int64())], ["word", "n"])

    return docs.select(text_of("text").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Coded:
    """Tokens of several texts, one value each; ``far`` holds the words without an id."""

    lengths: np.ndarray
    ids: np.ndarray
    inp: np.ndarray
    cls: np.ndarray
    word: np.ndarray
    far: pa.Array

    def by_text(self, values: np.ndarray) -> list[np.ndarray]:
        """What belongs to each text, of one value a token."""
        ends = np.cumsum(self.lengths).tolist()
        return [values[a:b] for a, b in zip([0, *ends], ends)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum over its tokens."""
        return np.add.reduceat(values, np.cumsum(self.lengths) - self.lengths)

    def unheld(self) -> pa.Array:
        """For each text its words without an id, joined by spaces."""
        ends = np.cumsum(self.sums((self.ids < 0).astype(np.int32)), dtype=np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), self.far), " ")


@dataclass
class Vocabulary:
    """The head words by count; ids below ``shape.n_head * shape.per_class`` are softmax words, all have counts."""

    ids: dict[bytes, int]
    counts: np.ndarray
    tails: np.ndarray  # tail class of each id
    n_inputs: int  # words with an input row of their own; others share their tail class's
    shape: gru.Shape
    total: int = 0
    distinct: int = 0
    tail_total: np.ndarray | None = None  # N_k + V_k + 1 of each tail class

    def names(self) -> pa.Array:
        """The words by id."""
        return pa.array(list(self.ids), pa.binary()).cast(pa.string())

    def code(self, tokens: list[bytes], names: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(ids, -1 for words not held; inp, cls, word; the words not held)."""
        ids, tail, far = self._look_up(pa.array(tokens, pa.binary()).cast(pa.string()), names or self.names())
        return ids, *self._places(ids, tail), far.cast(pa.binary()).to_pylist()

    def _look_up(self, tokens: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids, tail classes, the words not held)."""
        found = pc.index_in(tokens, value_set=names)
        ids = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        far = tokens.filter(found.is_null())
        tail = self.tails[ids]
        tail[ids < 0] = tail_classes(far)
        return ids, tail, far

    def _places(self, ids: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inp, cls, word)."""
        own = (ids >= 0) & (ids < self.shape.n_head * self.shape.per_class)
        inp = np.where((ids >= 0) & (ids < self.n_inputs), ids, self.n_inputs + tail)
        cls = np.where(own, ids // self.shape.per_class, self.shape.n_head + tail)
        word = np.where(own, ids % self.shape.per_class, -1)
        return inp, cls, word

    def limit(self) -> int:
        """Ids from here on have no place of their own."""
        return max(self.shape.n_head * self.shape.per_class, self.n_inputs)

    def of_texts(self, texts: pa.Array, names: pa.Array) -> Coded:
        """The texts' tokens; ``names`` are the words by id."""
        flat, n = split_words(texts)
        is_word = np.ones(len(flat) + len(n), bool)
        is_word[np.cumsum(n + 1) - 1] = False
        ids, tail = np.zeros(len(is_word), np.int64), np.full(len(is_word), self.tails[0])  # the end's id is 0
        ids[is_word], tail[is_word], far = self._look_up(flat, names)
        return Coded(n + 1, ids, *self._places(ids, tail), far)

    def packed(self, texts: pa.Array, names: pa.Array) -> list[bytes]:
        """For each text one number a token: the id below the limit, the tail class above."""
        c = self.of_texts(texts, names)
        codes = np.where((c.ids >= 0) & (c.ids < self.limit()), c.ids, self.limit() + c.inp - self.n_inputs).astype(np.int32)
        return [part.tobytes() for part in c.by_text(codes)]

    def unpacked(self, data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inp, cls, word) of what ``packed`` returned for a text, or of its numbers; needs no words, and tails below the limit only."""
        p = (np.frombuffer(data, np.int32) if isinstance(data, bytes) else data).astype(np.int64)
        held = p < self.limit()
        return self._places(np.where(held, p, -1), np.where(held, self.tails[np.minimum(p, len(self.tails) - 1)], p - self.limit()))

    def width(self) -> type:
        """The numbers' least type."""
        return np.uint16 if self.limit() + N_TAIL <= 1 << 16 else np.int32


def _scale(n: Column) -> Column:
    """Counts on a logarithmic scale of 64 steps a doubling."""
    return F.floor(F.log2(n) * 64)


def least_step(counts: DataFrame, head_words: int) -> int:
    """The lowest step of the scale from which up there are fewer than ``head_words`` words; 4,096 steps at most reach the driver."""
    steps = counts.where(F.octet_length("word") <= MAX_BYTES).groupBy(_scale(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("k"))
    held = 0
    found = sorted(((r["step"], r["k"]) for r in steps.collect()), reverse=True)
    for step, k in found:
        held += k
        if held >= head_words:
            return step + 1
    return 0


def vocabulary(counts: DataFrame, step: int, softmax_words: int, input_words: int, per_class: int, hidden: int) -> Vocabulary:
    top = counts.where((_scale(F.col("n")) >= step) & (F.octet_length("word") <= MAX_BYTES) & (F.col("word") != END.decode()))
    head = top.toPandas().sort_values(["n", "word"], ascending=[False, True])
    end = counts.where(F.col("word") == END.decode()).agg(F.sum("n")).first()[0] or 0
    names = [END, *(w.encode() for w in head["word"])]
    n = np.concatenate([[end], head["n"].to_numpy(np.int64)]).astype(np.int64)
    n_head = softmax_words // per_class
    shape = gru.Shape(min(input_words, len(names)) + N_TAIL, n_head + N_TAIL, n_head, per_class, hidden)
    tails = np.array([tail_class(w) for w in names], np.int64)
    return Vocabulary({w: i for i, w in enumerate(names)}, n, tails, shape.n_inputs - N_TAIL, shape)


def _with_totals(v: Vocabulary, counts: DataFrame) -> Vocabulary:
    """Totals over all counts, and by tail class."""
    spark = counts.sparkSession
    softmax = v.shape.n_head * v.shape.per_class
    shared = spark.sparkContext.broadcast(v.names().slice(0, softmax))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = np.zeros(N_TAIL + 1, np.int64), np.zeros(N_TAIL + 1, np.int64)
        for b in batches:
            own = pc.is_in(b.column(0), value_set=shared.value).to_numpy(zero_copy_only=False)
            cls = np.where(own, N_TAIL, tail_classes(b.column(0)))
            np.add.at(n, cls, b.column(1).to_numpy(zero_copy_only=False))
            k += np.bincount(cls, minlength=N_TAIL + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_TAIL + 1)), pa.array(n), pa.array(k)], ["class", "n", "k"])

    sums = counts.mapInArrow(run, "class long, n long, k long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = np.zeros(N_TAIL + 1, np.int64), np.zeros(N_TAIL + 1, np.int64)
    for r in sums.collect():
        n[r["class"]], k[r["class"]] = r["n"], r["k"]
    v.total, v.distinct, v.tail_total = int(n.sum()), int(k.sum()), n[:N_TAIL] + k[:N_TAIL] + 1
    return v


def _first_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    softmax = v.shape.n_head * v.shape.per_class
    own = np.zeros(softmax)
    own[: min(softmax, len(v.counts))] = v.counts[:softmax] + 1
    classes = np.concatenate([own.reshape(v.shape.n_head, -1).sum(axis=1), v.tail_total])
    return gru.start(v.shape, classes, own)


def _average(rows: DataFrame) -> dict[str, np.ndarray] | None:
    """Mean of the replicas' weights, none without replicas; groups of 16 are summed in tasks until 16 rows at most are left for the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(b) for b in pdf.sort_values("replica")["weights"]]
        return pd.DataFrame({"replica": [int(pdf["replica"].min()) // 16], "n": [int(pdf["n"].sum())], "weights": [pickle.dumps({k: sum(p[k] for p in parts) for k in parts[0]})]})

    rows = materialise(rows)
    while rows.count() > 16:
        rows = materialise(rows.groupBy(F.floor(F.col("replica") / 16)).applyInPandas(add, "replica long, n long, weights binary"))
    found = sorted(rows.collect(), key=lambda r: r["replica"])
    if not found:
        return None
    n = sum(r["n"] for r in found)
    parts = [pickle.loads(r["weights"]) for r in found]
    return {k: (sum(p[k] for p in parts) / n).astype(np.float32) for k in parts[0]}


def _learner(shared: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One replica's pass over its texts."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab, weights = shared.value
        rows = pdf.sort_values(["h", "codes"])
        texts = [np.frombuffer(codes, vocab.width()) for codes in rows["codes"]]
        places = [x.astype(np.int32) for x in vocab.unpacked(np.arange(vocab.limit() + N_TAIL))]
        coded = [d for p, copies in zip(texts, rows["copies"], strict=True) for d in [tuple(x[p] for x in places)] * int(copies)]
        new = gru.train(weights, coded)
        return pd.DataFrame({"replica": [int(pdf["replica"].iloc[0])], "n": [1], "weights": [pickle.dumps(new)]})

    return learn


def dealt(docs: DataFrame, v: Vocabulary, replica_tokens: int, waves: int) -> DataFrame:
    """(replica, h, codes, copies): all of ``docs``, coded, each with the replica that learns from it."""
    replicas = max(waves, round(v.total / replica_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        names = vocab.names()
        for b in batches:
            i = 0
            for texts in slices(b.column(1)):
                codes = pa.array(vocab.packed(texts, names), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), codes], ["h", "codes"])
                i += len(texts)

    text = text_of("text")
    coded = docs.select(F.xxhash64(F.lit(11), F.col("doc_id"), text).alias("h"), text.alias("text")).mapInArrow(run, "h long, codes binary")
    # copies are one row with a count, shared out from the row's own replica on
    rows = coded.groupBy("h", "codes").agg(F.count(F.lit(1)).alias("n"))
    spread = rows.select("h", "codes", "n", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(replicas)) - 1)).alias("j"))
    copies = F.floor(F.col("n") / replicas) + F.when(F.col("j") < F.col("n") % replicas, 1).otherwise(0)
    replica = F.pmod(F.xxhash64(F.lit(13), "h") + F.col("j"), F.lit(replicas))
    return spread.select(replica.alias("replica"), "h", "codes", copies.cast("long").alias("copies"))


def narrow(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """The same rows, each number of ``codes`` in the vocabulary's least type: half the bytes to keep and to shuffle."""
    width = v.width()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(c, np.int32).astype(width).tobytes() for c in b.column("codes").to_pylist()]
            yield b.set_column(b.schema.get_field_index("codes"), "codes", pa.array(codes, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def fit(docs: DataFrame, v: Vocabulary, replica_tokens: int, waves: int) -> dict[str, np.ndarray]:
    """Weights learned from all training documents, each passed over once."""
    weights = _first_weights(v)
    if not v.total:
        return weights
    rows = materialise(narrow(dealt(docs, v, replica_tokens, waves), v))
    places = replace(v, ids={}, counts=v.counts[:0], tails=v.tails[: v.limit()])
    spark = docs.sparkSession
    for wave in range(waves):
        learn = _learner(spark.sparkContext.broadcast((places, weights)))
        own = rows.where(F.col("replica") % waves == wave)
        weights = _average(own.groupBy("replica").applyInPandas(learn, "replica long, n long, weights binary")) or weights
    return weights


def lm_scores(
    docs: DataFrame,
    head_words: int = 1 << 17,
    softmax_words: int = 2048,
    input_words: int = 4096,
    per_class: int = 32,
    hidden: int = 24,
    replica_tokens: int = 1_000_000,
    waves: int = 2,
) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    training = docs.where(~held_out("doc_id"))
    counts = materialise(word_counts(training))
    step = least_step(counts, head_words)
    v = _with_totals(vocabulary(counts, step, softmax_words, input_words, per_class, hidden), counts)
    weights = fit(training, v, replica_tokens, waves)
    shared = spark.sparkContext.broadcast((v, weights))
    fields = ["doc_id", "h", "n_tokens", "n_known", "base", "model", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w = shared.value
        log_count = np.log10(vocab.counts + 1.0)
        log_tail = np.log10(vocab.tail_total)
        softmax = vocab.shape.n_head * vocab.shape.per_class
        names = vocab.names()
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                coded, cols = [], []
                for texts in slices(part.column(2)):
                    c = vocab.of_texts(texts, names)
                    log = np.where(c.ids >= 0, log_count[c.ids], 0.0)
                    # within tail classes: counts of held words here, of the others by the join
                    tail = np.where(c.word < 0, log_tail[np.maximum(c.cls - vocab.shape.n_head, 0)], 0.0)
                    known = (c.ids >= 0) & (vocab.counts[c.ids] > 0)
                    cols.append((c.lengths, c.sums(known.astype(np.int64)), c.sums(log), c.sums(np.where(c.ids >= softmax, log, 0.0) - tail), c.unheld()))
                    coded += zip(*(c.by_text(x.astype(np.int32)) for x in (c.inp, c.cls, c.word)), strict=True)
                n, known, base, static = (np.concatenate(x) for x in list(zip(*cols, strict=True))[:4])
                model = gru.score(w, coded) / np.log(10) + static
                far = pa.chunked_array([c[4] for c in cols]).combine_chunks()
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                numbers = [pa.array(c, k) for c, k in zip((n, known, base, model), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, far], fields)

    # rows are known by id and text; rows that repeat both are alike and are counted
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    scored = materialise(keyed.mapInArrow(run, "doc_id long, h long, n_tokens long, n_known long, base double, model double, far string"))
    rare = counts.where((_scale(F.col("n")) < step) | (F.octet_length("word") > MAX_BYTES))
    far = scored.where(F.col("far") != "").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode(F.split("far", " ")).alias("word"))
    sums = far.join(rare, "word").groupBy("doc_id", "h").agg(F.sum(F.log10(F.col("n") + 1)).alias("far_log"), F.count(F.lit(1)).alias("far_known"))
    s = scored.drop("far").alias("s")
    t = sums.alias("t")
    same = F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.h") == F.col("t.h"))
    far_log = F.coalesce("t.far_log", F.lit(0.0))
    denominator = float(np.log10(v.total + v.distinct + 1))
    return s.join(t, same, "left").select(
        "s.doc_id",
        held_out("s.doc_id").alias("held_out"),
        "s.n_tokens",
        (F.col("s.n_known") + F.coalesce("t.far_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("s.base") + far_log - F.col("s.n_tokens") * denominator).alias("base_score"),
        (F.col("s.model") + far_log).alias("score"),
    )

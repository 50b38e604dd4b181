"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

**Lookahead.** Merges are applied in the order of their list, so what a later
byte can change runs leftwards only through ever later merges.  ``lookahead``
follows the list once and keeps for every token how many bytes, counted from
its first, can decide whether it stands there: a byte is decided by itself; the
merge (u, v) makes the fate of u, and of uv, hang on v behind it, and the fate
of v on what decides the u before it.  The largest such number is enough for
every text: a token that begins at p is settled once the bytes up to
p + lookahead are known (170 for the vocabulary used here).

**Encoding.** ``Encoder`` takes a text in parts of any size.  It cuts the parts
into words by the definition's pattern and keeps back what a further character
may change; a word too long to wait for is merged in a buffer, of which the
settled tokens are given out and the rest kept.  What it holds does not grow
with the text: one part, one buffer, and the ids of words met lately.

**Decoding.** ``Decoder`` takes ids in parts and gives text: bytes that do not
end a character wait for the next part; bytes that are no UTF-8 become U+FFFD.

The pattern's classes of characters come from a library of another Unicode
version; a character outside ASCII is classed by the definition's own splitter
the first time it is met, and where the classes differ a stand-in of the right
class takes its place while words are cut.

Edge cases: a null text counts as empty (no ids, an empty decoded text); texts
of any length are read whole; rows that repeat, null or repeated ids are coded
each for itself; the spelling of a special token in a text becomes its id, as
the definition says; ids that the definition does not know are left out when
decoding; an empty table gives an empty result; other columns are kept or
passed by, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, text_of

PART = 1 << 16  # characters or ids taken at once
HELD = 4096  # characters of one unfinished word before its settled tokens are given out
CACHE_WORDS = 300_000  # in each of two generations
CACHED_LENGTH = 64  # characters of a word worth remembering
ROWS = 128  # rows a returned batch

# fixed values: the pattern that the byte-level splitter applies, and its classes with one character that stands for each
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CLASSES = {r"\p{L}": "a", r"\p{N}": "1", r"[^\s\p{L}\p{N}]": "!", r"\s": "\n"}
SPACE = "\n"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spelling() -> dict[str, int]:
    """Byte of each character that vocabularies spell bytes with: visible ones of Latin-1 stand for themselves, others for the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes from a token's first that settle it, for merges (left, right, product) in order and the tokens' lengths."""
    reach = {t: 1 for t, n in length.items() if n == 1}
    for u, v, product in merges:
        if u not in reach or v not in reach:
            raise ValueError("a merge uses a token that no earlier merge makes")
        left, right = reach[u], reach[v]
        reach[v] = max(right, left - length[u])
        reach[u] = reach[product] = max(left, length[u] + right)
    return max(reach.values(), default=1)


class Vocabulary:
    """What a byte-level BPE definition says: bytes of ids, merges, special tokens, sufficient lookahead."""

    def __init__(self, definition: str):
        said = json.loads(definition)
        model, split = said["model"], said["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and said["normalizer"] is None and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError("only plain byte-level BPE definitions are coded here")
        byte = _spelling()
        self.bytes = {i: bytes(map(byte.__getitem__, s)) for s, i in model["vocab"].items()}
        self.first = {self.bytes[i][0]: i for i in self.bytes if len(self.bytes[i]) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        merges = [(ids[u], ids[v], ids[u + v]) for u, v in pairs]
        self.ranks = {(u, v): (rank, w) for rank, (u, v, w) in enumerate(merges)}
        self.lookahead = lookahead(merges, {i: len(b) for i, b in self.bytes.items()})
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of least rank first, the leftmost of equals."""
        ids = list(map(self.first.__getitem__, piece))
        n, ranks = len(ids), self.ranks
        heap = [(r[0], i, r[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (r := ranks.get(pair))]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, w = heapq.heappop(heap)
            j = after[i]
            # the pair may be gone: one of its two was merged before
            if ids[i] < 0 or j >= n or ranks.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue
            ids[i], ids[j] = w, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((w, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], w))):
                heapq.heappush(heap, (r[0], h, r[1]))
        return [t for t in ids if t >= 0]


class Words(dict):
    """Ids of words met lately, in two generations; others are merged when asked for."""

    def __init__(self, vocabulary: Vocabulary, older: dict[str, bytes] | None = None):
        self.vocabulary = vocabulary
        self.older = dict(older or {})

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or _numbers(self.vocabulary.merge(word.encode()))
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


class Coder:
    """A vocabulary with its splitter and the ids of words met lately; one for each Python worker."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(definition)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True)))) if self.vocabulary.special else None
        self.longest_special = max(map(len, self.vocabulary.special), default=0)
        # a special token may begin in the last characters, and the space before it be its own word or part of one
        self.kept_back = self.longest_special + 2
        self.words = regex.compile(PATTERN)
        self.runs = {stand_in: regex.compile(f"{c}*") for c, stand_in in CLASSES.items()}
        self._pieces = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        self._classed: set[str] = set()
        self._stand_ins: dict[int, str] = {}
        self.ids = Words(self.vocabulary)

    def _class_of(self, c: str) -> str:
        joined = (s for s in ("a", "1", "!") if len(self._pieces(s + c)) == 1)
        return next(joined, SPACE)

    def shadow(self, text: str) -> str:
        """The text, or one of its length whose characters the pattern classes as the definition's splitter does."""
        if text.isascii():
            return text
        for c in set(text).difference(self._classed):
            stand_in = self._class_of(c)
            if not self.runs[stand_in].fullmatch(c):
                self._stand_ins[ord(c)] = stand_in
            self._classed.add(c)
        return text.translate(self._stand_ins) if self._stand_ins else text

    def split(self, text: str) -> list[str]:
        shadow = self.shadow(text)
        if shadow is text:
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(shadow)]

    def code(self, words: list[str]) -> bytes:
        """Ids of whole words, as little-endian unsigned 32-bit numbers."""
        if len(self.ids) > CACHE_WORDS:
            self.ids = Words(self.vocabulary, self.ids)
        return b"".join(map(self.ids.__getitem__, words))


def _numbers(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of one text that comes in parts: ``feed`` gives those settled so far, ``finish`` the rest."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.text = ""  # not yet cut into words
        self.run: str | None = None  # class of a long word that is being read
        self.piece = b""  # its bytes whose tokens are not settled

    def feed(self, part: str) -> bytes:
        self.text += part
        out = []
        if self.coder.special:
            while (m := self.coder.special.search(self.text)) and m.start() + self.coder.longest_special <= len(self.text):
                out.append(self._special(m))
        out.append(self._advance())
        return b"".join(out)

    def finish(self) -> bytes:
        out = []
        while self.coder.special and (m := self.coder.special.search(self.text)):
            out.append(self._special(m))
        out.append(self._end())
        return b"".join(out)

    def _special(self, m: regex.Match) -> bytes:
        """What lies before a special token, and its id."""
        rest, self.text = self.text[m.end() :], self.text[: m.start()]
        ids = self._end() + _numbers([self.coder.vocabulary.special[m.group()]])
        self.text = rest
        return ids

    def _settled(self, ended: bool) -> bytes:
        """Tokens of the long word that no further byte can change; all of them where it has ended."""
        ids = self.coder.vocabulary.merge(self.piece)
        if ended:
            self.piece = b""
            return _numbers(ids)
        size, at, n = self.coder.vocabulary.bytes, 0, 0
        while n < len(ids) and at + self.coder.vocabulary.lookahead <= len(self.piece):
            at += len(size[ids[n]])
            n += 1
        self.piece = self.piece[at:]
        return _numbers(ids[:n])

    def _continue(self, last: bool) -> bytes:
        """Read on in a long word; at its end, or where the text ends, give out all of it."""
        end = self.coder.runs[self.run].match(self.coder.shadow(self.text)).end()
        known = len(self.text) if last else max(0, len(self.text) - self.coder.kept_back)
        ended = last or end <= known
        if not ended:
            end = known
        elif self.run == SPACE and end < len(self.text):
            end = max(0, end - 1)  # the last space goes with the word behind it
        self.piece += self.text[:end].encode()
        self.text = self.text[end:]
        if ended:
            self.run = None
        return self._settled(ended) if ended or len(self.piece) > HELD else b""

    def _advance(self) -> bytes:
        """Words that are sure to end; what is kept back may still change with the next part."""
        out = [self._continue(False)] if self.run else []
        known = len(self.text) - self.coder.kept_back
        if self.run or known <= 0:
            return b"".join(out)
        words = self.coder.split(self.text)
        end = len(self.text)
        while words and end > known:
            end -= len(words.pop())
        out.append(self.coder.code(words))
        self.text = self.text[end:]
        known = len(self.text) - self.coder.kept_back
        if known > HELD:
            # one word fills all but what is kept back; its class is that of its last character
            shadow = self.coder.shadow(self.text)
            self.run = next(s for s, run in self.coder.runs.items() if run.fullmatch(shadow[known - 1]))
            self.piece, self.text = self.text[:known].encode(), self.text[known:]
            out.append(self._settled(False))
        return b"".join(out)

    def _end(self) -> bytes:
        """Everything held, as the text (or what lies before a special token) ends here."""
        out = [self._continue(True)] if self.run else []
        out.append(self.coder.code(self.coder.split(self.text)))
        self.text = ""
        return b"".join(out)


class Decoder:
    """Text of ids that come in parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        get = self.bytes.get
        return self.state.decode(b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]), last)


def encode_text(coder: Coder, text: str) -> bytes:
    """Ids of a text, a part at a time where it is long."""
    if len(text) <= PART and not (coder.special and coder.special.search(text)):
        return coder.code(coder.split(text))
    encoder = Encoder(coder)
    ids = bytearray()
    for i in range(0, len(text), PART):
        ids += encoder.feed(text[i : i + PART])
    return bytes(ids + encoder.finish())


def decode_ids(vocabulary: Vocabulary, ids: bytes) -> str:
    decoder = Decoder(vocabulary)
    step = 4 * PART
    return "".join([decoder.feed(ids[i : i + step], i + step >= len(ids)) for i in range(0, len(ids), step)])


_CODERS: dict[int, Coder] = {}


def _coder(definition: str) -> Coder:
    key = hash(definition)
    if key not in _CODERS:
        _CODERS[key] = Coder(definition)
    return _CODERS[key]


def _definition(given: str | None) -> str:
    if given is None:
        with open(tokenizer_path(), encoding="utf-8") as f:
            given = f.read()
    Vocabulary(given)  # refused here, not in a task
    return given


def _replace(df: DataFrame, source: str, out: str, kind: str, change: Callable[[Coder, object], object], definition: str) -> DataFrame:
    """``df`` with the column ``out`` made of ``source`` by ``change``, a few rows at a time."""
    shared = session(df).sparkContext.broadcast(definition)
    names = [f"_{i}" for i in range(len(df.columns))]
    at = df.columns.index(source)
    schema = [f"{n} {t.dataType.simpleString()}" for n, t in zip(names, df.schema, strict=True)] + [f"_out {kind}"]
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                few = b.slice(i, ROWS)
                made = pa.array([change(coder, v) for v in few.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*few.columns, made], [*names, "_out"])

    done = df.toDF(*names).mapInArrow(run, ", ".join(schema))
    kept = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c != out]
    return done.select(*kept, F.col("_out").alias(out))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", definition: str | None = None) -> DataFrame:
    """``df`` with ``text_col`` replaced by ``out``: its ids as little-endian unsigned 32-bit numbers."""
    texts = df.withColumn(text_col, text_of(text_col))
    coded = _replace(texts, text_col, out, "binary", lambda coder, text: encode_text(coder, text), _definition(definition))
    return coded.drop(text_col) if text_col != out else coded


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", definition: str | None = None) -> DataFrame:
    """``df`` with the column ``out``: the text of the ids in ``ids_col``; null ids are none."""
    return _replace(df, ids_col, out, "string", lambda coder, ids: decode_ids(coder.vocabulary, ids or b""), _definition(definition))


def round_trip(docs: DataFrame, definition: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), definition=definition)
    return decode(coded, definition=definition).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )

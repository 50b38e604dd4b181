"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

Four kinds: email, ip, card, phone.  Base spans follow fixed patterns and are
always kept.  Beside them, generators with high recall propose spans that may
overlap: spelled-out and spaced mail and ip addresses, and every span of
consecutive digit groups with 7 to 19 digits, whatever numbers stand beside it.
Each proposal gets features of its format (digits,
groups, separators, checksum, ranges) and of its context (neighbouring
characters, naming words before it, digits around it); gradient-boosted trees
score it, and a proposal above its kind's threshold that touches no base span
of any kind becomes a span (the likeliest first, never two that overlap).

The trees are trained without hand-made labels, on all documents that have a
base span (``boosting`` passes over their examples in Spark): base spans and
re-spellings of them in their own context
(marker spelled out, country code dropped, other separators, another number
beside it) are positive; spoilt ones (failing checksum, numbers out of range,
digits dropped or added, the number beside it taken along) and proposals
elsewhere are negative.  The threshold of a kind is the lowest
score at which, over the documents held back for it, at least ``precision`` of
what passes is positive; a kind where none reaches it adds nothing.

Edge cases: a null text counts as empty; empty texts have no spans; whole texts
are read however long (every pattern is linear in the text); rows that repeat
are handled alike; a table without any base span adds nothing; columns other
than doc_id and text are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boosting import BoostedTrees, bin_edges, binned, bins_of, fit_trees
from .common import materialise, session, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that begins inside a run of digits would have begun with the run, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits]
    doubled = [2 * v - 9 * (v > 4) for v in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ is tried once: the local part is the run of its characters before it, down to the match before."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = low = m.end()
        else:
            low = at + 1
        at = text.find("@", end)
    return out


def _is_byte(digits: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


_SPELLED = re.compile(r"(?:\x20at\x20|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20?@\x20?)(?=[A-Za-z0-9])", re.I)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20dot\x20|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\.)[A-Za-z0-9-]+)+", re.I)
_SPELLED_IP = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:\x20?(?:[(\[{]\x20?(?:dot|\.)\x20?[)\]}]|dot|\.)\x20?[0-9]{1,3}){3})(?![0-9]))", re.I)
# groups of digits may be set apart by spaces of any width, dashes of any length, or the end of a line
_NUMBER = re.compile(r"[0-9](?:[\x20\t\r\n\xA0\u2002-\u200A\u202F\u2010-\u2015\u2212()./-]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_NAMED = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|e-?mail", r"\bip\b|host|server|address", r"card|visa|credit|pay|account|iban", r"tel|phone|call|fax|mobile|cell|whatsapp"))
N_FEATURES = 22


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap."""
    out: set[Span] = set()
    for m in _SPELLED.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _SPELLED_DOMAIN.match(text, m.end())):
            out.add((start, 0, d.end()))
    out.update((m.start(1), 1, m.end(1)) for m in _SPELLED_IP.finditer(text))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (s, _) in enumerate(groups):
            n = 0
            for first, e in groups[i : i + 19]:
                n += e - first
                if n > 19:
                    break
                if n >= 13:
                    out.add((s, 2, e))
                if 7 <= n <= 15:
                    out.add((s - (text[s - 1 : s] == "("), 3, e))
    return sorted(out)


def _apart(found: list[Span], spans: list[Span]) -> list[Span]:
    """Those of ``found`` that touch none of ``spans``."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    at = [bisect_left(starts, p[2]) for p in found]
    return [p for p, i in zip(found, at, strict=True) if not i or ends[i - 1] <= p[0]]


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits, groups = _digits(s), re.findall(r"[0-9]+", s)
    marks = re.findall(r"[^A-Za-z0-9]", s)
    before, after = text[max(0, start - 24) : start], text[end : end + 16]
    prev, nxt = before[-1:], after[:1]
    sizes = [len(g) for g in groups] or [0]
    labels = re.findall(r"[A-Za-z]+", s)
    return [
        kind,
        len(s),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[-1],
        len(set(marks)),
        len(marks),
        "(" in s,
        "-" in s,
        s.count("."),
        bool(digits) and luhn(digits),
        max((int(g) if len(g) < 6 else 1e6) for g in groups) if groups else 0,
        int(digits[0]) if digits else -1,
        prev.isalnum() or prev in ("+", ".", "-", "/", "$"),
        nxt.isalnum() or nxt in ("%", "/"),
        bool(_NAMED[kind].search(before)),
        len(_digits(before)) + len(_digits(after)),
        len(labels[-1]) if labels and kind == 0 else -1,
        "@" in s,
        len(re.findall(r"\bdot\b|\bat\b", s.lower())),
    ]


@dataclass
class SpanModel:
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    thresholds: tuple[float, ...] = (2.0, 2.0, 2.0, 2.0)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The proposals that pass, apart from base spans and from each other."""
        found = _apart(proposals(text), base)
        passed: list[tuple[float, Span]] = []
        for i in range(0, len(found), 4096):
            part = found[i : i + 4096]
            score = self.trees.probability(np.array([features(text, p) for p in part], np.float64))
            passed += [(-float(x), p) for x, p in zip(score, part, strict=True) if x >= self.thresholds[p[1]]]
        chosen: list[Span] = []  # by start; they are apart
        for _, p in sorted(passed):
            i = bisect_left(chosen, (p[2],))
            if not i or chosen[i - 1][2] <= p[0]:
                chosen.insert(i, p)
        return chosen

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


_WIDE = ("\xa0", "\u2013", "\u2011")  # a no-break space, two dashes


def _respelled(s: str, kind: int) -> list[tuple[str, int]]:
    """(spelling, label) of one base span: the same data written otherwise is positive, spoilt data negative."""
    d = _digits(s)
    if kind == 0:
        local, _, domain = s.partition("@")
        return [(f"{local} at {domain.replace('.', ' dot ')}", 1), (f"{local} (at) {domain.replace('.', ' (dot) ')}", 1), (f"{local}[at]{domain}", 1), (f"{local} at {domain.partition('.')[0]}", 0)]
    if kind == 1:
        p = s.split(".")
        p = [x.lstrip("0") or "0" for x in p]
        wrong = [[str(300 + int(p[0])), *p[1:]], [*p[:3], str(260 + int(p[3]))]]
        marks = (" dot ", "[.]", " . ", "(dot)", "[dot]")
        return [(m.join(p), 1) for m in marks] + [(m.join(w), 0) for w in wrong for m in (".", *marks)]
    if kind == 2:
        bad = d[:-1] + str((int(d[-1]) + 1 + int(d[0]) % 8) % 10)
        return [(" ".join(d[i : i + 4] for i in range(0, len(d), 4)), 1), (".".join(d[i : i + 4] for i in range(0, len(d), 4)), 1), *((m.join(d[i : i + 4] for i in range(0, len(d), 4)), 1) for m in _WIDE), ("/".join(d[i : i + 4] for i in range(0, len(d), 4)), 1), (bad, 0), ("-".join(bad[i : i + 4] for i in range(0, len(bad), 4)), 0)]
    local = d[-10:]
    return [(f"({local[:3]}) {local[3:6]}-{local[6:]}", 1), (f"{local[:3]}-{local[3:6]}-{local[6:]}", 1), (f"{local[:3]}.{local[3:6]}.{local[6:]}", 1), (f"{local[:3]} {local[3:6]} {local[6:]}", 1), *((f"{local[:3]}{m}{local[3:6]}{m}{local[6:]}", 1) for m in _WIDE), (d[:8], 0), (f"{d[:4]}-{d[4:6]}-{d[6:8]}", 0), (local, 0)]


def examples(text: str) -> tuple[list[list[float]], list[int]]:
    """Feature rows and labels of one text."""
    x: list[list[float]] = []
    y: list[int] = []
    base = base_spans(text)
    for start, kind, end in base:
        x.append(features(text, (start, kind, end)))
        y.append(1)
        head, tail = text[max(0, start - 40) : start], text[end : end + 40]
        for s, label in _respelled(text[start:end], kind):
            x.append(features(head + s + tail, (len(head), kind, len(head) + len(s))))
            y.append(label)
            if kind < 2 or not label:
                continue
            # beside another number: a year, or one written alike; both together, and parts of each, are neither
            year = str(1900 + int(_digits(s)[-3:]) % 150)
            for other in (year, s[::-1] if s[-1:].isdigit() and s[:1].isdigit() else year + year):
                for left, right in ((f"{other} ", ""), ("", f" {other}")):
                    near = head + left + s + right + tail
                    at = len(head) + len(left)
                    right_one = (at, kind, at + len(s))
                    wide = (len(head), kind, len(head) + len(left) + len(s) + len(right))
                    x += [features(near, right_one), features(near, wide)]
                    y += [1, 0]
                    cut = [p for p in proposals(near[wide[0] : wide[2]]) if p[1] == kind]
                    cut = [q for q in ((p[0] + wide[0], kind, p[2] + wide[0]) for p in cut) if q not in (right_one, wide)]
                    if cut:
                        x.append(features(near, cut[int(year) % len(cut)]))
                        y.append(0)
    for p in _apart(proposals(text), base):
        x.append(features(text, p))
        y.append(0)
    return x, y


def training_examples(docs: DataFrame) -> DataFrame:
    """(doc_id, held, kind, x, y): the examples of every document that has a base span, each once a document; ``held``: for the thresholds."""
    session(docs)
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # what every base span holds, so that other texts need not go to Python
    like = "@[A-Za-z0-9-]+\\.[A-Za-z0-9]|[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]|\\+[0-9]|([0-9][ -]?){14}"
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.float64()), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, y = examples(text.as_py())
                held = key * 2654435761 % 7 % 3 == 0
                for i in range(0, len(y), 4096):
                    part = x[i : i + 4096]
                    cols = [[key] * len(part), [held] * len(part), [r[0] for r in part], part, y[i : i + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "held", "kind", "x", "y"])

    found = d.where(F.col("text").rlike(like)).mapInArrow(run, "doc_id long, held boolean, kind int, x array<double>, y int")
    return found.withColumn("h", F.xxhash64("x", "y")).dropDuplicates(["doc_id", "h"]).drop("h")


def _features_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, v, n): how often a feature has a value."""
    for b in batches:
        x = _features_of(b.column(0))
        for j in range(N_FEATURES if len(x) else 0):
            v, n = np.unique(x[:, j], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(v), pa.int32()), pa.array(v), pa.array(n)], ["feature", "v", "n"])


def fit_spans(found: DataFrame, precision: float = 0.99, per_task: int = 100_000, rounds: int = 60) -> SpanModel:
    """Trees of all examples that are not held back, thresholds of all that are; ``found``: as ``training_examples`` gives them.

    ``per_task``: how many examples a task passes over at a time."""
    found = materialise(found)
    count = found.count()
    if not count:
        return SpanModel()
    tasks = -(-count // per_task)
    edges = bin_edges(found.where(~F.col("held")).select("x").mapInArrow(_counted, "feature int, v double, n long"), N_FEATURES)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = pa.array([r.tobytes() for r in binned(_features_of(b.column(3)), edges)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], bins], ["held", "kind", "y", "bins"])

    keys = ["held", "kind", "y", "bins"]
    coded = found.select("held", "kind", "y", "x").mapInArrow(code, "held boolean, kind int, y int, bins binary")
    # as many tasks as the examples need, whatever the shuffle had: training passes over them some two hundred times
    coded = materialise(coded.repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).coalesce(tasks))
    trees, over_bins = fit_trees(coded.where(~F.col("held")), edges, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = over_bins.probability(bins_of(b.column(3), N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s)], ["kind", "y", "n", "score"])

    scored = coded.where("held").select("kind", "y", "n", "bins").mapInArrow(score, "kind int, y int, n long, score double")
    return SpanModel(trees, _thresholds(scored, precision, tasks))


def _thresholds(scored: DataFrame, precision: float, tasks: int) -> tuple[float, ...]:
    """Each kind's lowest score at which, over all rows, what passes reaches ``precision``, ten rows at least; ties stand or fall together.

    Scores are dealt by ranges, and a range begins at the sums of those above it, so no task sees a whole kind."""
    each = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"))
    each = materialise(each.repartitionByRange(tasks, F.col("kind"), F.col("score").desc()).withColumn("_pid", F.spark_partition_id()))
    above = W.partitionBy("kind").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = each.groupBy("kind", "_pid").agg(F.sum("n").alias("_n"), F.sum("good").alias("_good"))
    parts = parts.select("kind", "_pid", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_n", "_good")])
    inside = W.partitionBy("kind", "_pid").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = each.join(parts, ["kind", "_pid"]).select("kind", "score", (F.col("_n") + F.sum("n").over(inside)).alias("n"), (F.col("_good") + F.sum("good").over(inside)).alias("good"))
    lowest = run.where((F.col("n") >= 10) & (F.col("good") / F.col("n") >= precision)).groupBy("kind").agg(F.min("score").alias("score"))
    chosen = {r["kind"]: max(0.5, r["score"]) for r in lowest.collect()}
    return tuple(float(chosen.get(k, 2.0)) for k in range(len(KINDS)))


def train(docs: DataFrame, precision: float = 0.99) -> SpanModel:
    """Learn from all documents that have a base span."""
    return fit_spans(training_examples(docs), precision)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every stretch covered by spans replaced by the names of their kinds."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, _, end = spans[i]
        kinds = {spans[i][1]}
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            kinds.add(spans[i][1])
            i += 1
        out += [text[at:start], "".join(f"<{KINDS[k].upper()}>" for k in sorted(kinds))]
        at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: SpanModel) -> DataFrame:
    """(row, redacted text, base counts, base_sha256, spans): ``row`` is the document as a struct."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of("text").alias("_text"))
    schema = rows.select("row").schema.add("redacted", "string")
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                cols: list[list] = [[] for _ in range(7)]
                for t in part.column(1):
                    text = t.as_py()
                    base, spans = m.spans(text)
                    n = [sum(s[1] == k for s in base) for k in range(4)]
                    values = [redact(text, spans), *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return rows.mapInArrow(run, schema)


def pii_spans(docs: DataFrame, **params) -> DataFrame:
    """One row a document: doc_id, counts of base spans by kind, digest of the base spans, all spans."""
    found = detect(docs.select("doc_id", "text"), train(docs, **params))
    return found.select("row.doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def redact_pii(docs: DataFrame, **params) -> DataFrame:
    """The documents with their spans replaced; a null text stays null; n_chars, if there, is the new length."""
    found = detect(docs, train(docs, **params))
    text = F.when(F.col("row.text").isNotNull(), F.col("redacted"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text").isNotNull(), F.length("redacted")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])

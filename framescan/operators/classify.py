"""Optional classifier stage: gate, classifier windows, content-hash cache,
classification of distinct misses only, cache upsert, score combination.

The classifier itself is a user function ``pandas.Series[str] ->
pandas.Series[str]`` (the model's raw answers).  It only ever sees the
*distinct* cache misses: ``dropDuplicates(hash)`` -> ``mapInPandas`` ->
join back, so a second run over the same content makes zero model calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_once
from ..sources.keyed import PARTS, read_keyed, touched, upsert_keyed
from .frames import strip_ws
from .rules import S2C

SHORT_CIRCUIT = 0.9
WINDOW_CHARS = 8000  # what the model sees at a time
OVERLAP_CHARS = 200
STEP_CHARS = WINDOW_CHARS - OVERLAP_CHARS
CACHE_TTL_S = 86_400
INSTRUCTION_SCORE = 0.85
DATA_SCORE = 0.05
# Classifier-prompt control sequences and their neutral
# replacements, applied in this order.
SANITISE = (
    (">>>", "[>][>][>]"),
    ("<<<", "[<][<][<]"),
    ("Answer:", "[answer-redacted]"),
    ("answer:", "[answer-redacted]"),
    ("ANSWER:", "[answer-redacted]"),
)

CACHE_SCHEMA = "content_hash string, classifier string, score double, cached_at timestamp, backend string"
Classifier = Callable[[pd.Series], pd.Series]


def gate(direction: Column, rule_score: Column, shape_note: Column, text: Column, enabled: bool = True) -> Column:
    """First matching note: disabled, c2s, rules short-circuit, shape note,
    else ``candidate``; texts of any length are candidates."""
    if not enabled:
        return F.lit("skipped:disabled")
    return (
        F.when(direction != S2C, "skipped:c2s")
        .when(rule_score >= SHORT_CIRCUIT, "skipped:rules_short_circuit")
        .when(shape_note != "candidate", shape_note)
        .otherwise("candidate")
    )


def classifier_input(text: Column) -> Column:
    """The whole text as windows of 8,000 characters that overlap by 200, with
    prompt control sequences neutralised: an array of at least one string."""
    clean = text
    for a, b in SANITISE:
        clean = F.replace(clean, F.lit(a), F.lit(b))
    last = F.greatest(F.lit(1), F.ceil((F.length(clean) - OVERLAP_CHARS) / STEP_CHARS)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(clean, (i * STEP_CHARS + 1).cast("int"), F.lit(WINDOW_CHARS)))


def blank(text: Column) -> Column:
    return strip_ws(text) == ""


def parse_label(answer: Column) -> Column:
    """First alphabetic token, upper-cased: INSTRUCTION* or INSTR ->
    INSTRUCTION, DATA* -> DATA, else NULL."""
    tok = F.upper(F.regexp_extract(answer, r"\p{L}+", 0))
    return F.when(tok.startswith("INSTRUCTION") | (tok == "INSTR"), "INSTRUCTION").when(tok.startswith("DATA"), "DATA")


def label_score(label: Column) -> Column:
    return F.when(label == "INSTRUCTION", INSTRUCTION_SCORE).when(label == "DATA", DATA_SCORE)


def cache_lookup(candidates: DataFrame, cache: DataFrame, now: Column, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """Left join on the content hash; a hit needs age <= TTL and a valid label.

    The cache holds one row per distinct content hash; the join is a plain
    equi-join and the optimiser picks broadcast or shuffle from its size."""
    fresh = cache.where(
        F.col("classifier").isin("DATA", "INSTRUCTION")
        & ((F.unix_micros(now) - F.unix_micros(F.col("cached_at"))) <= F.lit(ttl_s * 1_000_000))
    ).select(
        "content_hash",
        F.col("classifier").alias("cached_label"),
        F.col("score").alias("cached_score"),
    )
    return candidates.join(fresh, "content_hash", "left")


def classify_misses(misses: DataFrame, classifier: Classifier) -> DataFrame:
    """Classify each distinct missed hash once: ``content_hash, answer``."""
    distinct = misses.select("content_hash", "sample").dropDuplicates(["content_hash"])

    def one(sample):
        try:
            return classifier(pd.Series([sample])).iloc[0], None
        except Exception as exc:  # noqa: BLE001 - a failing model is an outcome of that text
            return None, f"error:{type(exc).__name__}"

    def run(batches):
        for pdf in batches:
            try:
                answers = [(a, None) for a in classifier(pdf["sample"])]
            except Exception:  # noqa: BLE001 - some text of the batch fails: each is asked alone
                answers = [one(s) for s in pdf["sample"]]
            yield pd.DataFrame({"content_hash": pdf["content_hash"], "answer": [a for a, _ in answers], "error": [e for _, e in answers]}, dtype=object)

    return distinct.mapInPandas(run, "content_hash string, answer string, error string")


def cache_upsert(cache: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace by hash, newest ``cached_at`` wins."""
    return newest(cache.select(*[c.split()[0] for c in CACHE_SCHEMA.split(", ")]).unionByName(new_rows))


def newest(rows: DataFrame, by: Sequence[str] = ("content_hash",)) -> DataFrame:
    """The newest cache row of each hash (``by``: the hash and what it decides)."""
    latest = rows.groupBy(*by).agg(F.max_by(F.struct("classifier", "score", "cached_at", "backend"), "cached_at").alias("r"))
    return latest.select(*by, "r.classifier", "r.score", "r.cached_at", "r.backend")


def store_labels(new_rows: DataFrame, path: str, *, parts: int = PARTS, version: int | None = None) -> int:
    """Put cache rows into the cache kept at ``path`` by parts of the hash: only the parts they fall in are read and written."""
    return upsert_keyed(new_rows, path, ["content_hash"], newest, parts=parts, version=version)


def stored_labels(spark: SparkSession, path: str, *, parts: int = PARTS, before: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The cache kept at ``path`` as ``run_classifier`` takes it: given the rows whose ``content_hash`` is looked for, the
    parts those can be in; other parts are not read."""
    return lambda wanted: read_keyed(spark, path, CACHE_SCHEMA, parts=parts, before=before, only=touched(wanted, ["content_hash"], parts))


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE_SCHEMA)


def run_classifier(
    rows: DataFrame,
    *,
    classifier: Classifier | None,
    cache: DataFrame | Callable[[DataFrame], DataFrame] | None,
    now: Column,
    backend: str = "user",
    ttl_s: int = CACHE_TTL_S,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply the classifier stage to inspected rows.

    ``rows`` needs ``direction, det_score (rule score), shape_note,
    result_text``.  Adds ``classifier_note, det_classifier,
    classifier_score, n_windows, n_unlabelled``; returns ``(rows, cache after
    this run, the cache rows this run adds)``.  ``cache`` may be a function from
    the hashes looked for to the rows that may hold them (``stored_labels``);
    the cache after this run is then that of the parts read.

    Rows and answers are written once, so the rules run once and the model sees
    each distinct missed window once.  Only candidates' texts are shuffled, one
    a distinct text.  A text is INSTRUCTION if any window is, DATA if all are;
    else it has no label."""
    spark = rows.sparkSession
    stored = cache if callable(cache) else None
    cache = empty_cache(spark) if cache is None or stored else cache
    g = gate(F.col("direction"), F.col("det_score"), F.col("shape_note"), F.col("result_text"), classifier is not None)
    nothing = {"det_classifier": "string", "classifier_score": "double", "n_windows": "long", "n_unlabelled": "long"}
    nulls = {c: F.lit(None).cast(t) for c, t in nothing.items()}
    if classifier is None:
        return rows.withColumns({"classifier_note": g, **nulls}), cache, empty_cache(spark)
    empty = blank(F.col("result_text"))
    note = F.when((g == "candidate") & empty, "skipped:empty").otherwise(g)
    rows = written_once(rows.withColumn("classifier_note", note).withColumn("_fs_text", F.when(note == "candidate", F.sha2("result_text", 256))))
    candidate = F.col("_fs_text").isNotNull()
    texts = rows.where(candidate).select("_fs_text", "result_text").dropDuplicates(["_fs_text"])
    windows = texts.select("_fs_text", F.explode(classifier_input(F.col("result_text"))).alias("sample"))
    windows = written_once(windows.withColumn("content_hash", F.sha2("sample", 256)))
    cache = stored(windows) if stored else cache
    looked = cache_lookup(windows.select("content_hash", "sample").dropDuplicates(["content_hash"]), cache, now, ttl_s)
    answers = written_once(classify_misses(looked.where(F.col("cached_label").isNull()), classifier))
    labels = looked.drop("sample").join(answers, "content_hash", "left").withColumn("model_label", parse_label(F.col("answer")))
    labels = labels.withColumn("label", F.coalesce("cached_label", "model_label"))
    labels = labels.withColumn("w_score", F.coalesce("cached_score", label_score(F.col("model_label"))))
    instruct = F.col("label") == "INSTRUCTION"
    texts = windows.select("_fs_text", "content_hash").join(labels, "content_hash").groupBy("_fs_text").agg(
        F.coalesce(F.bool_or(instruct), F.lit(False)).alias("_bad"),
        F.max(F.when(instruct, F.col("w_score"))).alias("_bad_score"),
        F.max("w_score").alias("_score"),
        F.bool_and(F.col("cached_label").isNotNull()).alias("_cached"),
        F.max("error").alias("_error"),
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"),
    )
    label = F.when(F.col("_bad"), "INSTRUCTION").when(F.col("n_unlabelled") == 0, "DATA")
    said = (
        F.when(F.col("_cached"), "cache_hit").when(label.isNotNull(), "ok").when(F.col("_error").isNotNull(), F.col("_error")).otherwise("parse_error")
    )
    score = F.when(F.col("_bad"), F.col("_bad_score")).when(label.isNotNull(), F.col("_score"))
    keep = [c for c in rows.columns if c not in ("_fs_text", "classifier_note", *nothing)]
    judged = rows.where(candidate).join(texts, "_fs_text").select(
        *keep, said.alias("classifier_note"), label.alias("det_classifier"), score.alias("classifier_score"), "n_windows", "n_unlabelled"
    )
    gated = rows.where(~candidate).select(*keep, "classifier_note", *[v.alias(c) for c, v in nulls.items()])
    new_rows = labels.where(F.col("model_label").isNotNull()).select(
        "content_hash",
        F.col("model_label").alias("classifier"),
        label_score(F.col("model_label")).alias("score"),
        now.alias("cached_at"),
        F.lit(backend).alias("backend"),
    )
    return gated.unionByName(judged), cache_upsert(cache, new_rows), new_rows


def combine_score(rule_score: Column, classifier_score: Column) -> Column:
    """score = max(rule score, classifier score)."""
    return F.greatest(rule_score, F.coalesce(classifier_score, rule_score))


def demo_classifier(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in model for tests and the registered queries:
    answers INSTRUCTION for imperative second-person text, DATA otherwise,
    and an unparseable answer for texts whose length is a multiple of 97."""
    low = texts.str.lower()
    instr = low.str.contains(r"\b(?:you must|you will|ignore|forget|follow the|act as)\b", regex=True)
    out = pd.Series(["DATA."] * len(texts), index=texts.index, dtype=object)
    out[instr] = " instruction"
    out[texts.str.len() % 97 == 0] = "??"
    return out

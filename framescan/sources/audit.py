"""Audit log as a Parquet table: schema, append, evolved read, sessions.

Partitioned by ``date(ts)`` so time-window queries prune partitions and
retention rewrites only the affected dates.  Rows are keyed by the caller's
``(frame_id, pos)`` / ``event_id``; nothing depends on generated ids.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import BUILTIN_RULES, C2S, S2C
from ..session import checkpoint_dir, written_once
from .keyed import PARTS, read_keyed, upsert_keyed

V1_FIELDS = [
    T.StructField("event_id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("direction", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("msg_id", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("params_json", T.StringType(), True),
    T.StructField("result_json", T.StringType(), True),
    T.StructField("error_json", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("note", T.StringType(), True),
]
V2_FIELDS = [
    T.StructField("det_verdict", T.StringType(), True),
    T.StructField("det_score", T.DoubleType(), True),
    T.StructField("det_rules", T.ArrayType(T.StringType()), True),
    T.StructField("det_classifier", T.StringType(), True),
    T.StructField("det_latency_ms", T.IntegerType(), True),
    T.StructField("det_action", T.StringType(), True),
]
AUDIT_SCHEMA = T.StructType(V1_FIELDS + V2_FIELDS)
# the log as stored: rows of inspected frames are known by their place instead of an event_id
# and, where the log is written by commits, by the order in which they came
LOG_SCHEMA = T.StructType(
    [
        *AUDIT_SCHEMA.fields,
        T.StructField("frame_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("commit_no", T.LongType()),
        T.StructField("date", T.DateType()),
    ]
)
V1_COLUMNS = [f.name for f in V1_FIELDS]
AUDIT_COLUMNS = [f.name for f in AUDIT_SCHEMA.fields]

# event_type -> (kind, verdict) used to derive an audit log from `events`
_EVENT_MAP = {
    "view": ("response", "PASS"),
    "click": ("request", "WARN"),
    "purchase": ("notification", "PASS"),
    "signup": ("error", None),
    "error": ("parse_error", "BLOCK"),
}
_N_RULES = len(BUILTIN_RULES)


def audit_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` mapped to audit rows by formula (a stand-in log whose size
    grows with the table): verdict and kind from ``event_type``, latency from
    ``value``, rule ids from ``props.k``."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    et = F.col("event_type")
    kind = F.lit(None).cast("string")
    ver = F.lit(None).cast("string")
    for k, (kd, vd) in _EVENT_MAP.items():
        kind = F.when(et == k, F.lit(kd)).otherwise(kind)
        ver = F.when(et == k, F.lit(vd).cast("string")).otherwise(ver)
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    ids = F.array(*[F.lit(r.id) for r in BUILTIN_RULES])
    first = F.element_at(ids, (k % _N_RULES + 1).cast("int"))
    second = F.element_at(ids, ((k * 7) % _N_RULES + 1).cast("int"))
    rules = F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("session_id"),
        "ts",
        F.when(F.col("event_id") % 2 == 0, S2C).otherwise(C2S).alias("direction"),
        kind.alias("kind"),
        F.col("event_id").cast("string").alias("msg_id"),
        et.alias("method"),
        F.col("props").alias("params_json"),
        F.lit(None).cast("string").alias("result_json"),
        F.lit(None).cast("string").alias("error_json"),
        F.col("props").alias("raw"),
        F.lit(None).cast("string").alias("note"),
        ver.alias("det_verdict"),
        F.when(ver == "BLOCK", 0.9).when(ver == "WARN", 0.7).when(ver == "PASS", 0.0).alias("det_score"),
        F.when(ver.isin("BLOCK", "WARN"), rules).alias("det_rules"),
        F.lit(None).cast("string").alias("det_classifier"),
        F.when(ver.isNotNull(), F.floor(F.col("value")).cast("int")).alias("det_latency_ms"),
        F.when(ver == "BLOCK", "block").when(ver == "WARN", "warn").when(ver == "PASS", "allow").alias("det_action"),
    )


def sql_audit_like() -> str:
    def case(idx):
        return "CASE event_type " + " ".join(
            f"WHEN '{k}' THEN {('NULL' if v[idx] is None else repr(v[idx]))}" for k, v in _EVENT_MAP.items()
        ) + " END"

    ids = "[" + ", ".join(f"'{r.id}'" for r in BUILTIN_RULES) + "]"
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    rules = f"CASE WHEN {k} % 3 = 0 THEN [{ids}[{k} % {_N_RULES} + 1], {ids}[({k} * 7) % {_N_RULES} + 1]] ELSE [{ids}[{k} % {_N_RULES} + 1]] END"
    return f"""(SELECT event_id, user_id AS session_id, ts,
        CASE WHEN event_id % 2 = 0 THEN '{S2C}' ELSE '{C2S}' END AS direction,
        {case(0)} AS kind, CAST(event_id AS VARCHAR) AS msg_id, event_type AS method, props AS params_json,
        NULL::VARCHAR AS result_json, NULL::VARCHAR AS error_json, props AS raw, NULL::VARCHAR AS note,
        {case(1)} AS det_verdict,
        CASE {case(1)} WHEN 'BLOCK' THEN 0.9 WHEN 'WARN' THEN 0.7 WHEN 'PASS' THEN 0.0 END::DOUBLE AS det_score,
        CASE WHEN {case(1)} IN ('BLOCK', 'WARN') THEN {rules} END AS det_rules,
        NULL::VARCHAR AS det_classifier,
        CASE WHEN {case(1)} IS NOT NULL THEN CAST(floor(value) AS INTEGER) END AS det_latency_ms,
        CASE {case(1)} WHEN 'BLOCK' THEN 'block' WHEN 'WARN' THEN 'warn' WHEN 'PASS' THEN 'allow' END AS det_action
      FROM events)"""


# ------------------------------------------------------------------- storage
def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "framescan", f"{name}-{uuid.uuid4().hex}")


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date(F.col("ts")))


def audit_write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows partitioned by ``date``; ``det_rules`` stays an array
    (NULL, not [], when nothing hit)."""
    with_date(df).write.mode(mode).partitionBy("date").parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def next_commit(spark: SparkSession, path: str) -> int:
    """One more than the last commit of a log; a log has one writer."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return 0
    names = [e.getPath().getName() for e in fs.listStatus(folder)]
    return 1 + max((int(n.partition("=")[2]) for n in names if n.startswith("commit_no=")), default=-1)


def audit_commit(df: DataFrame, path: str, commit_no: int | None = None) -> int:
    """Append rows as one commit: ``commit_no=<n>/date=<d>``, each row with its ``row_no`` inside.

    The pair orders the log by arrival (``stats.ARRIVAL_KEY``), whatever the
    rows' ``ts``.  A commit that is written again replaces itself."""
    n = next_commit(df.sparkSession, path) if commit_no is None else commit_no
    out = with_date(df.drop("commit_no")).withColumn("row_no", F.monotonically_increasing_id())
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(os.path.join(path, f"commit_no={n}"))
    return n


def audit_read(spark: SparkSession, path: str) -> DataFrame:
    """Old (v1) and new (v2) files together, by the log's own schema: columns
    a file lacks read as NULL and no footers are merged."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def rules_from_json(col: Column) -> Column:
    """``det_rules`` stored as JSON text -> ARRAY<STRING>: invalid JSON and non-arrays give NULL; non-string items are
    dropped."""
    v = F.try_parse_json(col)
    arr = F.try_variant_get(v, "$", "array<variant>")
    strings = F.filter(arr, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))


def _cutoff(keep_days: int, now: Column | str) -> Column:
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return now_c - F.make_dt_interval(F.lit(keep_days))


def apply_retention(spark: SparkSession, path: str, keep_days: int, now: Column | str) -> DataFrame:
    """The rows a retention run keeps: younger than ``keep_days`` by ``ts``; older dates are not read."""
    cutoff = _cutoff(keep_days, now)
    return audit_read(spark, path).where((F.col("date") >= F.to_date(cutoff)) & (F.col("ts") >= cutoff))


def write_retention(spark: SparkSession, path: str, keep_days: int, now: str, out_path: str) -> None:
    """Write the kept rows to ``out_path``, replacing what was there.  On the
    log's own path only the date of the cut-off is rewritten, and older dates
    are deleted."""
    kept = apply_retention(spark, path, keep_days, now)
    if out_path.rstrip("/") != path.rstrip("/"):
        kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(out_path)
        return
    first = spark.range(1).select(F.to_date(_cutoff(keep_days, now)).alias("d")).first()["d"]
    edge = written_once(kept.where(F.col("date") == F.lit(first)))
    edge.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    folder, fs = _folder(spark, path)
    stale = f"date={first}" if not edge.isEmpty() else f"date={first}~"
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("date=") and name < stale:
            fs.delete(entry.getPath(), True)


# ------------------------------------------------------------------ sessions
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lifecycle rows derived from ``events``: ``signup`` opens a
    session (start), ``purchase`` attaches a server pid, ``error`` closes it
    with an exit code, anything else shows that it is there.  ``session_id, ts, op, started_at, pid, exit_code``."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    et = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("session_id"),
        "ts",
        F.when(et == "signup", "start").when(et == "purchase", "pid").when(et == "error", "end").otherwise("seen").alias("op"),
        F.when(et == "purchase", (F.col("event_id") % 65536).cast("long")).alias("pid"),
        F.when(et == "error", (F.floor(F.col("value")).cast("int") % 3)).alias("exit_code"),
    )


def sessions_table(events: DataFrame) -> DataFrame:
    """Upsert by session id, last state wins: ``session_id, started_at,
    server_pid, ended_at, exit_code`` (one row per session, aggregated
    map-side before the shuffle)."""
    op = F.col("op")
    return events.groupBy("session_id").agg(
        F.max(F.when(op == "start", F.col("ts"))).alias("started_at"),
        F.max_by(F.col("pid"), F.when(op == "pid", F.col("ts"))).alias("server_pid"),
        F.max(F.when(op == "end", F.col("ts"))).alias("ended_at"),
        F.max_by(F.col("exit_code"), F.when(op == "end", F.col("ts"))).alias("exit_code"),
    )


SESSION_STATE = (
    "session_id long, started_at timestamp, attached struct<ts: timestamp, pid: long>, ended_at timestamp, "
    "closed struct<ts: timestamp, exit_code: int>"
)


def _last_state(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("started_at", "attached", "ended_at", "closed")])


def upsert_sessions(events: DataFrame, path: str, *, parts: int = PARTS, version: int | None = None) -> int:
    """Bring the sessions table at ``path`` up to date with a batch of session
    events: only the parts that the batch's sessions are in are read and
    written, never the events before.  The last state wins whatever order the
    batches come in; of two at one time the larger value.  A batch applied again changes nothing."""
    op, ts = F.col("op"), F.col("ts")
    state = events.select(
        F.col("session_id").cast("long").alias("session_id"),
        F.when(op == "start", ts).alias("started_at"),
        F.when(op == "pid", F.struct(ts.alias("ts"), F.col("pid").cast("long").alias("pid"))).alias("attached"),
        F.when(op == "end", ts).alias("ended_at"),
        F.when(op == "end", F.struct(ts.alias("ts"), F.col("exit_code").cast("int").alias("exit_code"))).alias("closed"),
    )
    return upsert_keyed(state, path, ["session_id"], _last_state, parts=parts, version=version)


def read_sessions(spark: SparkSession, path: str, *, parts: int = PARTS) -> DataFrame:
    """The sessions table at ``path``, with the columns of ``sessions_table``."""
    state = read_keyed(spark, path, SESSION_STATE, parts=parts)
    return state.select("session_id", "started_at", F.col("attached.pid").alias("server_pid"), "ended_at", F.col("closed.exit_code").alias("exit_code"))

"""Audit-log queries: window stats, top rules, exact latency percentiles,
snapshot, daily rollup, tail, cursor paging, recent sessions.

Every time window is half-open ``[start, end)`` with literal bounds (parsed
on the driver from ``7d`` / ``24h`` / ``30m``), so Parquet date partitions
and row-group statistics prune the scan.  Only final aggregates are small;
nothing is collected to compute them.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS_SCHEMA_VERSION = 1
VERDICTS = ("PASS", "WARN", "BLOCK")
TOTALS = ("total_events", "n_pass", "n_warn", "n_block")
# the order of a log that inspection wrote, which has no event_id
FRAME_KEY = ("ts", "session_id", "direction", "frame_id", "pos")
# the order in which rows came into a log that is written by commits (``sources.audit.audit_commit``): late rows come last
ARRIVAL_KEY = ("commit_no", "row_no")
Key = str | Sequence[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_column(key: Key) -> Column:
    """The row key as one comparable value: a column, or a struct of several."""
    return F.col(key) if isinstance(key, str) else F.struct(*key)


_UNITS = {"d": "days", "h": "hours", "m": "minutes"}


def parse_since(value: str) -> dt.timedelta:
    """A time span such as ``7d``, ``24h`` or ``30m``."""
    found = re.fullmatch(r"\s*0*([1-9][0-9]*)([dhm])", value, re.I)
    if found is None:
        raise ValueError(f"not a span of days, hours or minutes like 7d: {value!r}")
    return dt.timedelta(**{_UNITS[found[2].lower()]: int(found[1])})


def window(audit: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows with ``start <= ts < end`` (partition- and row-group-pruned)."""
    # bounds in the column's own type (TIMESTAMP or TIMESTAMP_NTZ) so the
    # comparison needs no cast of the column and reaches the Parquet scan
    tt = audit.schema["ts"].dataType
    cond = (F.col("ts") >= F.lit(start).cast(tt)) & (F.col("ts") < F.lit(end).cast(tt))
    if "date" in audit.columns:
        cond = cond & (F.col("date") >= F.lit(start.date())) & (F.col("date") <= F.lit(end.date()))
    return audit.where(cond)


def _verdict_counts() -> list[Column]:
    v = F.col("det_verdict")
    return [F.count("*").alias("total_events"), *[F.count_if(v == x).alias(f"n_{x.lower()}") for x in VERDICTS]]


PERCENTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}


def _counts_and_latency(w: DataFrame) -> DataFrame:
    """One row: verdict counts, exact percentiles interpolated between neighbours, ``n_samples``.

    Rows are counted by latency, which combines map-side; running counts over
    the different latencies (whole milliseconds, so no more than the longest
    has of them) say where each one's ranks begin."""
    by_latency = w.groupBy(F.col("det_latency_ms").alias("ms")).agg(*_verdict_counts())
    timed = F.when(F.col("ms").isNotNull(), F.col("total_events")).otherwise(0)
    order = Window.orderBy("ms")
    ranked = by_latency.select(
        "*",
        F.coalesce(F.sum(timed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum(timed).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
        timed.alias("n"),
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("ms").cast("double")))

    found, out = [], []
    for name, p in PERCENTILES.items():
        place = (F.col("all") - 1) * F.lit(p)
        found += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
        low, high, place = F.col(f"{name}_low"), F.col(f"{name}_high"), (F.col("n_samples") - 1) * F.lit(p)
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]
    return ranked.agg(*totals, *found, F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples")).select(*TOTALS, *out, "n_samples")


def stats_verdicts(w: DataFrame) -> DataFrame:
    """One row: total rows and PASS/WARN/BLOCK counts (zero-filled; NULL
    verdicts only count in the total)."""
    return w.agg(*_verdict_counts())


def stats_top_rules(w: DataFrame, k: int = 5, key: Key = "event_id") -> DataFrame:
    """Top ``k`` rule ids by hit count; ties keep first appearance (row key,
    then position inside the hit list).  Map-side partial aggregation keeps the
    shuffle at one row per (partition, rule)."""
    hits = w.where(F.col("det_rules").isNotNull()).select(
        key_column(key).alias("_k"), F.posexplode("det_rules").alias("_p", "rule_id")
    ).where(F.col("rule_id").isNotNull())
    counted = hits.groupBy("rule_id").agg(
        F.count("*").alias("count"), F.min(F.struct(F.col("_k"), F.col("_p"))).alias("_first")
    )
    # a top-k: only the ``k`` rows that are left are ranked by one task
    best = [F.desc("count"), F.asc("_first")]
    ranked = counted.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best)))
    return ranked.select(F.col("rank").cast("long").alias("rank"), "rule_id", F.col("count").cast("long").alias("count"))


def stats_latency(w: DataFrame) -> DataFrame:
    """Exact linear-interpolated p50/p95 of ``det_latency_ms`` (NULL without
    samples)."""
    return _counts_and_latency(w).select(*PERCENTILES, "n_samples")


def stats_report(audit: DataFrame, start: dt.datetime, end: dt.datetime, key: Key = "event_id") -> DataFrame:
    """One row: schema version, period bounds, totals, verdicts, top rules
    ("id:count" joined in rank order) and latency percentiles."""
    w = window(audit, start, end)
    top = stats_top_rules(w, key=key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "count"))), lambda s: F.concat(s["rule_id"], F.lit(":"), s["count"].cast("string"))),
            ",",
        ).alias("top_rules")
    )
    # two one-row parts laid over one another: their reads of the window run side by side
    parts = _counts_and_latency(w).unionByName(top, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).select(
        F.lit(STATS_SCHEMA_VERSION).alias("schema_version"),
        F.lit(start).alias("period_start"),
        F.lit(end).alias("period_end"),
        *TOTALS,
        "top_rules",
        *PERCENTILES,
    )


def log_snapshot(audit: DataFrame, key: Key = "event_id") -> DataFrame:
    """Total events and the time of the last event (by key)."""
    return audit.agg(F.count("*").alias("total_events"), F.max_by("ts", key_column(key)).alias("last_event_ts"))


def usage_rollup(audit: DataFrame) -> DataFrame:
    """Daily totals by verdict, no content."""
    v = F.col("det_verdict")
    return audit.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_events"),
        *[F.count_if(v == x).alias(f"n_{x.lower()}") for x in VERDICTS],
    )


def tail(audit: DataFrame, n: int = 20, verdict: str | None = None, key: Key = "event_id") -> DataFrame:
    """Newest ``n`` rows (optionally of one verdict), returned oldest first.
    A top-k: each partition keeps its ``n`` best before the final merge."""
    df = audit if verdict is None else audit.where(F.col("det_verdict") == verdict)
    names = _names(key)
    return df.orderBy(*[F.desc(c) for c in names]).limit(n).orderBy(*names)


def _after(audit: DataFrame, key: Key, cursor, equal: bool) -> Column:
    """Rows whose key follows the cursor's (or equals it), column by column, so that the first
    column's bound reaches partitions and Parquet statistics; nulls come first."""
    if isinstance(key, str):
        return F.col(key) >= F.lit(cursor) if equal else F.col(key) > F.lit(cursor)
    out = F.lit(equal)
    for c, v in reversed(list(zip(key, cursor, strict=True))):
        bound = F.lit(v).cast(audit.schema[c].dataType)
        later = F.col(c).isNotNull() if v is None else F.col(c) > bound
        out = later | (F.col(c).eqNullSafe(bound) & out)
    first, value = key[0], cursor[0]
    if value is None:
        return out
    bound = F.lit(value).cast(audit.schema[first].dataType)
    out = (F.col(first) >= bound) & out
    if first == "ts" and "date" in audit.columns:
        out = (F.col("date") >= F.to_date(bound)) & out
    return out


def page_since(audit: DataFrame, cursor, n: int = 500, verdict: str | None = None, key: Key = "event_id") -> DataFrame:
    """Rows with key > cursor, ascending, at most ``n`` (cursor paging). A key of several columns takes a tuple.
    By ``ARRIVAL_KEY`` every new row is paged, also one whose ``ts`` is late, and only later commits are read."""
    df = audit.where(_after(audit, key, cursor, False))
    if verdict is not None:
        df = df.where(F.col("det_verdict") == verdict)
    return df.orderBy(*_names(key)).limit(n)


def from_cursor(audit: DataFrame, cursor, key: Key = "event_id") -> DataFrame:
    """Rows at or after a cursor (None: all)."""
    return audit if cursor is None else audit.where(_after(audit, key, cursor, True))


def seed_cursor(audit: DataFrame, n: int = 20, verdict: str | None = None, key: Key = "event_id"):
    """The key of the oldest of the newest ``n`` rows, where a follower starts; None for an empty log."""
    first = tail(audit, n, verdict, key).select(*_names(key)).first()
    return None if first is None else first[0] if isinstance(key, str) else tuple(first)


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), F.desc("session_id")).limit(n)

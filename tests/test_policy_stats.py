"""Policy semantics, verdicts and audit-log statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framescan.operators import stats as ST
from framescan.operators.policy import DEFAULT_POLICY, Policy, decide, verdict
from framescan.sources import audit as AU


def _decide(spark, policy, rows):
    df = spark.createDataFrame(rows, "direction string, method string, score double, classifier string, rules_hit string, raw string")
    d = decide(policy, direction=F.col("direction"), method=F.col("method"), score=F.col("score"),
               classifier=F.col("classifier"), rules_hit=F.col("rules_hit"), raw=F.col("raw"))
    return [(r["d"]["action"], r["d"]["matched_rule"]) for r in df.select(d.alias("d")).collect()]


def test_default_policy(spark):
    rows = [
        ("server_to_client", None, 0.85, None, None, "x"),  # threshold is >=
        ("server_to_client", None, 0.84, "INSTRUCTION", None, "x"),
        ("client_to_server", "tools/call", 0.95, None, "shell.rm_rf_root_or_home", "x"),
        ("client_to_server", "tools/call", 0.7, None, "shell.history_clearing", "x"),
        ("client_to_server", "tools/call", 0.9, None, None, "x"),
    ]
    assert _decide(spark, DEFAULT_POLICY, rows) == [
        ("block", "block_high_score_s2c"),
        ("warn", "warn_classifier_instruction"),
        ("block", "block_shell_injection_c2s"),
        ("warn", "warn_history_clearing_c2s"),
        ("allow", None),
    ]


def test_first_match_and_all_clauses(spark):
    p = Policy.from_dict({
        "default": "warn",
        "rules": [
            {"name": "a", "when": {"method": "tools/call", "tool_args_match_any": ["sudo"]}, "action": "block"},
            {"name": "b", "when": {"method": "tools/call"}, "action": "allow"},
            {"name": "c", "when": {"detector_score_at_least": "oops"}, "action": "block"},
        ],
    })
    rows = [
        ("client_to_server", "tools/call", 0.0, None, None, "run sudo now"),
        ("client_to_server", "tools/call", 0.0, None, None, "ls"),
        ("server_to_client", None, 1.0, None, None, "x"),  # NULL method never equals, bad threshold never matches
    ]
    assert _decide(spark, p, rows) == [("block", "a"), ("allow", "b"), ("warn", None)]


@pytest.mark.parametrize(
    "data,msg",
    [
        ({"rules": [{"name": "x", "when": {"dirction": "a"}, "action": "warn"}]}, "unknown"),
        ({"rules": [{"name": "x", "when": {}, "action": "block"}]}, "empty"),
        ({"rules": [{"name": "x", "action": "explode"}]}, "invalid action"),
        ({"rules": [{"name": "x"}, {"name": "x"}]}, "duplicate"),
        ({"default": "nope"}, "default"),
    ],
)
def test_policy_loader_rejects(data, msg):
    with pytest.raises(ValueError, match=msg):
        Policy.from_dict(data)


def test_verdict_mapping(spark):
    df = spark.createDataFrame([("block",), ("warn",), ("allow",), ("rewrite",)], "a string")
    assert [r[0] for r in df.select(verdict(F.col("a"))).collect()] == ["BLOCK", "WARN", "PASS", "PASS"]


def _log(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, det_verdict string, det_rules array<string>, det_latency_ms int")


def test_stats_empty(spark):
    w = _log(spark, [])
    assert ST.stats_verdicts(w).first().asDict() == {"total_events": 0, "n_pass": 0, "n_warn": 0, "n_block": 0}
    lat = ST.stats_latency(w).first()
    assert lat["latency_p50_ms"] is None and lat["latency_p95_ms"] is None


def test_stats_window_ties_percentiles(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [(i, now - dt.timedelta(hours=i), "PASS", None, i) for i in range(1, 101)]
    rows.append((200, now - dt.timedelta(days=8), "BLOCK", ["z"], 9999))  # outside a 7-day window
    rows += [(300, now - dt.timedelta(hours=1), "BLOCK", ["b", "a"], None), (301, now - dt.timedelta(hours=2), "WARN", ["a", "b", "c", "d", "e", "f"], None)]
    w = ST.window(_log(spark, rows), now - ST.parse_since("7d"), now)
    v = ST.stats_verdicts(w).first()
    assert (v["total_events"], v["n_block"], v["n_warn"]) == (102, 1, 1)
    lat = ST.stats_latency(w).first()
    assert (lat["latency_p50_ms"], round(lat["latency_p95_ms"], 2)) == (50.5, 95.05)
    top = [(r["rule_id"], r["count"]) for r in ST.stats_top_rules(w).orderBy("rank").collect()]
    assert top == [("b", 2), ("a", 2), ("c", 1), ("d", 1), ("e", 1)]


def test_parse_since():
    assert ST.parse_since("24h") == dt.timedelta(hours=24)
    for bad in ["", "7", "0d", "-1d", "3w"]:
        with pytest.raises(ValueError):
            ST.parse_since(bad)


def test_rules_from_json(spark):
    df = spark.createDataFrame([('["a", 1, "b"]',), ("not json",), ('{"x": 1}',), ("[" + '"a",' * 40000 + '"a"]',)], "j string")
    out = [r[0] for r in df.select(AU.rules_from_json(F.col("j"))).collect()]
    assert out == [["a", "b"], None, None, ["a"] * 40001]  # lists of any length are read


def test_sessions_last_state_wins(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(1, t, "start", None, None), (1, t + dt.timedelta(1), "pid", 10, None), (1, t + dt.timedelta(2), "pid", 11, None),
         (1, t + dt.timedelta(3), "end", None, 2)],
        "session_id long, ts timestamp, op string, pid long, exit_code int",
    )
    r = AU.sessions_table(ev).first()
    assert (r["server_pid"], r["exit_code"]) == (11, 2)


def test_retention_rewrites_dates(spark):
    import tempfile

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(hours=12 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, session_id long, ts timestamp")
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    AU.audit_write(df, src, mode="overwrite")
    AU.write_retention(spark, src, 2, "2024-01-06 00:00:00", out)
    kept = sorted(r["event_id"] for r in AU.audit_read(spark, out).collect())
    assert kept == [6, 7, 8, 9]  # ts >= 2024-01-04 00:00 (12-hourly events)

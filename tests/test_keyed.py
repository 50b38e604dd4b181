"""Tables kept up to date by batches: results against the whole computation, files and parts touched, replays."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framescan.operators import classify as CL
from framescan.operators.rules import S2C
from framescan.sources import audit as AU
from framescan.sources import keyed as K
from framescan.streaming import stream as SS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, n long"


def _sum(rows, by):
    return rows.groupBy(*by).agg(F.sum("n").alias("n"))


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def _table(spark, path, **kw):
    return {r["k"]: r["n"] for r in K.read_keyed(spark, path, SCHEMA, **kw).collect()}


def test_batches_add_up_and_files_stay_few(spark):
    path, want, rng = os.path.join(tempfile.mkdtemp(), "t"), {}, random.Random(1)
    assert _table(spark, path, parts=4) == {}
    counts = []
    for n in range(7):
        rows = [(rng.choice([None, "", "a", "b", "c", "hot", "hot", "hot"]), rng.randrange(9)) for _ in range(40)]
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        assert K.upsert_keyed(spark.createDataFrame(rows, SCHEMA), path, ["k"], _sum, parts=4) == n
        assert _table(spark, path, parts=4) == want
        counts.append(len(_files(path)))
    assert max(counts) <= 8  # two versions of four parts


def test_a_batch_that_is_run_again_or_died_changes_nothing(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], SCHEMA)
    K.upsert_keyed(batch, path, ["k"], _sum, parts=4, version=0)
    for _ in range(3):
        K.upsert_keyed(batch, path, ["k"], _sum, parts=4, version=1)
        assert _table(spark, path, parts=4) == {"a": 8, "b": 4}
    assert _table(spark, path, parts=4, before=1) == {"a": 4, "b": 2}
    K.upsert_keyed(spark.createDataFrame([("a", 100)], SCHEMA), path, ["k"], _sum, parts=4, version=2)
    os.remove(os.path.join(path, "of=4", "version=2", "_SUCCESS"))  # as if it had died while writing
    assert _table(spark, path, parts=4) == {"a": 8, "b": 4}
    K.upsert_keyed(spark.createDataFrame([("a", 1)], SCHEMA), path, ["k"], _sum, parts=4, version=2)
    assert _table(spark, path, parts=4) == {"a": 9, "b": 4}


def test_only_touched_parts_are_read_and_written(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    K.upsert_keyed(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("n")), path, ["k"], _sum, parts=8)
    one = spark.createDataFrame([("7", 1)], SCHEMA)
    (part,) = K.touched(one, ["k"], 8)
    files = K.read_keyed(spark, path, SCHEMA, parts=8, only=[part]).inputFiles()
    assert files and all(f"part={part}/" in f for f in files)
    K.upsert_keyed(one, path, ["k"], _sum, parts=8)
    assert [f for f in os.listdir(f"{path}/of=8/version=1") if f.startswith("part=")] == [f"part={part}"]
    assert _table(spark, path, parts=8) == {str(i): 1 + (i == 7) for i in range(200)}
    K.upsert_keyed(one.limit(0), path, ["k"], _sum, parts=8)  # an empty batch
    assert _table(spark, path, parts=8)["7"] == 2
    with pytest.raises(ValueError, match="8 parts"):
        K.read_keyed(spark, path, SCHEMA, parts=4)


def test_sessions_by_batches_equal_the_whole(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):  # one time an event: no ties; a third of them of one session
        op = rng.choice(["start", "pid", "end", "seen"])
        s = rng.choice([0, 0, 0, None, *range(1, 7)])
        rows.append((s, T0 + dt.timedelta(minutes=i), op, i if op == "pid" else None, i % 3 if op == "end" else None))
    rng.shuffle(rows)
    schema = "session_id long, ts timestamp, op string, pid long, exit_code int"
    path = os.path.join(tempfile.mkdtemp(), "s")
    for at in range(0, 300, 75):
        AU.upsert_sessions(spark.createDataFrame(rows[at : at + 75], schema), path, parts=4)
    key = ["session_id", "started_at", "server_pid", "ended_at", "exit_code"]
    got = sorted(map(str, AU.read_sessions(spark, path, parts=4).select(key).collect()))
    assert got == sorted(map(str, AU.sessions_table(spark.createDataFrame(rows, schema)).select(key).collect()))


def test_classifier_reads_the_parts_of_its_windows(spark):
    path = os.path.join(tempfile.mkdtemp(), "c")
    now = F.lit(T0).cast("timestamp")
    texts = ["one text", "another text", "a third"]
    rows = spark.createDataFrame([(i, S2C, 0.0, "candidate", t) for i, t in enumerate(texts)], "i int, direction string, det_score double, shape_note string, result_text string")

    def model(samples):
        return pd.Series(["DATA"] * len(samples), index=samples.index)

    def never(samples):
        raise AssertionError("asked again")

    for n, asked in enumerate((model, never)):
        out, _, learnt = CL.run_classifier(rows, classifier=asked, cache=CL.stored_labels(spark, path), now=now)
        assert {r["classifier_note"] for r in out.collect()} == {("ok", "cache_hit")[n]}
        CL.store_labels(learnt, path)
    later = F.lit(T0 + dt.timedelta(days=2)).cast("timestamp")
    out, _, _ = CL.run_classifier(rows, classifier=model, cache=CL.stored_labels(spark, path), now=later)
    assert {r["classifier_note"] for r in out.collect()} == {"ok"}  # the labels are too old


def test_counts_and_cache_stay_flat_over_batches(spark):
    log, out, ck = tempfile.mkdtemp(), os.path.join(tempfile.mkdtemp(), "n"), tempfile.mkdtemp()
    sizes = []
    for n in range(12):
        rows = [(100 * n + i, T0 + dt.timedelta(hours=i % 3), "BLOCK" if i % 4 else None) for i in range(20)]
        AU.audit_commit(spark.createDataFrame(rows, "event_id long, ts timestamp, det_verdict string"), log)
        q = SS.write_counts(SS.follow(spark, log), out, ck)
        q.awaitTermination()
        assert q.exception() is None
        sizes.append(len(_files(out)))
    assert sizes[-1] == sizes[1] <= 2 * SS.COUNT_PARTS
    counts = {(r["window_start"].hour, r["det_verdict"]): r["n"] for r in SS.total_counts(spark, out).collect()}
    want = {}
    for i in range(20):
        k = (i % 3, "BLOCK" if i % 4 else None)
        want[k] = want.get(k, 0) + 12
    assert counts == want

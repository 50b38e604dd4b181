"""Queries over small tables of their own: what is scanned is scanned once, and filters are not spelled out below it."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"s{i % 3}", "en", f"text {i % 20} " + "e" * (i % 7) + "x" * (9000 * (i % 11 == 0))) for i in range(60)]
    talk = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c}") for c in range(4) for t in range(6)]
    spark.createDataFrame([*docs, (None, None, None, None)], "doc_id long, source string, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["parse_errors", "valid_events", "tool_name"])
def test_filters_do_not_repeat_the_parse(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert not [line for line in _plan(df).splitlines() if "Filter" in line and "parsejson" in line.lower().replace("_", "")]
    assert df.count()


@pytest.mark.parametrize("name", ["cache_lookup", "cache_upsert", "classify_misses", "combine_score", "uninspected_truncated"])
def test_members_are_scanned_once(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert "Relation" not in _plan(df)  # what was scanned is read from what was written
    assert df.count()


def test_gate_is_not_repeated_below_the_scan(spark, tables):
    plan = _plan(entry.queries()["classifier_input"](spark, tables))
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line and "_fs_" in line]

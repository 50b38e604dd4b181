import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from framescan.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, app="framescan-tests")
    yield s
    s.stop()


@pytest.fixture
def scan(spark):
    """Scan a list of texts in one direction -> list of (hits list, score)."""
    from framescan.operators.scan import rule_scan

    def run(texts, direction="server_to_client", **kw):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        rows = rule_scan(df, "text", direction, **kw).orderBy("i").collect()
        return [((r["rules_hit"] or "").split(",") if r["rules_hit"] else [], r["det_score"]) for r in rows]

    return run

"""Every query against its SQL on the small tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")

from timberline.plans.catalogue import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((rounded(r[c] for c in columns) for r in df.collect()), key=repr)
    found = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((rounded(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("batch, stream", [("alarm_changelog", "stream_alarms"), ("alarms_contextual", "stream_contextual")])
def test_streams_end_as_the_batch_does(spark, batch, stream):
    """From raw lines; contextual checks are asked, answered and failed in the stream as in the batch."""
    want = {(r.alarm_id, r.at_sec, r.event_id, r.op, r["count"]) for r in QUERIES[batch](spark, SF).collect()}
    rows = [(r.alarm_id, r.at_sec, r.event_id, r.op, r["count"]) for r in QUERIES[stream](spark, SF).collect()]
    # What falls due after the last line is still open in the stream.
    end = max(r[1] for r in rows)
    assert len(rows) == len(set(rows)) and set(rows) <= want and all(r[3] == "Cleared" or r[1] >= end for r in want - set(rows))

import datetime
import json

import pytest
from pyspark.sql import functions as F

from timberline.functions.text import body, content, excerpt, humanize, lossy
from timberline.sources import files, generate, journal, otlp, syslog

AT = "2026-09-19 10:00:00"

# One frame for each way of reading: 3164 with and without a host, 5424, an app in brackets, no time, a priority that cannot be.
FRAMES = [
    (b"<13>Oct  3 04:05:06 gate7 backupd[77]: nightly run begins", "backupd[77]: nightly run begins", "gate7"),
    (b"<13>Oct  3 04:05:06 backupd[77]: names no machine", "backupd[77]: names no machine", "10.0.0.9"),
    (b"<165>1 2026-03-04T05:06:07Z shop2 cart 4242 cid9 - basket opened", "cart 4242 cid9 - basket opened", "shop2"),
    (b"Feb  9 11:12:13 lab4 login(pam_tally)[51]: account locked", "login(pam_tally)[51]: account locked", "lab4"),
    (b"# 20260101 sensor A7 STATUS ok", "# 20260101 sensor A7 STATUS ok", "10.0.0.9"),
    (b"<998>priority out of range", "<998>priority out of range", "10.0.0.9"),
]


def frames(spark, rows):
    return spark.createDataFrame([(k, bytearray(r), "10.0.0.9") for k, r in enumerate(rows)], "k int, raw binary, peer string").withColumn("received_at", F.lit(AT).cast("timestamp"))


def test_syslog(spark):
    rows = syslog.normalise(frames(spark, [f[0] for f in FRAMES])).select("*", body(F.col("raw"), F.col("body_offset")).alias("body")).orderBy("k").collect()
    for row, (raw, want, host) in zip(rows, FRAMES, strict=True):
        assert (row.body, row.host, bytes(row.raw)) == (want, host, raw)
    assert rows[2].attrs == {"app": "cart", "facility": "local4", "msgid": "cid9", "procid": "4242", "protocol": "rfc5424", "severity": "notice"}
    assert rows[2].body_offset == FRAMES[2][0].index(b"cart") and rows[5].attrs == {"parse": "failed"}
    assert syslog.normalise(frames(spark, [b"\xff\xfe\x00junk"])).first().attrs == {"parse": "failed"}


def test_syslog_frames_of_64_kib(spark):
    """Structured data, escapes, brackets and tokens of any length are matched in place."""
    data = b"[a x=" + b"y" * 2500 + b"]"
    frames_ = [
        b"<34>1 2026-03-04T05:06:07Z h app 1 m " + data + b" told",
        b"<34>1 2026-03-04T05:06:07Z h app 1 m [e q=" + rb"\]" * 20_000 + b"] told",
        b"<34>1 2026-03-04T05:06:07Z h app 1 m " + b"[a]" * 21_000 + b" told",
        b"<34>1 2026-03-04T05:06:07Z h - - - [open " + b"z" * 64_000,
        b"<13>Oct  3 04:05:06 gate7 " + b"w" * 64_000,
        b"<13>Oct  3 04:05:06 gate7 tag[" + b"5" * 64_000 + b"]: told",
        b"<13>" + b"[" * 64_000,
        rb'<34>1 - - - - - [a b="\]"] - ] x',
    ]
    rows = syslog.normalise(frames(spark, frames_)).select("*", body(F.col("raw"), F.col("body_offset")).alias("body")).orderBy("k").collect()
    assert [r.attrs["protocol"] for r in rows] == ["rfc5424"] * 3 + ["rfc3164"] * 4 + ["rfc5424"]
    assert all(r.body.startswith("app 1 m ") and r.body.endswith(" told") for r in rows[:3])
    assert rows[4].body == " " + "w" * 64_000 and rows[5].attrs["procid"] == "5" * 64_000 and rows[5].body.startswith("tag[5")
    assert rows[3].body == frames_[3].decode() and rows[6].body == frames_[6].decode()


@pytest.mark.parametrize("received, month, day, year", [("2027-01-01 00:00:01", 12, 31, 2026), ("2026-12-31 23:59:59", 1, 1, 2027), ("2025-03-01 00:00:00", 2, 29, 2024)])
def test_nearest_year(spark, received, month, day, year):
    at = syslog.nearest_year(F.lit(month), F.lit(day), F.lit("12:00:00"), F.lit(received).cast("timestamp"))
    assert spark.range(1).select(at.alias("t")).first().t.year == year


def test_journal(spark):
    rec = {"MESSAGE": "hi", "_HOSTNAME": "", "__REALTIME_TIMESTAMP": "1700000000000000", "_SYSTEMD_UNIT": "x.service"}
    df = spark.createDataFrame([(json.dumps(rec),), (json.dumps({"_SYSTEMD_UNIT": "own"}),), (json.dumps({"_SOURCE_REALTIME_TIMESTAMP": "x"}),)], "line string")
    rows = journal.normalise(journal.parse(df), own_unit="own").collect()
    assert len(rows) == 2 and rows[0].host == "localhost" and bytes(rows[0].raw) == b"hi" and "MESSAGE" not in rows[0].attrs
    assert rows[0].timestamp == datetime.datetime(2023, 11, 14, 22, 13, 20) and rows[1].timestamp is None and bytes(rows[1].raw) == b""


def test_otlp(spark):
    value = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"boolValue": True}, {"doubleValue": 2.5}]}}}, {"key": "b"}]}}
    assert otlp.render(value) == "{a=[1, true, 2.5], b=}"
    record = {"timeUnixNano": "0", "observedTimeUnixNano": "1700000000000000000", "body": value, "severityText": "INFO", "traceId": "AB12", "attributes": [{"key": "scope", "value": {"stringValue": "mine"}}]}
    export = {"resourceLogs": [{"resource": {"attributes": [{"key": "host.name", "value": {"stringValue": "h1"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record]}]}]}
    row = otlp.normalise(spark.createDataFrame([(json.dumps(export), "1.2.3.4")], "export string, peer string")).first()
    assert bytes(row.raw).decode() == "{a=[1, true, 2.5], b=}" and row.host == "h1" and row.timestamp is not None
    assert row.attrs == {"resource.host.name": "h1", "attr.scope": "mine", "severity_text": "INFO", "scope": "s", "trace_id": "ab12"}


def test_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xe2\x82b\xffc"),)], "raw binary")
    assert df.select(lossy(F.col("raw")).alias("t")).first().t == b"a\xe2\x82b\xffc".decode("utf-8", "replace")
    df = spark.createDataFrame([("é" * 100,), ("x" * 200,), ("short",)], "t string")
    assert [r.e for r in df.select(excerpt(F.col("t")).alias("e")).collect()] == ["é" * 80, "x" * 160, "short"]
    assert df.limit(1).select(humanize(F.lit("blast_radius")).alias("h"), content(F.lit("a: b: c ")).alias("c")).first() == ("Blast radius", "b: c")


def test_files_and_generators(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    assert sorted(r.value for r in files.corpus(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert [(r.line_id, r.line) for r in files.numbered(spark, str(tmp_path / "a.log")).collect()] == [(1, "one"), (2, ""), (3, "two")]
    (tmp_path / "t.csv").write_text("LineId,Content,EventTemplate\n1,one,<*>\n2,,x\n3,two,<*>\n")
    both = files.matched_truth(files.numbered(spark, str(tmp_path / "a.log")), files.truth(spark, str(tmp_path / "t.csv")))
    assert both.filter("truth = '<*>'").count() == 2
    with pytest.raises(Exception, match="no match for line"):
        files.matched_truth(files.numbered(spark, str(tmp_path / "a.log")), files.truth(spark, str(tmp_path / "t.csv")).filter("line_id > 1")).collect()
    lines = spark.createDataFrame([("a 1 b",), ("a 2 c",), ("zz",)], "content string")
    known = spark.createDataFrame([("E1", "a <*> b"), ("E2", "a <*>"), ("E3", "a <*> c"), ("E4", "<*> 2 c")], "event string, template string")
    assert {r.content: r.event for r in files.truth_match(lines, known).collect()} == {"a 1 b": "E1", "a 2 c": "ambiguous", "zz": None}
    # A line meets templates by their rarest token; those without one are looked at for each.
    more = spark.createDataFrame([("E5", "<*>"), ("E6", "b <*>")], "event string, template string")
    assert {r.content: r.event for r in files.truth_match(lines, known.union(more)).collect()} == {"a 1 b": "E1", "a 2 c": "ambiguous", "zz": "E5"}
    files.write_tsv(spark.createDataFrame([("a\tb", "c\nd")], "x string, y string"), str(tmp_path / "out"))
    assert "a b\tc d" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    for kind in (*generate.KINDS, "mixed"):
        made = generate.lines(spark, kind, 200, 3).collect()
        assert made == generate.lines(spark, kind, 200, 3).collect() != generate.lines(spark, kind, 200, 4).collect()
        assert all(r.line and "{" not in r.line for r in made) and len({r.line for r in made}) > 150
    frames_ = generate.lines(spark, "mixed", 3).select(generate.envelope(F.col("line"), F.lit(AT).cast("timestamp"), F.lit("h7")).alias("raw"), F.lit("p").alias("peer"), F.lit(AT).cast("timestamp").alias("received_at"))
    assert {(r.host, r.attrs["app"]) for r in syslog.normalise(frames_).collect()} == {("h7", "made-up")}
    shed = syslog.shed(spark.range(10).select(F.col("id").alias("event_id"), F.lit(AT).cast("timestamp").alias("received_at")), 4)
    assert shed.filter("shed").count() == 6

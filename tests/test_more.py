"""Replay and shedding of sources, merge judging, contextual snapshots, the feed's resync, Java's patterns."""

import json
import random
import socket

import pytest
from pyspark.sql import functions as F

from timberline.functions.mask import DEFAULT, BadBundle, Bundle, Slot, mask
from timberline.operators import alarms as A
from timberline.operators import neighbours as N
from timberline.operators import verdicts as V
from timberline.sources import files, journal
from timberline.sources.sockets import Shed, Taken, TcpReader, UdpReader
from timberline.sources.store import Store


def test_shed_counts_causes_and_damps_warnings():
    said, at = [], [0.0]
    shed = Shed("udp", 5.0, said.append, lambda: at[0])
    for k in range(12):
        at[0] = k
        shed.note("quota" if k % 3 else "full")
    assert shed.total == 12 and shed.counts == {"quota": 8, "full": 4}
    assert said == ["udp sheds: 1 so far, now full", "udp sheds: 6 so far, now quota", "udp sheds: 11 so far, now quota"]


def test_taken_rows_are_read_again_until_committed(tmp_path):
    folder = str(tmp_path / "journal")
    taken = Taken(folder)
    taken.keep(0, ["a", "b"])
    taken.keep(2, ["c"])
    taken.keep(3, [])
    for again in (taken, Taken(folder)):
        assert again.end == 3 and again.between(1, 3) == ["b", "c"] and again.between(3, 3) == []
    taken.forget(2)
    assert Taken(folder).between(0, 3) == ["c"]
    taken.forget(3)
    # The offset goes on where it was.
    assert Taken(folder).end == 3 and Taken().end == 0


@pytest.mark.parametrize("kind", [UdpReader, TcpReader])
def test_a_restarted_reader_gives_planned_rows(tmp_path, kind):
    options = {"port": "0", "journal": str(tmp_path)}
    reader = kind(options)
    start = reader.initialOffset()
    if kind is UdpReader:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for k in range(3):
                s.sendto(b"<13>m%d" % k, reader.socket.getsockname())
        own = reader.socket
    else:
        with socket.create_connection(reader.server.getsockname()) as s:
            s.sendall(b"<13>m0\n<13>m1\n<13>m2\n")
        own = reader.server
    rows, end = reader.read(start)
    rows = list(rows)
    own.close()
    anew = kind(options)
    assert list(anew.readBetweenOffsets(start, end)) == rows and [r[3] for r in rows] == [b"<13>m0", b"<13>m1", b"<13>m2"]
    assert anew.initialOffset() == end
    anew.commit(end)
    (anew.socket if kind is UdpReader else anew.server).close()


def test_merge_judge_asks_each_open_pair_once(spark):
    pairs = spark.createDataFrame([("b", "a", "tb", "ta"), ("a", "b", "ta", "tb"), ("a", "a", "ta", "ta"), ("c", "d", "tc", "td"), ("e", "f", "te", "tf"), ("g", "h", "tg", "th")], "id_a string, id_b string, template_a string, template_b string")
    known = spark.createDataFrame([("c", "d")], "id_lo string, id_hi string")

    class Judge:
        def decide(self, template_id, template, questions):
            assert list(questions) == ["same_event"]
            state = json.loads(template)
            if template_id == "e|f":
                raise TimeoutError
            if template_id == "g|h":
                return {}
            return {"same_event": {"noul": 0.9 if state["template_lo"] == "ta" else 0.1}}

    found = N.judge_merges(pairs, known, Judge())
    rows = {(r.id_lo, r.id_hi): r for r in found.collect()}
    assert set(rows) == {("a", "b"), ("e", "f"), ("g", "h")} and rows["a", "b"].template_lo == "ta" and rows["a", "b"].noul == 0.9
    assert rows["e", "f"].failed and rows["g", "h"].failed
    merges = N.merges_of(found, "b1", F.current_timestamp())
    assert [(r.id_lo, r.merged) for r in merges.collect()] == [("a", True)]
    assert N.resolve(N.alias_edges(merges)).first().survivor == "a"


def test_snapshots_equal_all_pairs(spark):
    """The oldest alarms by brute force, many of them open for long."""
    rng = random.Random(4)
    alarms = []
    for k in range(300):
        opened = rng.randint(0, 20_000)
        alarms.append((f"id{k:03}", rng.choice(["a", "b"]), opened, opened + rng.choice([10, 900, 5000, 15_000]), f"t{k}"))
    bursts = [(k, rng.choice(["a", "b", "c", None]), rng.randint(0, 30_000)) for k in range(400)]
    found = spark.createDataFrame(alarms, "alarm_id string, host string, opened_sec long, clears_sec long, template string")
    df = spark.createDataFrame(bursts, "event_id long, host string, sec long")
    rows = A.context_snapshot(df, found)
    for r in rows.collect():
        live = sorted((o, i, t) for i, h, o, c, t in alarms if h == r.host and o < r.sec <= c)[:8]
        assert [tuple(x) for x in r.open_alarms or []] == live
    # A burst can only be answered with what it was shown.
    options = {r.event_id: (r.o, [x.alarm_id for x in r.open_alarms or []]) for r in rows.withColumn("o", V.context_options(F.col("open_alarms"))).collect()}
    assert all(set(o) == {*ids, "none"} for o, ids in options.values())
    answers = spark.createDataFrame([(1, alarms[0][3], alarms[0][0]), (2, alarms[0][3] + 1, alarms[0][0]), (3, 5, "gone"), (4, 5, None)], "event_id long, answered_sec long, correlates_with string")
    assert {r.event_id: r.correlates_with for r in A.still_open(answers, found).collect()} == {1: alarms[0][0], 2: None, 3: None, 4: None}


def test_a_follower_that_lags_is_given_all_open_alarms(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sink = store.alarm_sink()
    for batch, (name, op) in enumerate([("a", "Raised"), ("b", "Raised"), ("a", "Cleared"), ("c", "Raised")]):
        sink(spark.createDataFrame([(name, batch, op, 1)], "alarm_id string, at_sec int, op string, count int"), batch)
    kind, last, rows = store.feed(1)
    assert (kind, last, [(r.alarm_id, r.op) for r in rows.collect()]) == ("changes", 3, [("a", "Cleared"), ("c", "Raised")])
    kind, last, rows = store.feed(0, most_behind=2)
    assert (kind, last, [r.alarm_id for r in rows.collect()]) == ("resync", 3, ["b", "c"])
    assert store.feed(3)[2].count() == 0


def test_patterns_that_java_does_not_take(spark):
    assert DEFAULT.check(spark) is DEFAULT
    with pytest.raises(BadBundle) as x:
        Bundle((Slot("A", r"(?P<x>a)"),)).check(spark)
    assert x.value.kind == "regex"


def test_masking_of_separators_and_long_lines(spark):
    """Control characters of the line's own stay; a line of a megabyte takes time in proportion."""
    odd = ["a\x01 5 \x04\x05 b\x04\x06 7\x01", "\x01", "\x04\x05", "x 1\x01"]
    got = [r.m for r in spark.createDataFrame(list(enumerate(odd)), "k int, raw string").orderBy("k").select(mask(F.col("raw")).alias("m")).collect()]
    assert got == ["a\x01 <VAR:NUM> \x04\x05 b\x04\x06 <VAR:NUM>\x01", "\x01", "\x04\x05", "x <VAR:NUM>\x01"]
    long = "took 15ms from 10.0.0.9 " * 40_000
    row = spark.createDataFrame([(long,)], "raw string").select(mask(F.col("raw")).alias("m")).first()
    assert row.m == "took <VAR:DUR> from <VAR:IP4> " * 40_000


def test_lines_of_a_file_in_several_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = files.numbered(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line_id: r.line for r in rows} == {k + 1: f"line {k}" for k in range(5000)}


def test_journal_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"MESSAGE": "hi"}) + "\n" + json.dumps({"MESSAGE": "own", "_SYSTEMD_UNIT": "me"}) + "\n")
    q = journal.tail(spark, str(tmp_path / "in"), own_unit="me", begin="start").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [bytes(r.raw) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [b"hi"]

import random
import socket

import pytest
from pyspark.sql import functions as F

from timberline.sources.sockets import Frames, TcpReader, UdpReader
from timberline.sources.store import Store, corrected, pages
from timberline.streaming.jobs import upsert


def test_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("verdicts", "template_id string, severity double").count() == 0
    rows = spark.createDataFrame([("t1", 1.0, 2), ("t1", 2.0, 1), ("t2", 3.0, 1)], "template_id string, severity double, judged_at int")
    store.judged(rows.select("template_id", F.col("judged_at").alias("recorded_at")), rows)
    assert [r.severity for r in store.of_template("verdicts", "t1", "judged_at").collect()] == [2.0, 1.0]
    assert store.read("records", "x int").count() == 3
    store.merges(spark.createDataFrame([("b", "a", "tb", "ta")], "id_lo string, id_hi string, template_lo string, template_hi string"))
    assert tuple(store.read("merges", "x int").first()) == ("a", "b", "ta", "tb")
    fix = spark.createDataFrame([("t1", None, 0.5)], "template_id string, severity double, contextual double")
    assert {(r.template_id, r.severity) for r in corrected(rows, fix.drop("contextual")).collect()} == {("t1", 1.0), ("t1", 2.0), ("t2", 3.0)}


def test_alarm_feed_into_a_table(spark, tmp_path):
    feed = [("a", 1, "Raised", 1, "Page"), ("a", 2, "Updated", 2, "Page"), ("b", 1, "Raised", 1, "Dashboard"), ("b", 9, "Cleared", 1, "Dashboard")]
    rows = spark.createDataFrame(feed, "alarm_id string, at_sec long, op string, count long, lane string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    store, sent = Store(spark, str(tmp_path / "store")), []
    upsert(stream(), store.alarm_sink()).trigger(availableNow=True).start().awaitTermination()
    pages(stream(), sent.extend).trigger(availableNow=True).start().awaitTermination()
    assert [(r.alarm_id, r["count"]) for r in store.open_alarms().collect()] == [("a", 2)]
    assert [s["alarm_id"] for s in sent] == ["a"]


def test_compaction_keeps_what_is_open(spark, tmp_path):
    """Snapshots and later changes show what all changes do; files read and kept stay bounded."""
    rng = random.Random(1)
    plain, store = Store(spark, str(tmp_path / "plain")), Store(spark, str(tmp_path / "compacted"))
    kind, at, last = "alarm_id string, at_sec long, op string, count long, lane string", 0, {}
    for batch in range(24):
        rows = []
        for _ in range(3):
            at += rng.choice([1, 100, 400])
            name = f"a{rng.randint(0, 9)}"
            # A cleared alarm comes again only within the cooldown.
            if last.get(name, ("", 0))[0] == "Cleared" and at - last[name][1] > 1800:
                name = f"new{at}"
            op = rng.choice(["Raised", "Updated", "Cleared"])
            last[name] = op, at
            rows.append((name, at, op, rng.randint(1, 9), "Dashboard"))
        for x in (plain, store):
            x.alarm_sink()(spark.createDataFrame(rows, kind).coalesce(1), batch)
        if batch % 4 == 3:
            before = [tuple(r) for r in store.open_alarms().collect()]
            assert store.compact(most_behind=6) == batch
            assert before == [tuple(r) for r in store.open_alarms().collect()]
    assert [tuple(r) for r in store.open_alarms().collect()] == [tuple(r) for r in plain.open_alarms().collect()] != []
    assert store.compact(most_behind=6) == 23
    assert len(list((tmp_path / "compacted/alarm_changes").glob("batch=*"))) == 6 and len(list((tmp_path / "compacted/alarm_snapshots").glob("through=*"))) == 2
    assert store.feed(0)[0] == "resync" and store.feed(20)[0] == "changes"


def test_sockets():
    f = Frames(10)
    assert f.feed(b"one\r\ntw") == [b"one"] and f.feed(b"o\n\n") == [b"two"]
    with pytest.raises(ValueError):
        f.feed(b"x" * 11)
    udp = UdpReader({"port": "0", "quota": "2"})
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for k in range(3):
            s.sendto(b"<13>m%d" % k, udp.socket.getsockname())
    rows, end = udp.read({"n": 5})
    assert [r[3] for r in rows] == [b"<13>m0", b"<13>m1"] and end == {"n": 7} and udp.shed.total == udp.shed.counts["over the quota of a second"] == 1
    tcp = TcpReader({"port": "0"})
    with socket.create_connection(tcp.server.getsockname()) as s:
        s.sendall(b"<13>a\n<13>b\n")
    rows, end = tcp.read({"n": 0})
    assert [r[3] for r in rows] == [b"<13>a", b"<13>b"] and end == {"n": 2}
    udp.socket.close()
    tcp.server.close()

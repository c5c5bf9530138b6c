"""One stream from raw lines to alarms: statistics line by line, many batches, a restart, hosts that are null."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from timberline.operators import alarms as A
from timberline.operators import windows as W
from timberline.runtime import new_folder
from timberline.streaming.lines import Rows, Statistics, alarm_feed, packed


def test_statistics_equal_the_batch(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for k in range(600):
        at += rng.choice([0, 0, 1, 7, 60, 299, 300, 3601])
        rows.append((k, "t", rng.choice(["a", "b", "c", None]), at))
    df = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long")
    for forget in (False, True):
        lines, by = (W.idle_reset(df), ("template_id", "session")) if forget else (df, ("template_id",))
        want = {r.event_id: (r.short_total, r.long_total, r.distinct_hosts, r.span_secs) for r in W.window_stats(lines, by=by).collect()}
        stats = Statistics()
        assert {k: stats.see(sec, host, W.WindowConfig(), forget) for k, _, host, sec in rows} == want


def test_many_batches_and_a_restart(spark, tmp_path):
    """Lines arrive in files out of order, and the stream stops and starts between them."""
    rng = random.Random(3)
    began = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows, at = [], 0
    for k in range(500):
        at += rng.choice([1, 2, 30, 200, 1000])
        rows.append((k, rng.choice(["t1", "t2", "none"]), rng.choice(["a", "b", None]), began + timedelta(seconds=at, milliseconds=rng.randint(0, 999))))
    schema = "event_id long, template_id string, host string, received_at timestamp"
    verdicts = spark.createDataFrame([("t1", 3.0, 0.9, 0.1), ("t2", 1.0, 0.9, 0.9)], "template_id string, severity double, actionable double, contextual double")
    answers = spark.createDataFrame([(k, 7, k % 10 / 10, k % 7 / 6) for k in range(0, 500, 2)], "event_id long, delay_sec long, matters_now double, wake_someone double")
    origin = int(began.timestamp() * 1_000_000)
    lines = spark.createDataFrame(rows, schema).withColumn("template", F.col("template_id")).withColumn("raw", F.lit("x"))
    lines = lines.withColumn("sec", F.floor((F.unix_micros("received_at") - origin) / 1_000_000)).withColumn("template_id", F.col("template_id"))
    want = A.contextual_changelog(A.gated(W.window_stats(lines).join(verdicts, "template_id", "left")), answers)
    want = {(r.alarm_id, r.at_sec, r.event_id, r.op, r["count"], r.lane) for r in want.collect()}
    # Parts of 50 lines, shuffled within themselves, each after the last.
    folder, out = str(tmp_path / "in"), new_folder(spark, "feed")
    (tmp_path / "in").mkdir()
    stream = alarm_feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), verdicts, answers=answers, origin_us=origin, lateness="0 seconds")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    for half in (rows[:250], rows[250:]):
        for k in range(0, 250, 50):
            part = half[k : k + 50]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = [(r.alarm_id, r.at_sec, r.event_id, r.op, r["count"], r.lane) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    end = max(r[1] for r in got)
    assert len(got) == len(set(got)) and set(got) <= want and all(r[1] >= end - 1 or r[3] == "Cleared" for r in want - set(got)) and len(got) > 50


def test_verdicts_as_a_second_input(spark, tmp_path):
    """Verdicts land while lines stream by, some after a restart; the feed is the batch's."""
    rng = random.Random(8)
    began = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([1, 2, 30, 200, 700])
        rows.append((k, rng.choice(["t1", "t2", "t3", "never"]), rng.choice(["a", "b", None]), at))
    half = rows[200][3]
    landed = [("t1", rows[60][3], 3.0, 0.9, 0.1), ("t2", rows[90][3], 2.0, 0.9, 0.1), ("t3", rows[240][3], 3.0, 0.9, 0.1), ("t2", rows[300][3], 3.0, 0.9, 0.1), ("t1", rows[320][3], 0.0, 0.0, 0.0)]
    time = lambda sec: began + timedelta(seconds=sec)
    lines = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long").withColumn("template", F.col("template_id")).withColumn("raw", F.lit("x"))
    verdicts = spark.createDataFrame(landed, "template_id string, landed_sec long, severity double, actionable double, contextual double")
    answers = spark.createDataFrame([], "event_id long, delay_sec long, matters_now double, wake_someone double")
    want = A.contextual_changelog(A.as_verdicts_arrive(W.window_stats(lines), verdicts), answers).collect()
    kinds = "event_id long, template_id string, host string, received_at timestamp", "template_id string, landed_at timestamp, severity double, actionable double, contextual double"
    for name in ("lines", "verdicts"):
        (tmp_path / name).mkdir()
    source = [spark.readStream.schema(k).parquet(str(tmp_path / n)) for k, n in zip(kinds, ("lines", "verdicts"), strict=True)]
    feed = alarm_feed(*source, origin_us=int(began.timestamp() * 1_000_000), lateness="0 seconds")
    out = new_folder(spark, "feed")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    for part in (lambda sec: sec < half, lambda sec: sec >= half):
        spark.createDataFrame([(e, t, h, time(s)) for e, t, h, s in rows if part(s)], kinds[0]).write.mode("append").parquet(str(tmp_path / "lines"))
        spark.createDataFrame([(t, time(s), *x) for t, s, *x in landed if part(s)], kinds[1]).write.mode("append").parquet(str(tmp_path / "verdicts"))
        feed.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    key = lambda r: (r.alarm_id, r.at_sec, r.event_id, r.op, r["count"], r["rank"], r.lane)
    got = [key(r) for r in spark.read.schema(feed.schema).parquet(out).collect()]
    missing = set(map(key, want)) - set(got)
    assert len(got) == len(set(got)) > 40 and set(got) <= set(map(key, want)) and all(r[3] == "Cleared" or r[1] >= rows[-1][3] for r in missing)
    assert sum(r[2] is None and r[3] == "Raised" for r in got) >= 4


def test_held_rows_are_columns_and_come_in_order(spark):
    """Entries of held rows, with null hosts and events, are one table in order of (second, event), and can be held again."""
    rows = [(1000 * (k % 7), k % 7, None if k == 5 else k, ("a", "b", None)[k % 3], k % 2, 3, True, k % 2 == 0, False, None if k % 4 else k, k / 10, None) for k in range(20)]
    names = ["at_ms", "sec", "event_id", "host", "kind", "rank", "gated", "bypass", "flagged", "delay_sec", "matters_now", "wake_someone"]
    parts = [pd.DataFrame(rows[:9], columns=names), pd.DataFrame(rows[9:], columns=names)]
    held = Rows(map(packed, parts))
    want = [(s, e, h, k, r, g, b, f, None if d is None else (d, m, w)) for _, s, e, h, k, r, g, b, f, d, m, w in sorted(rows, key=lambda x: (x[1], -1 if x[2] is None else x[2]))]
    every = held.order(np.ones(20, dtype=bool))
    assert list(held.tuples(every)) == want
    again = Rows(packed(held.frame(every[k : k + 6])) for k in range(0, 20, 6))
    assert list(again.tuples(again.order(np.ones(20, dtype=bool)))) == want

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import alarms as A
from timberline.operators import board
from timberline.operators import verdicts as V
from timberline.operators import windows as W

LINE = "event_id long, template_id string, template string, raw string, host string, sec long, severity double, actionable double, contextual double"


def simulate_windows(rows):
    """Straight from the definition: all earlier lines are looked at again."""
    out, seen = {}, []
    for event, tpl, host, sec in sorted(rows, key=lambda r: (r[3], r[0])):
        seen.append((event, tpl, host, sec))
        own = [r for r in seen if r[1] == tpl]
        first = own[0][3]
        out[event] = (
            sum(r[3] // 10 > sec // 10 - 30 for r in own), sum(r[3] // 60 > sec // 60 - 60 for r in own),
            len({r[2] for r in own if sec - r[3] < 300 and r[2] is not None}), first, min(sec - first, 3600),
        )
    return out


def simulate_alarms(rows, silence, cooldown):
    """(first event, count, episodes) of the alarms of one key's (sec, event, trig) lines."""
    found, alarm, cleared = [], None, None
    for sec, event, trig in sorted(rows):
        if alarm and sec - alarm[1] > silence:
            cleared, alarm = (alarm[1] + silence, alarm[0]), None
        if alarm:
            alarm[0][1] += 1
            alarm[1] = sec
        elif trig:
            if cleared and sec - cleared[0] <= cooldown:
                a = cleared[1]
                a[1] += 1
                a[2] += 1
            else:
                a = [event, 1, 1]
                found.append(a)
            alarm, cleared = [a, sec], None
    return sorted(map(tuple, found))


def test_windows_equal_a_simulation(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("aaab"), rng.choice(["h1", "h2", "h3", None]), rng.randint(0, 9000)) for k in range(700)]
    df = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long")
    got = {r.event_id: (r.short_total, r.long_total, r.distinct_hosts, r.first_seen_secs, r.span_secs) for r in W.window_stats(df).collect()}
    assert got == simulate_windows(rows)
    assert W.window_stats(df.limit(0)).count() == 0


def test_windows_forget_idle_templates(spark):
    """Sessions are those of gaps looked at line by line, and windows by session start anew."""
    rng = random.Random(7)
    rows, at = [], {"a": 0, "b": 5, None: 9}
    for k in range(400):
        t = rng.choice(["a", "b", None])
        at[t] += rng.choice([0, 3, 40, 900, 3599, 3600, 3601, 9000])
        rows.append((k, t, rng.choice(["h1", "h2", None]), at[t]))
    df = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long").withColumn("k", F.lit("own")).withColumn("b", F.lit(1))
    session, last, want = {}, {}, {}
    for event, t, _, sec in sorted(rows, key=lambda r: (r[3], r[0])):
        session[t] = session.get(t, 0) + (t in last and sec - last[t] > 3600)
        last[t], want[event] = sec, session[t]
    with_sessions = W.idle_reset(df)
    assert with_sessions.columns == [*df.columns, "session"]
    assert {r.event_id: r.session for r in with_sessions.collect()} == want
    got = {r.event_id: (r.short_total, r.long_total, r.distinct_hosts, r.first_seen_secs, r.span_secs) for r in W.window_stats(with_sessions, by=("template_id", "session")).collect()}
    assert got == simulate_windows([(e, (t, want[e]), h, s) for e, t, h, s in rows])


@pytest.mark.parametrize("config", [W.WindowConfig(short_bucket=7, short_buckets=4, long_bucket=45, long_buckets=3, host_span=100), W.WindowConfig(host_span=7)])
def test_windows_of_any_shape(spark, config):
    """Buckets that do not nest, and hosts' windows of any length."""
    rng = random.Random(9)
    rows = [(k, "t", rng.choice(["h1", "h2", "h3"]), rng.randint(0, 2000)) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long")
    got = {r.event_id: (r.short_total, r.long_total, r.distinct_hosts) for r in W.window_stats(df, config).collect()}
    ordered = sorted((r[3], r[0], r[2]) for r in rows)
    for n, (sec, event, _) in enumerate(ordered):
        seen = ordered[: n + 1]
        short = sum(s // config.short_bucket > sec // config.short_bucket - config.short_buckets for s, _, _ in seen)
        long = sum(s // config.long_bucket > sec // config.long_bucket - config.long_buckets for s, _, _ in seen)
        assert got[event] == (short, long, len({h for s, _, h in seen if sec - s < config.host_span}))


@pytest.mark.parametrize("silence, cooldown", [(900, 1800), (300, 600), (10, 0), (60, 5000)])
def test_alarms_equal_a_simulation(spark, silence, cooldown):
    rng = random.Random(silence)
    rows, sec = [], 0
    for k in range(400):
        sec += rng.choice([0, 1, 5, 20, 200, 700, 2500])
        rows.append((k, "t", "t", f"raw {k}", "h", sec, 2, rng.random() < 0.3))
    df = spark.createDataFrame(rows, "event_id long, template_id string, template string, raw string, host string, sec long, rank int, trig boolean")
    c = A.AlarmConfig(silence=silence, cooldown=cooldown)
    got = A.alarms(df, c).withColumn("first", F.regexp_extract("exemplar", r"\d+", 0).cast("int"))
    assert sorted((r.first, r["count"], r.episodes) for r in got.collect()) == simulate_alarms([(r[5], r[0], r[7]) for r in rows], silence, cooldown)
    log = A.changelog(df, c).groupBy("op").count()
    counts = {r.op: r["count"] for r in log.collect()}
    assert counts["Raised"] == counts["Cleared"] == got.agg(F.sum("episodes")).first()[0]
    # The keyed machine gives the same feed where nothing is contextual.
    lines = df.withColumns({"contextual": F.lit(0.0), "short_total": F.when(F.col("trig"), 5).otherwise(0), "long_total": F.lit(1), "span_secs": F.lit(0)})
    none = spark.createDataFrame([], "event_id long, delay_sec long, matters_now double, wake_someone double")
    feed = A.contextual_changelog(lines, none, c).select("alarm_id", "at_sec", "event_id", "op", "count").collect()
    assert set(map(tuple, feed)) == set(map(tuple, A.changelog(df, c).select("alarm_id", "at_sec", "event_id", "op", "count").collect()))


def judged(spark, *lines):
    """Lines as (sec, host, severity, contextual)."""
    return spark.createDataFrame([(k, "t", "t", f"raw {k}", h, s, sev, 0.9, ctx) for k, (s, h, sev, ctx) in enumerate(lines)], LINE)


def test_scenarios(spark):
    quiet = judged(spark, *[(k * 400, "a", 1.0, 0.0) for k in range(4)])
    assert A.alarms(A.gated(W.window_stats(quiet))).count() == 0
    burst = judged(spark, *[(k, "a", 1.0, 0.0) for k in range(6)])
    assert [r["count"] for r in A.alarms(A.gated(W.window_stats(burst))).collect()] == [2]
    critical = judged(spark, (0, "a", 3.0, 0.0), (1, "b", 3.0, 0.0), (2, "a", None, None))
    rows = A.alarms(A.gated(W.window_stats(critical)), now=F.lit(5)).collect()
    assert {(r.host, r.severity, r.open) for r in rows} == {("a", "critical", True), ("b", "critical", True)}
    assert A.alarms(A.gated(W.window_stats(quiet), A.CLASSIFY_ALL), A.CLASSIFY_ALL).count() == 1


@pytest.mark.parametrize(
    "answer, want",
    [((0.9, 0.94), ["Page"]), ((0.9, 0.61), ["Dashboard"]), ((0.9, 0.2), []), ((0.1, 0.99), []), (None, ["Dashboard"])],
)
def test_contextual_checks(spark, answer, want):
    lines = A.gated(W.window_stats(judged(spark, (0, "a", 3.0, 0.9), (2, "a", 3.0, 0.9), (50, "a", 3.0, 0.9))))
    rows = [(0, 5, *answer)] if answer else []
    table = spark.createDataFrame(rows, "event_id long, delay_sec long, matters_now double, wake_someone double")
    feed = A.contextual_changelog(lines, table).orderBy("at_sec").collect()
    assert [r.lane for r in feed if r.op == "Raised"] == want
    if want:
        # The line during the check is not counted, the one after is.
        assert [r["count"] for r in feed if r.op == "Updated"] == [2]


def test_first_judgment(spark):
    seen = spark.sql("SELECT 't' AS template_id, h AS host, timestamp'2024-01-01' AS received_at FROM VALUES ('a'), ('b') AS x(h)")
    v = spark.sql("SELECT 't' AS template_id, 3.0D AS severity, 0.9D AS actionable, timestamp'2024-01-02' AS judged_at")
    assert {(r.host, r.exemplar, r.severity) for r in A.first_judgments(seen, v).collect()} == {("a", "", "critical"), ("b", "", "critical")}
    assert A.first_judgments(seen, v.withColumn("severity", F.lit(2.0))).count() == 0


def test_verdict_functions(spark):
    df = spark.createDataFrame([(-0.6, 0.95), (0.4, 0.9), (0.5, 0.6), (1.5, 0.59), (2.5, None), (None, 0.1)], "s double, w double")
    rows = df.select(V.severity_of(F.col("s")).alias("v"), V.lane(F.col("w")).alias("l")).collect()
    assert [r.v for r in rows] == ["info", "info", "minor", "major", "critical", None]
    assert [r.l for r in rows] == ["Page", "Page", "Dashboard", "Record", "Dashboard", "Record"]
    assert V.questions_hash({"b": 1, "a": 2}) == V.questions_hash({"a": 2, "b": 1}) and len(V.questions_hash({})) == 32


def test_judge_and_board(spark):
    t = spark.createDataFrame([("t1", "disk error"), ("t2", "odd")], "template_id string, template string")
    decider = V.TableDecider({"disk error": {"severity": {"score": 3.0}, "actionable": {"noul": 0.9}}})
    rows = V.judge(t, decider)
    assert {(r.template_id, r.failed) for r in rows.collect()} == {("t1", False), ("t2", True)}
    v = V.verdict_of(rows, "b1", F.current_timestamp()).first()
    assert (v.template_id, v.severity, v.actionable, v.contextual) == ("t1", 3.0, 0.9, None)
    a = spark.createDataFrame([("1", "x", "h", "major", "Page", 3), ("2", "y", "g", "critical", "Dashboard", 1)], "alarm_id string, template string, host string, severity string, lane string, count long")
    assert board.totals(a).first().asDict() == {"open": 2, "critical": 1, "paging": 1, "hosts": 2}
    assert [(r.severity, r.n) for r in board.by_severity(a).collect()] == [("critical", 1), ("major", 1), ("minor", 0), ("info", 0)]
    assert [r.alarm_id for r in board.filtered(a, text="X H").collect()] == ["1"]


def simulate_arrivals(rows, verdicts, c):
    """Alarms (key, first event, count) line by line: an unjudged line waits, a first verdict raises for those that wait."""
    found, state, waiting, judged = [], {}, {}, {}
    marks = [(sec, -1, "v", tpl, (sev, act)) for tpl, sec, sev, act in verdicts] + [(sec, event, "l", tpl, (host, trig)) for event, tpl, host, sec, trig in rows]

    def settle(key, sec):
        alarm, cleared = state.get(key, (None, None))
        if alarm and sec - alarm[1] > c.silence:
            alarm, cleared = None, (alarm[1] + c.silence, alarm[0])
        return alarm, cleared

    def raise_(key, event, sec):
        a = [key, event, 1]
        found.append(a)
        state[key] = ([a, sec], None)

    for sec, event, kind, tpl, what in sorted(marks, key=lambda m: m[:3]):
        if kind == "v":
            if tpl not in judged and what[0] >= 3 and what[1] >= 0.5:
                for host in waiting.get(tpl, ()):
                    if settle((tpl, host), sec)[0] is None:
                        raise_((tpl, host), None, sec)
            judged[tpl] = what
            continue
        host, hot = what
        if tpl not in judged:
            waiting.setdefault(tpl, set()).add(host)
            continue
        severity, actionable = judged[tpl]
        if severity < 1 or actionable < 0.5:
            continue
        key, trig = (tpl, host), hot or severity >= 3
        alarm, cleared = settle(key, sec)
        if alarm:
            alarm[0][2] += 1
            state[key] = ([alarm[0], sec], None)
        elif trig and cleared and sec - cleared[0] <= c.cooldown:
            cleared[1][2] += 1
            state[key] = ([cleared[1], sec], None)
        elif trig:
            raise_(key, event, sec)
        else:
            state[key] = (None, cleared)
    return sorted((k[0], str(k[1]), -1 if e is None else e, n) for k, e, n in found)


def arriving(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for k in range(500):
        at += rng.choice([0, 1, 40, 300, 500])
        rows.append((k, rng.choice("abcd"), rng.choice(["h1", "h2", None]), at))
    verdicts = [("a", rows[150][3], 3.0, 0.9), ("b", rows[100][3], 2.0, 0.9), ("c", rows[200][3], 3.0, 0.1), ("a", rows[300][3], 0.0, 0.9), ("b", rows[350][3], 3.0, 0.9)]
    return rows, verdicts


def test_verdicts_that_arrive_equal_a_simulation(spark):
    """An alarm of a first verdict counts on, clears and revives; a second verdict only changes the gate."""
    rows, verdicts = arriving(spark, 5)
    stats = simulate_windows(rows)
    hot = lambda e: stats[e][0] >= 5 or (stats[e][4] >= 300 and stats[e][0] / 300 >= 3 * stats[e][1] / stats[e][4])
    df = spark.createDataFrame([(e, t, f"line {t}", f"raw {e}", h, s) for e, t, h, s in rows], "event_id long, template_id string, template string, raw string, host string, sec long")
    v = spark.createDataFrame([(*x, 0.1) for x in verdicts], "template_id string, landed_sec long, severity double, actionable double, contextual double")
    for c in (A.AlarmConfig(silence=500, cooldown=900), A.AlarmConfig(silence=60, cooldown=2000)):
        lines = A.as_verdicts_arrive(W.window_stats(df), v, c).cache()
        want = simulate_arrivals([(*r, hot(r[0])) for r in rows], verdicts, c)
        log = A.contextual_changelog(lines, spark.createDataFrame([], "event_id long, delay_sec long, matters_now double, wake_someone double"), c).collect()
        first = {}
        for r in sorted((r for r in log if r.op != "Cleared"), key=lambda r: r["count"]):
            first.setdefault(r.alarm_id, r)
        last = {r.alarm_id: r["count"] for r in sorted(log, key=lambda r: r["count"])}
        assert sorted((r.template_id, str(r.host), -1 if r.event_id is None else r.event_id, last[a]) for a, r in first.items()) == want
        islands_ = A.alarms(lines, c).collect()
        assert sorted((r.template_id, str(r.host), r["count"]) for r in islands_) == sorted((a, b, n) for a, b, _, n in want)
        assert {r.exemplar for r in islands_ if r.opened_sec == verdicts[0][1] and r.template_id == "a"} == {""}


def test_a_verdict_noticed_late_skips_open_keys(spark):
    df = spark.createDataFrame([(1, "a", "t", "r1", "h1", 0), (2, "a", "t", "r2", "h2", 0), (3, "a", "t", "r3", "h1", 20)], "event_id long, template_id string, template string, raw string, host string, sec long")
    v = spark.createDataFrame([("a", 10, 30, 3.0, 0.9, 0.0)], "template_id string, landed_sec long, noticed_sec long, severity double, actionable double, contextual double")
    got = A.alarms(A.as_verdicts_arrive(W.window_stats(df), v)).collect()
    assert sorted((r.host, r.opened_sec, r["count"], r.exemplar) for r in got) == [("h1", 20, 1, "r3"), ("h2", 30, 1, "")]


@pytest.mark.parametrize("most, steps", [(65_536, [0, 5, 59, 60, 900]), (65_536, [0, 400, 2000, 3600]), (4, [0, 5, 60, 900]), (2, [0, 1, 700]), (1, [0, 61, 3601])])
def test_eviction_equals_a_simulation(spark, most, steps):
    """The table is swept only as a template without a window comes, and cut when it is full."""
    rng = random.Random(most + len(steps))
    rows, at = [], 0
    for k in range(500):
        at += rng.choice(steps)
        rows.append((k, rng.choice(["a", "a", "b", "c", "d", None, f"t{rng.randint(0, 30)}"]), "h", at))
    windows, swept, number, want, kept = {}, 0, {}, {}, 0
    for event, tpl, _, sec in rows:
        if tpl not in windows:
            if len(windows) >= most:
                for t in sorted(windows, key=lambda t: windows[t])[: len(windows) - most + 1]:
                    del windows[t]
            elif sec - swept >= 60:
                swept = sec
                windows = {t: w for t, w in windows.items() if sec - w[0] <= 3600}
            number[tpl] = number.get(tpl, -1) + 1
        elif sec - windows[tpl][0] > 3600:
            kept += 1
        windows[tpl] = (sec, event)
        want[event] = number[tpl]
    df = spark.createDataFrame(rows, "event_id long, template_id string, host string, sec long").withColumn("k", F.lit(1)).withColumn("new", F.lit("x"))
    out = W.evicted(df, most=most)
    assert out.columns == [*df.columns, "session"] and {r.event_id: r.session for r in out.collect()} == want
    assert max(want.values()) > 0 and W.evicted(df.limit(0)).count() == 0

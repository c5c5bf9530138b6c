"""From raw lines to alarms in one stream: statistics, contextual checks and the change feed by keyed state.

A template's lines are held back until the watermark passes and are then taken in order
of (received_at, event_id), one state for its windows and one for each of its hosts. An
``availableNow`` run gives what ``windows.window_stats``, ``alarms.gated`` and
``alarms.contextual_changelog`` give, but for what falls due after the last line.
"""

from __future__ import annotations

import pickle
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alarms import CHANGES, AlarmConfig, Key, Machine
from ..operators.verdicts import contextual, gate, severity_of
from ..operators.windows import WindowConfig
from ..runtime import importable, ship
from ..schema import severity_rank

#: The state store that keyed processors with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are taken, given out and held again at once.
TAKEN = 100_000
#: Kinds of held rows: a line with its verdict, a line that takes the verdict of its time, a verdict that lands.
JUDGED, WAITING, VERDICT = 0, 1, 2


class Statistics:
    """The sliding statistics of one template, line by line in order: its buckets with their sums, and its hosts' last seconds."""

    def __init__(self) -> None:
        self.first: int | None = None
        self.last = 0
        self.short: deque[list[int]] = deque()
        self.long: deque[list[int]] = deque()
        self.sums = [0, 0]
        self.hosts: dict[str, int] = {}

    def see(self, sec: int, host: str | None, c: WindowConfig, forget: bool = False) -> tuple[int, int, int, int]:
        """short_total, long_total, distinct_hosts and span_secs; with ``forget``, an idle template starts anew."""
        if forget and self.first is not None and sec - self.last > c.idle:
            self.__init__()
        self.first = sec if self.first is None else self.first
        self.last = sec
        for k, buckets, size, reach in ((0, self.short, c.short_bucket, c.short_buckets), (1, self.long, c.long_bucket, c.long_buckets)):
            b = sec // size
            while buckets and buckets[0][0] <= b - reach:
                self.sums[k] -= buckets.popleft()[1]
            if buckets and buckets[-1][0] == b:
                buckets[-1][1] += 1
            else:
                buckets.append([b, 1])
            self.sums[k] += 1
        if host is not None:
            self.hosts.pop(host, None)
            self.hosts[host] = sec
        # Hosts are in order of their last second.
        while self.hosts and sec - next(iter(self.hosts.values())) >= c.host_span:
            del self.hosts[next(iter(self.hosts))]
        return *self.sums, len(self.hosts), min(sec - self.first, c.longest_span)


def hot(short: int, long: int, span: int, c: WindowConfig) -> bool:
    return short >= c.count_rule or (span >= c.rate_span and short / c.rate_span >= c.rate_factor * long / span)


def changes(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")], dtype=object)


def packed(part: pd.DataFrame) -> bytes:
    """Rows as columns of numbers; hosts and events that are null are marked."""
    names = pd.Categorical(part["host"])
    event = part["event_id"]
    columns = {
        "at_ms": part["at_ms"].to_numpy(np.int64), "sec": part["sec"].to_numpy(np.int64), "event_id": event.fillna(-1).to_numpy(np.int64), "none": event.isna().to_numpy(bool),
        "host": names.codes.astype(np.int32), "kind": part["kind"].to_numpy(np.int8), "rank": part["rank"].to_numpy(np.int8),
        **{c: part[c].to_numpy(bool) for c in ("gated", "bypass", "flagged")}, **{c: part[c].to_numpy(np.float64, na_value=np.nan) for c in ("delay_sec", "matters_now", "wake_someone")},
    }
    return zlib.compress(pickle.dumps((list(names.categories), columns), protocol=5), 1)


class Rows:
    """Held rows, of any number of entries, as columns."""

    def __init__(self, entries: Iterator[bytes]):
        self.hosts: dict[str, int] = {}
        parts = []
        for data in entries:
            names, columns = pickle.loads(zlib.decompress(data))
            # The last place is for null.
            own = np.array([*(self.hosts.setdefault(h, len(self.hosts)) for h in names), -1], dtype=np.int32)
            parts.append(columns | {"host": own[columns["host"]]})
        self.columns = {c: np.concatenate([p.pop(c) for p in parts]) for c in list(parts[0])} if parts else {}
        self.names = [*self.hosts, None]

    def __len__(self) -> int:
        return len(self.columns["sec"]) if self.columns else 0

    def order(self, which: np.ndarray) -> np.ndarray:
        """The places of rows by (sec, event, time); a verdict comes before the lines of its second."""
        at = np.flatnonzero(which)
        c = self.columns
        return at[np.lexsort((c["at_ms"][at], c["event_id"][at], c["sec"][at]))]

    def frame(self, at: np.ndarray) -> pd.DataFrame:
        c = {k: v[at] for k, v in self.columns.items()}
        event = pd.Series(c["event_id"], dtype="Int64").mask(c.pop("none"))
        return pd.DataFrame(c | {"host": np.array(self.names, dtype=object)[c["host"]], "event_id": event})

    def tuples(self, at: np.ndarray) -> Iterator[tuple]:
        c = {k: v[at].tolist() for k, v in self.columns.items()}
        number = lambda x: None if x != x else x
        for row in zip(*(c[k] for k in ("sec", "event_id", "none", "host", "kind", "rank", "gated", "bypass", "flagged", "delay_sec", "matters_now", "wake_someone")), strict=True):
            sec, event, none, host, kind, rank, gated, bypass, flagged, delay, matters, wake = row
            answer = None if delay != delay else (int(delay), number(matters), number(wake))
            yield sec, None if none else event, self.names[host], kind, rank, gated, bypass, flagged, answer


class LineAlarms(StatefulProcessor):
    """One template's lines: held rows, statistics, and a machine for each host."""

    def __init__(self, c: AlarmConfig, origin_us: int, squeeze: int, forget: bool):
        self.c, self.origin_us, self.squeeze, self.forget = c, origin_us, squeeze, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "data binary")
        self.stats = handle.getValueState("stats", "data binary")
        self.hosts = handle.getMapState("hosts", "host string", "data binary")
        self.verdict = handle.getValueState("verdict", "rank int, gated boolean, bypass boolean, flagged boolean")
        self.unjudged = handle.getMapState("unjudged", "host string", "seen boolean")

    def close(self) -> None:
        pass

    def second(self, at_ms: int) -> int:
        return (at_ms * 1000 - self.origin_us) // (1_000_000 * self.squeeze)

    def millis(self, second: int) -> int:
        """The first millisecond of a second."""
        return -(-(self.origin_us + second * 1_000_000 * self.squeeze) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            if len(part):
                self.held.appendValue((packed(part),))
                first.append(int(part["at_ms"].min()))
        # What was held before has its timer.
        self.wake(timerValues.getCurrentWatermarkInMs(), min(first, default=None))
        yield pd.DataFrame(columns=[f.split()[0] for f in CHANGES.split(", ")])

    def wake(self, mark: int, *at: int | None) -> None:
        """A timer fires once the watermark is past it."""
        times = [max(t - 1, mark + 1) for t in at if t is not None]
        if times:
            self.handle.registerTimer(min(times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = Rows(x[0] for x in self.held.get())
        early = held.columns["at_ms"] <= mark if len(held) else np.zeros(0, dtype=bool)
        ready, rest = (held.order(early), held.order(~early)) if len(held) else (early, early)
        self.held.clear()
        for k in range(0, len(rest), TAKEN):
            self.held.appendValue((packed(held.frame(rest[k : k + TAKEN])),))
        rest_ms, rest_sec = (int(held.columns["at_ms"][rest].min()), int(held.columns["sec"][rest[0]])) if len(rest) else (None, None)
        stats = pickle.loads(self.stats.get()[0]) if self.stats.exists() else Statistics()
        machines: dict[str | None, Machine] = {}

        def machine(host: str | None) -> Machine:
            if host not in machines:
                machines[host] = Machine(key[0], host, self.c)
                kept = (host or "", host is None)
                name = "-" if kept[1] else "+" + kept[0]
                if self.hosts.containsKey((name,)):
                    machines[host].k = pickle.loads(self.hosts.getValue((name,))[0])
            return machines[host]

        out: list[tuple] = []
        waiting: set[str | None] = set()
        verdict = tuple(self.verdict.get()) if self.verdict.exists() else None
        c = self.c.windows
        for sec, event, host, kind, rank, gated, bypass, flagged, answer in (r for k in range(0, len(ready), TAKEN) for r in held.tuples(ready[k : k + TAKEN])):
            if kind == VERDICT:
                if verdict is None:
                    for (name,) in list(self.unjudged.keys()):
                        if gated and bypass:
                            out += machine(None if name == "-" else name[1:]).judged(sec, rank)
                    self.unjudged.clear()
                verdict = rank, gated, bypass, flagged
                self.verdict.update(verdict)
                continue
            short, long, _, span = stats.see(sec, host, c, self.forget)
            if kind == WAITING:
                if verdict is None:
                    if host not in waiting:
                        waiting.add(host)
                        self.unjudged.updateValue(("-" if host is None else "+" + host,), (True,))
                    continue
                rank, gated, bypass, flagged = verdict
            if gated:
                out += machine(host).line(sec, event, rank, bypass, hot(short, long, span, c), flagged, answer)
            if len(out) >= TAKEN:
                yield changes(out)
                out.clear()
        for (name,) in list(self.hosts.keys()):
            machine(None if name == "-" else name[1:])
        due: list[int] = []
        for host, m in machines.items():
            if rest_sec is None or rest_sec > self.second(mark):
                out += m.advance(self.second(mark))
            name = ("-" if host is None else "+" + host,)
            if m.k == Key():
                if self.hosts.containsKey(name):
                    self.hosts.removeKey(name)
                continue
            self.hosts.updateValue(name, (pickle.dumps(m.k),))
            if m.k.alarm:
                due.append(m.k.last + self.c.silence + 1)
            if m.k.pending:
                due.append(m.k.pending[0])
        if len(ready):
            self.stats.update((pickle.dumps(stats),))
        self.wake(mark, rest_ms, *(self.millis(d) for d in due))
        yield changes(out)


def alarm_feed(
    lines: DataFrame, verdicts: DataFrame, c: AlarmConfig = AlarmConfig(), *, answers: DataFrame | None = None, origin_us: int = 0, squeeze: int = 1, lateness: str = "10 minutes", forget: bool = False
) -> DataFrame:
    """The change feed of a stream of classified lines (template_id, host, received_at, event_id).

    ``verdicts`` (template_id, severity, actionable, contextual) and ``answers``
    (event_id, delay_sec, matters_now, wake_someone) are tables that the stream is joined
    to; a flagged line without an answer fails its check. ``sec`` is the time since
    ``origin_us`` in seconds of ``squeeze`` seconds. Lines of templates without a
    verdict raise nothing. Sets the session's state store to one with timers.

    With a column ``landed_at``, verdicts (as many as a template gets, a table or a
    stream) are a second input of the keyed state: each holds from then on, and a first
    one raises for the hosts that were waiting, as ``alarms.as_verdicts_arrive`` has it.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)
    rank = severity_rank(severity_of(F.col("severity")))
    arriving = "landed_at" in verdicts.columns
    if arriving:
        some = lines.select("template_id", "received_at", "event_id", "host", F.lit(WAITING).alias("kind"))
        landed = verdicts.select("template_id", F.col("landed_at").alias("received_at"), F.lit(VERDICT).alias("kind"), "severity", "actionable", "contextual")
        judged = some.unionByName(landed, allowMissingColumns=True).withWatermark("received_at", lateness)
    else:
        known = verdicts.select("template_id", "severity", "actionable", "contextual")
        judged = lines.withWatermark("received_at", lateness).withColumn("kind", F.lit(JUDGED)).join(F.broadcast(known), "template_id")
    if answers is None:
        judged = judged.withColumns({"delay_sec": F.lit(None).cast("long"), "matters_now": F.lit(None).cast("double"), "wake_someone": F.lit(None).cast("double")})
    else:
        judged = judged.join(answers.select("event_id", "delay_sec", "matters_now", "wake_someone"), "event_id", "left")
    rows = judged.select(
        "template_id", "received_at", F.unix_millis("received_at").alias("at_ms"),
        F.floor((F.unix_micros("received_at") - origin_us) / (1_000_000 * squeeze)).alias("sec"), "event_id", "host", "kind",
        F.coalesce(rank, F.lit(0)).cast("int").alias("rank"), gate(F.col("severity"), F.col("actionable"), c.floor, c.actionable).alias("gated"),
        F.coalesce(rank >= severity_rank(F.lit(c.bypass)), F.lit(False)).alias("bypass"), contextual(F.col("contextual"), c.contextual).alias("flagged"),
        "delay_sec", "matters_now", "wake_someone",
    )
    with importable(spark):
        return rows.groupBy("template_id").transformWithStateInPandas(LineAlarms(c, origin_us, squeeze, forget), CHANGES, "append", "EventTime")


def first_micros(spark: SparkSession, table: DataFrame, at: str = "ts") -> int:
    """When a table begins, as the origin of a stream over it."""
    return table.agg(F.min(F.unix_micros(F.col(at).cast("timestamp")))).first()[0] or 0

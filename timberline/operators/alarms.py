"""Alarms from judged lines: gaps and islands in batch, no state.

Once open, an alarm lives as long as its key's gated lines keep coming within the
silence interval. So it is the part of such an island from the first trigger on, and
episodes that follow one another within the cooldown are one alarm. Islands and alarms
are found from blocks of time, so that a (template, host) with a third of all lines is
dealt over as many tasks as it has blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from ..schema import severity_name, severity_rank
from .verdicts import as_of, contextual, gate, severity_of
from .windows import WindowConfig, triggered


@dataclass(frozen=True)
class AlarmConfig:
    silence: int = 900
    cooldown: int = 1800
    floor: str = "minor"
    actionable: float = 0.5
    bypass: str = "critical"
    contextual: float = 0.5
    matters: float = 0.5
    sticky_critical: bool = True
    windows: WindowConfig = field(default_factory=WindowConfig)


#: Every judged line raises, whatever its answers.
CLASSIFY_ALL = AlarmConfig(floor="info", actionable=0.0, bypass="info", contextual=float("inf"))
KEY = ("template_id", "host")


def gated(lines: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """The lines whose verdict passes, with ``rank`` of severity and ``trig``: whether the line may open an alarm."""
    rank = severity_rank(severity_of(F.col("severity")))
    return lines.filter(gate(F.col("severity"), F.col("actionable"), c.floor, c.actionable)).withColumns(
        {"rank": rank, "trig": (rank >= severity_rank(F.lit(c.bypass))) | triggered(c.windows)}
    )


def islands(gated_lines: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """(_key, _block, trig, episode, episode_no, alarm_no, ends): the blocks of each key that belong to an alarm.

    Blocks as long as the silence hold no gap longer than it, so that islands are told
    from the first and last second of each block, and no key's lines are ever ordered
    as a whole. ``trig`` is the place (sec, event_id) from which an island's lines are
    live, ``ends`` its last second.
    """
    place = F.struct("sec", "event_id")
    blocks = _blocked(gated_lines, c).groupBy("_key", "_block").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.min(F.when(F.col("trig"), place)).alias("trig"))
    order = Window.partitionBy("_key").orderBy("_block")
    blocks = blocks.withColumn("joined", F.coalesce(F.col("first") - F.lag("last").over(order) <= c.silence, F.lit(False)))
    blocks = blocks.withColumn("island", F.sum((~F.col("joined")).cast("long")).over(order))
    live = blocks.groupBy("_key", "island").agg(F.min("trig").alias("trig"), F.max("last").alias("ends")).filter("trig is not null")
    by_key = Window.partitionBy("_key").orderBy("island")
    apart = F.coalesce(F.col("trig.sec") - (F.lag("ends").over(by_key) + c.silence) > c.cooldown, F.lit(True))
    live = live.withColumns({"apart": apart, "episode_no": F.row_number().over(by_key).cast("long")}).withColumn("alarm_no", F.sum(F.col("apart").cast("long")).over(by_key))
    found = blocks.select("_key", "_block", "island", "last").join(live, ["_key", "island"]).filter(F.col("last") >= F.col("trig.sec"))
    return found.select("_key", "_block", "trig", F.col("trig.sec").alias("episode"), "episode_no", "alarm_no", "ends")


def _blocked(gated_lines: DataFrame, c: AlarmConfig) -> DataFrame:
    return gated_lines.select(F.struct(*KEY).alias("_key"), F.floor(F.col("sec") / max(1, c.silence)).alias("_block"), *gated_lines.columns)


def _live(gated_lines: DataFrame, c: AlarmConfig) -> DataFrame:
    """The lines that belong to an alarm, with ``_key``, ``_block`` and what ``islands`` tells of their block."""
    marks = islands(gated_lines, c).withColumnRenamed("trig", "live_from")
    return _blocked(gated_lines, c).join(marks, ["_key", "_block"]).filter(F.struct("sec", "event_id") >= F.col("live_from"))


def episodes(gated_lines: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """The lines that belong to an alarm, with ``episode`` (its first second) and ``alarm_no`` within their key.

    ``gated_lines`` are read twice, once by a few columns; written ones are made once.
    """
    return _live(gated_lines, c).select(*gated_lines.columns, "episode", "episode_no", "alarm_no")


def alarm_id(first_event: Column) -> Column:
    return F.sha2(F.concat_ws("|", "template_id", "host", first_event.cast("string")), 256)


def alarms(gated_lines: DataFrame, c: AlarmConfig = AlarmConfig(), now: Column | None = None) -> DataFrame:
    """One row for each alarm. ``open`` where its silence had not passed at ``now`` (seconds; default: the last line)."""
    rows = episodes(gated_lines, c)
    found = rows.groupBy(*KEY, "alarm_no").agg(
        F.min(F.struct("sec", "event_id")).alias("first"), F.max("sec").alias("last_sec"), F.count(F.lit(1)).alias("count"), F.max("rank").alias("rank"),
        F.min_by("template", F.struct("sec", "event_id")).alias("template"), F.min_by("raw", F.struct("sec", "event_id")).alias("exemplar"),
        (F.max("episode_no") - F.min("episode_no") + 1).alias("episodes"),
    )
    found = found.select(
        alarm_id(F.col("first.event_id")).alias("alarm_id"), *KEY, "template", "exemplar", severity_name(F.col("rank")).alias("severity"), F.lit("Dashboard").alias("lane"),
        "count", "episodes", F.col("first.sec").alias("opened_sec"), "last_sec", (F.col("last_sec") + c.silence).alias("clears_sec"),
    )
    if now is None:
        return found
    return found.withColumn("open", F.col("clears_sec") >= now)


def open_alarms(found: DataFrame) -> DataFrame:
    """The alarms that are open, oldest first."""
    return found.filter("open").orderBy("opened_sec", "alarm_id")


def changelog(gated_lines: DataFrame, c: AlarmConfig = AlarmConfig(), now: Column | None = None) -> DataFrame:
    """(alarm_id, at_sec, event_id, op, count, severity): Raised for a start or a revival, Updated, Cleared.

    Lines are counted within their block; what an alarm had before comes from sums of blocks.
    """
    rows = _live(gated_lines, c)
    place = F.struct("sec", "event_id")
    blocks = rows.groupBy("_key", "_block", "alarm_no", "episode", "ends").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst"), F.min(place).alias("first"))
    before = Window.partitionBy("_key", "alarm_no").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key", "alarm_no")
    blocks = blocks.withColumns({
        "n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "worst_before": F.max("worst").over(before),
        "id": F.min("first").over(whole)["event_id"],
    })
    order = Window.partitionBy("_key", "_block").orderBy("sec", "event_id")
    dealt = rows.select("_key", "_block", "sec", "event_id", "rank", "live_from", *KEY).repartition("_key", "_block")
    counted = dealt.withColumns({"place": F.row_number().over(order), "so_far": F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    lines = counted.join(blocks.select("_key", "_block", "n_before", "worst_before", "id"), ["_key", "_block"])
    # Of lines with equal places, one raises.
    raised = F.col("place") == F.min(F.when(place == F.col("live_from"), F.col("place"))).over(Window.partitionBy("_key", "_block"))
    events = lines.withColumn("raised", raised).select(
        alarm_id(F.col("id")).alias("alarm_id"), F.col("sec").alias("at_sec"), "event_id", F.when(F.col("raised"), "Raised").otherwise("Updated").alias("op"),
        (F.col("n_before") + F.col("place")).alias("count"), severity_name(F.greatest("worst_before", "so_far")).alias("severity"),
    )
    ends = blocks.groupBy("_key", "alarm_no", "episode").agg(F.max_by(F.struct("id", "ends", (F.col("n_before") + F.col("n")).alias("n"), F.greatest("worst_before", "worst").alias("worst")), "_block").alias("e"))
    cleared = ends.select("_key.*", "e").select(
        alarm_id(F.col("e.id")).alias("alarm_id"), (F.col("e.ends") + c.silence).alias("at_sec"), F.lit(None).cast("long").alias("event_id"),
        F.lit("Cleared").alias("op"), F.col("e.n").alias("count"), severity_name(F.col("e.worst")).alias("severity"),
    )
    if now is not None:
        cleared = cleared.filter(F.col("at_sec") < now)
    return events.unionByName(cleared)


def first_judgments(sightings: DataFrame, verdicts: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """Alarms raised as a template's first verdict lands: one for each host that saw it before, if severe enough.

    ``sightings`` are (template_id, host, received_at). Their exemplar is empty.
    """
    first = verdicts.groupBy("template_id").agg(F.min_by(F.struct("severity", "actionable", "judged_at"), "judged_at").alias("v")).select("template_id", "v.*")
    rank = severity_rank(severity_of(F.col("severity")))
    severe = first.filter(gate(F.col("severity"), F.col("actionable"), c.floor, c.actionable) & (rank >= severity_rank(F.lit(c.bypass))))
    waiting = sightings.groupBy(*KEY).agg(F.min("received_at").alias("first_at"))
    return waiting.join(severe, "template_id").filter(F.col("first_at") < F.col("judged_at")).select(
        "template_id", "host", severity_of(F.col("severity")).alias("severity"), F.lit("Dashboard").alias("lane"), F.lit("").alias("exemplar"), F.lit(1).cast("long").alias("count"),
        F.col("judged_at").alias("opened_at"),
    )


def as_verdicts_arrive(lines: DataFrame, verdicts: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """Gated lines, each by the verdict that had landed by then, and a row for each alarm that a first verdict raises.

    ``lines`` have their window statistics; ``verdicts`` are (template_id, landed_sec,
    severity, actionable, contextual), more than one for a template where it was judged
    anew. A line before its template's first verdict passes no gate. A first verdict
    that is severe enough raises at once for each host that saw the template before:
    the row has no event_id, an empty exemplar and the place before all lines of its
    second, so that ``alarms``, ``episodes`` and ``changelog`` count on from it, clear
    it and revive it. With a column ``noticed_sec`` a first verdict raises only then, and
    not where lines have an alarm open by that time; within a cooldown it is a revival.
    """
    spans = verdicts.select("template_id", F.col("landed_sec").alias("judged_at"), "severity", "actionable", "contextual")
    own = gated(as_of(lines, spans, "sec").drop("judged_at"), c)
    noticed = "noticed_sec" if "noticed_sec" in verdicts.columns else "landed_sec"
    first = verdicts.groupBy("template_id").agg(F.min_by(F.struct("landed_sec", F.col(noticed).alias("sec"), "severity", "actionable", "contextual"), "landed_sec").alias("v")).select("template_id", "v.*")
    rank = severity_rank(severity_of(F.col("severity")))
    severe = first.filter(gate(F.col("severity"), F.col("actionable"), c.floor, c.actionable) & (rank >= severity_rank(F.lit(c.bypass))))
    waiting = lines.groupBy(*KEY).agg(F.min("sec").alias("seen"), F.min("template").alias("template"))
    raised = waiting.join(severe, "template_id").filter(F.col("seen") < F.col("landed_sec")).withColumns({"rank": rank, "trig": F.lit(True), "raw": F.lit("")})
    if noticed == "noticed_sec":
        live = islands(own, c).select("_key", "episode", "ends").distinct()
        is_open = F.struct(raised["template_id"], raised["host"]).eqNullSafe(live["_key"]) & (live["episode"] <= raised["sec"]) & (raised["sec"] <= live["ends"] + c.silence)
        raised = raised.join(live, is_open, "left_anti")
    columns = [F.col(x) if x in raised.columns else F.lit(None).cast(own.schema[x].dataType).alias(x) for x in own.columns]
    return own.unionByName(raised.select(*columns))


def context_snapshot(bursts: DataFrame, open_: DataFrame, most: int = 8, block: int = 900) -> DataFrame:
    """For each burst (host, sec), the oldest open alarms of its host at that time: array of (opened_sec, alarm_id, template).

    Time is cut into blocks. Of the alarms that are open all through a block, its
    bursts can only show the oldest ``most``, so that a burst meets those and the
    alarms that open or clear in its block.
    """
    blocks = F.sequence(F.floor(F.col("opened_sec") / block), F.floor(F.col("clears_sec") / block))
    spans = open_.select(F.col("host").alias("_h"), "opened_sec", "clears_sec", "alarm_id", "template", F.explode(blocks).alias("_b"))
    through = (F.col("opened_sec") < F.col("_b") * block) & (F.col("clears_sec") >= (F.col("_b") + 1) * block - 1)
    place = F.row_number().over(Window.partitionBy("_h", "_b", "_through").orderBy("opened_sec", "alarm_id"))
    spans = spans.withColumn("_through", through).withColumn("_place", place).filter(~F.col("_through") | (F.col("_place") <= most))
    asked = bursts.select("event_id", "host", "sec", F.floor(F.col("sec") / block).alias("_b"))
    live = (F.col("host") == F.col("_h")) & (asked["_b"] == spans["_b"]) & (F.col("opened_sec") < F.col("sec")) & (F.col("sec") <= F.col("clears_sec"))
    ranked = asked.join(spans, live).withColumn("_r", F.row_number().over(Window.partitionBy("event_id").orderBy("opened_sec", "alarm_id"))).filter(F.col("_r") <= most)
    found = ranked.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("opened_sec", "alarm_id", "template"))).alias("open_alarms"))
    return bursts.join(found, "event_id", "left")


def still_open(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Answers (answered_sec, correlates_with) with null for a named alarm that was not open any more when the answer came."""
    spans = found.select(F.col("alarm_id").alias("_id"), "opened_sec", "clears_sec")
    live = (F.col("correlates_with") == F.col("_id")) & (F.col("opened_sec") <= F.col("answered_sec")) & (F.col("answered_sec") <= F.col("clears_sec"))
    return answers.join(spans, live, "left").withColumn("correlates_with", F.col("_id")).select(*answers.columns)


@dataclass
class Key:
    """One key's state in the contextual machine."""

    alarm: list | None = None
    last: int = 0
    cleared: tuple[int, list] | None = None
    suppressed: bool = False
    pending: tuple[int, list] | None = None


class Machine:
    """The contextual alarm machine of one (template, host), line by line in order."""

    def __init__(self, template_id: str, host: str, c: AlarmConfig):
        self.template_id, self.host, self.c, self.k = template_id, host, c, Key()

    def _raise(self, at: int, event: int, rank: int, lane: str) -> tuple:
        name = hashlib.sha256("|".join(str(x) for x in (self.template_id, self.host, event) if x is not None).encode()).hexdigest()
        self.k.alarm, self.k.last = [name, 1, rank, lane], at
        return self._row(at, event, "Raised")

    def _row(self, at: int, event: int | None, op: str, alarm: list | None = None) -> tuple:
        name, count, rank, lane = alarm or self.k.alarm
        return name, self.template_id, self.host, at, event, op, count, rank, lane

    def advance(self, to: int) -> Iterator[tuple]:
        """What falls due before a line at ``to``: answers, then silence."""
        k = self.k
        while True:
            due = k.pending[0] if k.pending and k.pending[0] <= to else None
            clear = k.last + self.c.silence if k.alarm and k.last + self.c.silence < to else None
            if due is None and clear is None:
                return
            if due is None or (clear is not None and clear < due):
                yield self._row(clear, None, "Cleared")
                k.cleared, k.alarm = (clear, k.alarm), None
            else:
                event, rank, matters, wake, answered = k.pending[1]
                k.pending = None
                if k.alarm:
                    continue
                if not answered:
                    yield self._raise(due, event, rank, "Dashboard")
                elif matters < self.c.matters:
                    k.suppressed = True
                else:
                    lane = "Page" if wake >= 0.90 else "Dashboard" if wake >= 0.60 else "Record"
                    if lane == "Record":
                        k.suppressed = True
                    else:
                        yield self._raise(due, event, rank, lane)

    def judged(self, at: int, rank: int) -> Iterator[tuple]:
        """A first verdict, severe enough, for a host that saw the template before; an open alarm stays as it is."""
        yield from self.advance(at)
        if not self.k.alarm:
            yield self._raise(at, None, rank, "Dashboard")

    def line(self, at: int, event: int, rank: int, bypass: bool, hot: bool, flagged: bool, answer: tuple | None) -> Iterator[tuple]:
        """One gated line. ``answer`` is (seconds until it lands, matters_now, wake_someone), or None for a failed check at the deadline."""
        yield from self.advance(at)
        k, trig = self.k, bypass or hot
        if k.pending:
            return
        if k.suppressed:
            if (bypass and self.c.sticky_critical) or trig:
                return
            k.suppressed = False
        if k.alarm:
            k.alarm = [k.alarm[0], k.alarm[1] + 1, max(k.alarm[2], rank), k.alarm[3]]
            k.last = at
            yield self._row(at, event, "Updated")
            return
        if k.cleared:
            if at - k.cleared[0] <= self.c.cooldown:
                if trig:
                    name, count, worst, lane = k.cleared[1]
                    k.alarm, k.last, k.cleared = [name, count + 1, max(worst, rank), lane], at, None
                    yield self._row(at, event, "Raised")
                    return
            else:
                k.cleared = None
        if not trig:
            return
        if flagged:
            delay, matters, wake = answer or (10, None, None)
            answered = answer is not None and matters is not None and wake is not None
            k.pending = at + delay, [event, rank, matters, wake, answered]
            return
        yield self._raise(at, event, rank, "Dashboard")


CHANGES = "alarm_id string, template_id string, host string, at_sec long, event_id long, op string, count long, rank int, lane string"


def contextual_changelog(gated_lines: DataFrame, answers: DataFrame, c: AlarmConfig = AlarmConfig()) -> DataFrame:
    """The change feed with contextual checks.

    ``answers`` are (event_id, delay_sec, matters_now, wake_someone) of the checks by
    the line that tripped them; none means failed at the 10-second deadline. Rows
    without an event_id are first verdicts, as ``as_verdicts_arrive`` gives them. A key's
    lines stream by in order, so a task holds one key's state, not its lines.
    """
    ship(gated_lines.sparkSession)
    flagged = contextual(F.col("contextual"), c.contextual)
    rows = gated_lines.join(answers, "event_id", "left").select(
        *KEY, "sec", "event_id", "rank", (F.col("rank") >= severity_rank(F.lit(c.bypass))).alias("bypass"), triggered(c.windows).alias("hot"), flagged.alias("flagged"),
        "delay_sec", "matters_now", "wake_someone",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, machine, at = [f.split()[0] for f in CHANGES.split(", ")], None, None
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        for b in chain(batches, [None]):
            out = []
            rows_ = list(zip(*(x.to_pylist() for x in b.columns), strict=True)) if b is not None else []
            for t, h, sec, event, rank, bypass, hot, flag, delay, matters, wake in rows_:
                if at != (t, h):
                    if machine:
                        out += machine.advance(1 << 62)
                    machine, at = Machine(t, h, c), (t, h)
                if event is None:
                    out += machine.judged(sec, rank)
                else:
                    out += machine.line(sec, event, rank, bypass, hot, flag, None if delay is None else (delay, matters, wake))
            if b is None and machine:
                out += machine.advance(1 << 62)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "sec", "event_id").mapInArrow(run, CHANGES)

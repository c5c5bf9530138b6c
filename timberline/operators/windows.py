"""Sliding statistics of each template, for each line.

Lines are dealt once, by template and block of time (five minutes), so that a template
with a third of all lines goes to as many tasks as it has blocks. Within a block, hosts
come and go in order of time and one running sum counts them; to counts, sums of
buckets are added, which are few. What the block before leaves is each host's last line.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, written


@dataclass(frozen=True)
class WindowConfig:
    short_bucket: int = 10
    short_buckets: int = 30
    long_bucket: int = 60
    long_buckets: int = 60
    host_span: int = 300
    longest_span: int = 3600
    count_rule: int = 5
    rate_span: int = 300
    rate_factor: float = 3.0
    idle: int = 3600
    #: Seconds between two sweeps of idle windows.
    sweep: int = 60


def seconds(lines: DataFrame, at: str = "received_at", origin: Column | None = None, squeeze: int = 1) -> DataFrame:
    """Adds ``sec``: whole seconds since ``origin`` (default: the earliest line), divided by ``squeeze``."""
    if origin is None:
        first = lines.agg(F.min(at).alias("_origin"))
        lines = lines.crossJoin(F.broadcast(first))
        origin = F.col("_origin")
    passed = F.floor((F.unix_micros(F.col(at)) - F.unix_micros(origin)) / F.lit(1_000_000 * squeeze)).cast("long")
    return lines.withColumn("sec", passed).drop("_origin")


def _before(buckets: DataFrame, at: str, reach: int) -> Column:
    """Lines of the ``reach`` - 1 buckets before, less those of this block before the bucket."""
    near = F.sum("n").over(Window.partitionBy("k").orderBy(at).rangeBetween(-(reach - 1), -1))
    own = F.sum("n").over(Window.partitionBy("k", "b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(near, F.lit(0)) - F.coalesce(own, F.lit(0))


def _bases(rows: DataFrame, c: WindowConfig) -> DataFrame:
    """For each block (k, b) with lines: what to add to a line's place in it, by short and by long bucket, and the key's first second."""
    buckets = [F.floor(F.col("sec") / c.short_bucket).alias("s"), F.floor(F.col("sec") / c.long_bucket).alias("l")]
    both = rows.select("k", "b", "sec", *buckets).groupBy("k", "b", "s", "l").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first"))
    short = both.groupBy("k", "b", "s").agg(F.sum("n").alias("n"))
    long = both.groupBy("k", "b", "l").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    shorts = short.select("k", "b", F.struct("s", _before(short, "s", c.short_buckets)).alias("e")).groupBy("k", "b").agg(F.map_from_entries(F.collect_list("e")).alias("shorts"))
    ever = F.min("first").over(Window.partitionBy("k"))
    longs = long.select("k", "b", F.struct("l", _before(long, "l", c.long_buckets)).alias("e"), ever.alias("first")).groupBy("k", "b")
    return shorts.join(longs.agg(F.map_from_entries(F.collect_list("e")).alias("longs"), F.min("first").alias("first")), ["k", "b"])


def window_stats(lines: DataFrame, c: WindowConfig = WindowConfig(), by: tuple[str, ...] = ("template_id",)) -> DataFrame:
    """Adds short_total, long_total, distinct_hosts, first_seen_secs and span_secs to (template_id, host, sec, event_id) rows.

    A line counts those before it and itself, in order of (sec, event_id). Windows
    belong to ``by``; with ``("template_id", "session")`` after ``idle_reset`` they
    forget a template that was idle. Null hosts are no hosts and null keys are a key.
    ``lines`` are read three times, two of them by a few columns, so that lines which
    cost something to make should be written first.
    """
    # Blocks hold whole buckets and are no shorter than the hosts' window.
    width = math.lcm(c.short_bucket, c.long_bucket)
    width *= -(-c.host_span // width)
    block = F.floor(F.col("sec") / width)
    rows = lines.select(F.struct(*[lines[x] for x in by]).alias("k"), block.alias("b"), "sec", "event_id", "host", F.struct(*[lines[x] for x in lines.columns]).alias("row"))
    # A host's last line of a block may still count in the next one.
    last = rows.filter("host is not null").groupBy("k", "b", "host").agg(F.max("sec").alias("sec")).filter((F.col("b") + 1) * width - F.col("sec") < c.host_span)
    dealt = rows.unionByName(last.withColumn("b", F.col("b") + 1), allowMissingColumns=True).repartition("k", "b")
    own = Window.partitionBy("k", "b", "host").orderBy("sec", F.col("event_id").asc_nulls_first())
    known, hosted = F.col("row").isNotNull(), F.col("host").isNotNull()
    old, new = F.lag("sec").over(own), F.lead("sec").over(own)
    marked = dealt.withColumns({
        "came": (hosted & F.coalesce(F.col("sec") - old >= c.host_span, F.lit(True))).cast("long"),
        "left": hosted & F.coalesce(new - F.col("sec") >= c.host_span, F.lit(True)),
    })
    # A host comes with the first line of a run and leaves once its last line is out of the window.
    came = F.struct(F.col("sec").alias("at"), F.lit(1).alias("kind"), F.col("came").alias("hosts"), known.cast("long").alias("line"), F.col("row").alias("row"))
    left = F.struct((F.col("sec") + c.host_span).alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("hosts"), F.lit(0).cast("long").alias("line"), F.lit(None).cast(lines.schema).alias("row"))
    steps = marked.select("k", "b", "event_id", F.explode(F.when(F.col("left"), F.array(came, left)).otherwise(F.array(came))).alias("x")).select("k", "b", "event_id", "x.*")
    so_far = Window.partitionBy("k", "b").orderBy("at", "kind", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = steps.withColumns({"hosts": F.sum("hosts").over(so_far), "line": F.sum("line").over(so_far)}).filter(known)
    base = lambda m, size: F.element_at(m, F.floor(F.col("at") / size)) + F.col("line")
    return placed.join(_bases(rows, c), ["k", "b"]).select(
        "row.*",
        base("shorts", c.short_bucket).alias("short_total"),
        base("longs", c.long_bucket).alias("long_total"),
        F.col("hosts").alias("distinct_hosts"),
        F.col("first").alias("first_seen_secs"),
        F.least(F.col("at") - F.col("first"), F.lit(c.longest_span)).alias("span_secs"),
    )


def triggered(c: WindowConfig = WindowConfig()) -> Column:
    """Enough lines in the short window, or a rate well above that of the long one."""
    short, long, span = F.col("short_total"), F.col("long_total"), F.col("span_secs")
    rate = (span >= c.rate_span) & (short / c.rate_span >= F.lit(c.rate_factor) * long / span)
    return (short >= c.count_rule) | F.coalesce(rate, F.lit(False))


def idle_reset(lines: DataFrame, c: WindowConfig = WindowConfig()) -> DataFrame:
    """Adds ``session``: counts up where a template was idle for more than ``idle`` seconds.

    Blocks as long as that hold no such gap, so that sessions are told from the first
    and last second of each block alone. ``window_stats`` forgets with ``by`` of
    (template_id, session).
    """
    rows = lines.select(F.struct("template_id").alias("k"), F.floor(F.col("sec") / c.idle).alias("b"), F.struct(*[lines[x] for x in lines.columns]).alias("row"), "sec")
    order = Window.partitionBy("k").orderBy("b")
    blocks = rows.groupBy("k", "b").agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    new = F.coalesce((F.col("first") - F.lag("last").over(order) > c.idle).cast("long"), F.lit(0))
    sessions = blocks.withColumn("new", new).select("k", "b", F.sum("new").over(order).alias("session"))
    return rows.join(sessions, ["k", "b"]).select("row.*", "session")


class Table:
    """Which templates hold a window, line by line in order: as many as the cap, the least recently seen first."""

    def __init__(self, c: WindowConfig, most: int, start: int = 0):
        self.c, self.most, self.swept = c, most, start
        self.seen: OrderedDict[object, int] = OrderedDict()

    def line(self, key: object, sec: int) -> bool:
        """Whether the line begins a window."""
        fresh = key not in self.seen
        if fresh:
            if len(self.seen) >= self.most:
                while len(self.seen) >= self.most:
                    self.seen.popitem(last=False)
            elif sec - self.swept >= self.c.sweep:
                self.swept = sec
                while self.seen and sec - next(iter(self.seen.values())) > self.c.idle:
                    self.seen.popitem(last=False)
        self.seen[key] = sec
        self.seen.move_to_end(key)
        return fresh


_STARTS = "k struct<template_id:string>, sec long, event_id long"


def _swept_starts(blocks: DataFrame, c: WindowConfig, start: int) -> DataFrame:
    """(k, sec, event_id) of the lines that begin another window, in a table that never fills up.

    Only new templates and lines after an idle hour can come without a window. Of new
    templates one for each second matters, as all others find the sweep done; what is
    left streams through one task that holds the second of the last sweep.
    """
    order = Window.partitionBy("k").orderBy("b")
    gaps = blocks.withColumn("before", F.lag("last").over(order)).select("k", "first.sec", "first.event_id", "before")
    new = gaps.filter("before is null").groupBy("sec").agg(F.min("event_id").alias("event_id"))
    back = gaps.filter(F.col("sec") - F.col("before") > c.idle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swept = start
        for b in batches:
            begun = []
            for sec, before in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                fresh = before is None or swept - before > c.idle
                begun.append(fresh and before is not None)
                if fresh and sec - swept >= c.sweep:
                    swept = sec
            yield b.select([0, 1, 2]).filter(pa.array(begun))

    rows = back.unionByName(new, allowMissingColumns=True).select("k", "sec", "event_id", "before")
    return rows.repartition(1).sortWithinPartitions("sec", "event_id").mapInArrow(run, _STARTS)


def _table_starts(rows: DataFrame, c: WindowConfig, most: int, start: int) -> DataFrame:
    """The same for a table that does fill up: all lines stream through one task, which holds ``most`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(c, most, start)
        for b in batches:
            begun = [table.line(key, sec) for key, sec in zip(b.column(0).field(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(begun))

    every = rows.select("k", "sec", "event_id").repartition(1).sortWithinPartitions("sec", "event_id").mapInArrow(run, _STARTS)
    # A template's first line begins no other window.
    firsts = rows.groupBy("k").agg(F.min(F.struct("sec", "event_id")).alias("first")).select("k", "first.*")
    return every.join(firsts, ["k", "sec", "event_id"], "left_anti")


def evicted(lines: DataFrame, c: WindowConfig = WindowConfig(), most: int = 65_536, start: int = 0) -> DataFrame:
    """Adds ``session``: which window of its template a line belongs to, for a table of at most ``most`` windows.

    A line of a template without a window first clears the table: of the least recently
    seen ones if it is full, else of those idle for over ``idle`` seconds, but the latter
    at most once in ``sweep`` seconds, and for the first time so long after ``start``. So
    a template that was idle keeps its window if no other one came to clear it.
    ``window_stats`` forgets with ``by`` of (template_id, session). Of windows with
    equal seconds the one whose line came first is the staler; ``event_id`` orders lines.
    """
    ship(lines.sparkSession)
    rows = lines.select(F.struct(F.col("template_id").cast("string").alias("template_id")).alias("k"), F.floor(F.col("sec") / c.idle).alias("b"), F.struct(*[lines[x] for x in lines.columns]).alias("row"), "sec", "event_id")
    blocks = rows.groupBy("k", "b").agg(F.min(F.struct("sec", "event_id")).alias("first"), F.max("sec").alias("last"))
    blocks = written(blocks, "window-blocks")
    full = blocks.select("k").distinct().count() > most
    starts = written(_table_starts(rows, c, most, start) if full else _swept_starts(blocks, c, start), "window-starts")
    begun = starts.withColumns({"b": F.floor(F.col("sec") / c.idle), "new": F.lit(1).cast("long")})
    # Windows begun in the blocks before, and in the line's own block up to it.
    order = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.select("k", "b").join(begun.groupBy("k", "b").agg(F.sum("new").alias("n")), ["k", "b"], "left")
    before = counts.select("k", "b", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    own = F.sum("new").over(Window.partitionBy("k", "b").orderBy("sec", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.join(begun, ["k", "b", "sec", "event_id"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    return marked.join(before, ["k", "b"]).select("row.*", (F.col("before") + F.col("own")).alias("session"))


def stalest_first(lines: DataFrame, keep: int) -> DataFrame:
    """The templates over the cap, those seen least recently first.

    The last second that stays is found from counts of templates by second, and only
    templates of that second are ordered among each other.
    """
    last = lines.groupBy("template_id").agg(F.max("sec").alias("last_seen"))
    by_second = last.groupBy("last_seen").agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.orderBy(F.col("last_seen").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("last_seen").orderBy(F.col("template_id").desc()))
    seconds_ = by_second.withColumn("newer", newer).filter(F.col("newer") + F.col("n") > keep).select("last_seen", "newer")
    placed = last.join(seconds_, "last_seen").withColumn("place", (F.col("newer") + place).cast("long"))
    return placed.filter(F.col("place") > keep).select("template_id", "last_seen", "place").orderBy("last_seen", "template_id")

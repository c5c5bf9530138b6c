"""Log lines made up from a seed, where they are needed.

A kind is a list of shares and line forms. A form's ``{word}`` is drawn from a pool and its
``{lo-hi}`` is a whole number between the two; every draw is a hash of the line's
number, the seed and the place in the form, so that any task makes the same line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of facility user, severity notice.
PRIORITY = 13

POOLS = {
    "volume": ("vault-a", "vault-b", "scratch", "tape3"),
    "queue": ("inbound", "outbound", "bounce", "digest"),
    "domain": ("harbor.example", "meadow.example", "quarry.example"),
    "work": ("reindex", "thumbnails", "invoice-run", "cache-warm", "ledger-close"),
    "state": ("finished", "was skipped", "was queued again"),
}
KINDS = {
    "storage": (
        (6, "volumed: {volume} wrote segment {1000-99999} of {8-4096} MB in {3-2500}ms"),
        (3, "volumed: {volume} verified checksum block {1-60000} of segment {1000-99999}"),
        (1, "volumed: {volume} lost replica {0-3} of segment {1000-99999}, {1-40} left to copy"),
    ),
    "mail": (
        (5, "postbox[{300-30000}]: accepted message for user{1-500}@{domain} into {queue}"),
        (2, "postbox[{300-30000}]: deferred {2-80} messages of {queue}, next try in {5-600}s"),
        (1, "postbox[{300-30000}]: refused connection from 10.{0-255}.{0-255}.{1-254}"),
    ),
    "scheduler": (
        (4, "planner: task {work} {state} after {1-7200}s on slot {0-31}"),
        (1, "planner: task {work} exceeded its share by {1-90} percent"),
    ),
}
_FIELD = re.compile(r"\{(?:(\d+)-(\d+)|(\w+))\}")


def _draw(seed: int, place: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("event_id"), F.lit(seed), F.lit(place)), F.lit(n))


def _form(form: str, seed: int) -> Column:
    parts, at = [], 0
    for m in _FIELD.finditer(form):
        low, high, pool = m.groups()
        place = f"{form}:{m.start()}"
        words = POOLS.get(pool, ())
        drawn = F.get(F.array(*map(F.lit, words)), _draw(seed, place, len(words)).cast("int")) if pool else (_draw(seed, place, int(high) - int(low) + 1) + int(low)).cast("string")
        parts += [F.lit(form[at : m.start()]), drawn]
        at = m.end()
    return F.concat(*parts, F.lit(form[at:]))


def _kind(kind: str, seed: int) -> Column:
    forms = KINDS[kind]
    drawn = _draw(seed, kind, sum(share for share, _ in forms))
    upto, out = 0, F.lit(None).cast("string")
    for share, form in forms:
        out = F.coalesce(out, F.when((drawn >= upto) & (drawn < upto + share), _form(form, seed)))
        upto += share
    return out


def lines(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """(event_id, line) of one of ``KINDS``, or of all in equal shares (``mixed``)."""
    rows = spark.range(n).withColumnRenamed("id", "event_id")
    if kind != "mixed":
        return rows.select("event_id", _kind(kind, seed).alias("line"))
    which = _draw(seed, "mixed", len(KINDS))
    line = reduce(F.coalesce, [F.when(which == k, _kind(name, seed)) for k, name in enumerate(KINDS)])
    return rows.select("event_id", line.alias("line"))


def envelope(line: Column, at: Column, host: Column, tag: str = "made-up") -> Column:
    """The line as an RFC 3164 frame."""
    return F.concat(F.lit(f"<{PRIORITY}>"), F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(f" {tag}: "), line).cast("binary")

"""Syslog frames (RFC 5424 and 3164) as events, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the facilities and severities, by number.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "audit", "alert", "clockd", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
SEVERITY_NAMES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MOST_DATAGRAM_BYTES = 65_507
MOST_LINE_BYTES = 64 * 1024
MOST_PRIORITY = 191

#: Of RFC 5424: 1 priority, 2 version, 3 timestamp, 4 host, 5 app, 6 process, 7 message id, 8 message. Structured data is passed over without a stack.
RFC5424 = r"<(\d{1,3})>(\d{1,2}) (-|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[[^\]\\]*+(?:\\.[^\]\\]*+)*+\])++)(?: (.*))?$"
#: Of RFC 3164: 9 priority, 10 month, 11 day, 12 time, 13 host, 14 what follows.
RFC3164 = r"(?:<(\d{1,3})>)?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}(\d{1,2}) (\d{2}:\d{2}:\d{2})(?: ((?![^ ]*:(?: |$))\S+))?(.*)$"
#: Of a frame without a timestamp: 15 priority, 16 the rest.
BARE = r"(?:<(\d{1,3})>)?(.*)$"
FRAME = rf"(?s)^(?:{RFC5424}|{RFC3164}|{BARE})"
#: All parts without spaces in them, then the only one with: a frame is matched once and cut at its first spaces.
PARTS = "$1 $2 $3 $4 $5 $6 $7 $9 $10 $11 $12 $13 $15 $8$14$16"
#: The tag of RFC 3164, after a space: the app, and its process in brackets.
TAG = r"(?s)^ ([^ \[\]:]+)(?:\[([^\]]*)\])?:"


def host_or(name: Column, fallback: Column) -> Column:
    """The named host if it is not empty, else the fallback."""
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def nearest_year(month: Column, day: Column, clock: Column, received_at: Column) -> Column:
    """The timestamp, in the year before, of or after receipt, that is nearest to it. Feb 29 is only where there is one."""
    parts = F.split(clock, ":")
    part = lambda k, most: F.least(F.get(parts, F.lit(k)).cast("int"), F.lit(most))

    def candidate(shift: int) -> Column:
        at = F.try_make_timestamp(F.year(received_at) + shift, month, day, part(0, 23), part(1, 59), part(2, 59).cast("decimal(8,6)"))
        return F.struct(F.abs(F.unix_micros(at) - F.unix_micros(received_at)).alias("off"), F.lit(shift).alias("shift"), at.alias("at"))

    fit = F.filter(F.array(*map(candidate, (-1, 0, 1))), lambda c: c["at"].isNotNull())
    return F.get(F.array_sort(fit), 0)["at"]


def _name(names: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), number)


def _attrs(**values: Column) -> Column:
    """A map without its null and empty values, in order of key."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(values.items())])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def normalise(df: DataFrame, raw: str = "raw", peer: str = "peer", received_at: str = "received_at") -> DataFrame:
    """Adds timestamp, host, source, attrs and body_offset to raw frames (BINARY).

    Frames that are no UTF-8 or have no possible priority stay, with ``parse`` =
    ``failed`` and the peer as host. The body starts at the app's name, or at the
    message, where the frame has a timestamp; else the whole line is the body.
    """
    dash = lambda c: F.nullif(F.nullif(c, F.lit("-")), F.lit(""))
    filled = lambda c: F.nullif(c, F.lit(""))
    rows = df.withColumn("_t", F.try_validate_utf8(F.col(raw).cast("string")))
    rows = rows.withColumn("_f", F.split(F.regexp_replace("_t", FRAME, PARTS), " ", 14))
    part = lambda k: F.get("_f", F.lit(k))
    rest, bytes_ = part(13), lambda *k: sum((F.octet_length(part(x)) for x in k), F.lit(0))
    new, old = filled(part(0)).isNotNull(), filled(part(8)).isNotNull()
    tagged = old & rest.rlike(TAG)
    rows = rows.withColumns(
        {
            "_5": F.coalesce(new, F.lit(False)), "_3": F.coalesce(old, F.lit(False)), "_rest": rest,
            "_pri": filled(F.concat(part(0), part(7), part(12))).cast("int"),
            "_host": F.when(new, dash(part(3))).otherwise(filled(part(11))),
            "_app": F.when(new, dash(part(4))).when(tagged, F.regexp_extract(rest, TAG, 1)),
            "_proc": F.when(new, dash(part(5))).when(tagged, filled(F.regexp_extract(rest, TAG, 2))),
            "_msgid": F.when(new, dash(part(6))),
            "_at": F.when(new, F.try_to_timestamp(dash(part(2)))).when(
                old, nearest_year(F.array_position(F.array(*map(F.lit, MONTHS)), part(8)).cast("int"), part(9).cast("int"), part(10), F.col(received_at))
            ),
            # Signs around the priority, and four spaces.
            "_head": bytes_(0, 1, 2, 3) + 5,
        }
    ).drop("_f")
    # Bytes before the app, or before the message.
    whole, tail = F.octet_length("_t"), F.octet_length("_rest")
    named = F.col("_app").isNotNull()
    before = F.when(F.col("_5") & named, F.col("_head")).when(F.col("_3") & named, whole - tail + 1).otherwise(whole - tail)
    bad = F.col("_t").isNull() | (F.col("_pri") > MOST_PRIORITY)
    offset = F.when(F.col("_at").isNotNull(), before).otherwise(0)
    attrs = _attrs(
        protocol=F.when(F.col("_5"), "rfc5424").otherwise("rfc3164"),
        facility=_name(FACILITIES, F.floor(F.col("_pri") / 8).cast("int")),
        severity=_name(SEVERITY_NAMES, F.col("_pri") % 8),
        app=F.col("_app"), procid=F.col("_proc"), msgid=F.col("_msgid"),
    )
    return rows.withColumns(
        {
            "timestamp": F.when(~bad, F.col("_at")),
            "host": F.when(bad, F.col(peer)).otherwise(host_or(F.col("_host"), F.col(peer))),
            "source": F.lit("syslog"),
            "attrs": F.when(bad, F.create_map(F.lit("parse"), F.lit("failed"))).otherwise(attrs),
            "body_offset": F.when(bad, 0).otherwise(offset).cast("int"),
        }
    ).drop("_t", "_5", "_3", "_rest", "_pri", "_host", "_app", "_proc", "_msgid", "_at", "_head")


def shed(df: DataFrame, per_second: int = 50_000, at: str = "received_at") -> DataFrame:
    """Adds ``shed``: whether a datagram is over its second's quota or too large.

    Seconds are cut into pieces by event id, whose counts are summed before, so that
    no second is ordered in one task.
    """
    second = F.unix_seconds(F.date_trunc("second", at))
    piece = F.floor(F.col("event_id") / 4096)
    rows = df.withColumns({"_s": second, "_p": piece})
    from pyspark.sql import Window

    counts = rows.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_s", "_p").orderBy("event_id"))
    return rows.withColumn("_k", place).join(counts, ["_s", "_p"]).withColumn("shed", F.col("_before") + F.col("_k") > per_second).drop("_s", "_p", "_k", "_before")

"""Journal records (``journalctl -o json`` lines, or maps) as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable, ship
from . import tailing
from .syslog import host_or


def parse(df: DataFrame, line: str = "line", out: str = "record") -> DataFrame:
    return df.withColumn(out, F.from_json(line, "map<string,string>"))


def normalise(df: DataFrame, record: str = "record", own_unit: str | None = None) -> DataFrame:
    """Adds raw, timestamp, host, source, attrs and body_offset; leaves out the engine's own unit's records."""
    r = F.col(record)
    get = lambda k: F.try_element_at(r, F.lit(k))
    rows = df if own_unit is None else df.filter(~get("_SYSTEMD_UNIT").eqNullSafe(F.lit(own_unit)))
    micros = F.coalesce(get("_SOURCE_REALTIME_TIMESTAMP"), get("__REALTIME_TIMESTAMP"))
    at = F.when(micros.rlike(r"^\+?[0-9]+$"), F.expr(f"try_cast(coalesce({record}['_SOURCE_REALTIME_TIMESTAMP'], {record}['__REALTIME_TIMESTAMP']) AS BIGINT)"))
    return rows.withColumns(
        {
            "raw": F.coalesce(get("MESSAGE"), F.lit("")).cast("binary"),
            "timestamp": F.timestamp_micros(at),
            "host": host_or(get("_HOSTNAME"), F.lit("localhost")),
            "source": F.lit("journal"),
            "attrs": F.map_filter(r, lambda k, _: k != "MESSAGE"),
            "body_offset": F.lit(0),
        }
    )


def tail(spark: SparkSession, folder: str, own_unit: str | None = None, begin: str = "end") -> DataFrame:
    """A stream of the records that are appended to the exports in a folder, but for the engine's own unit's.

    Records that are there when the stream first starts are passed over, unless
    ``begin`` is ``start``; started again from its checkpoint, it goes on where it was.
    """
    ship(spark)
    with importable(spark):
        tailing.register(spark)
        lines = spark.readStream.format("lines_tail").option("path", folder).option("begin", begin).load()
    return normalise(parse(lines.select("line")), own_unit=own_unit)

"""OpenTelemetry log exports (JSON) as events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .syslog import host_or

_KV = "array<struct<key:string,value:string>>"
#: Values stay JSON text; ``any_value`` renders them.
SCHEMA = f"""resourceLogs array<struct<resource:struct<attributes:{_KV}>, scopeLogs:array<struct<scope:struct<name:string>,
logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:string,attributes:{_KV},traceId:string,spanId:string>>>>>>"""


def render(value: Any) -> str:
    """An attribute value as text; arrays as ``[a, b]``, maps as ``{k=v}``."""
    if not isinstance(value, dict):
        return ""
    for kind, v in value.items():
        if kind == "stringValue":
            return v
        if kind == "boolValue":
            return "true" if v else "false"
        if kind == "intValue":
            return str(int(v))
        if kind == "doubleValue":
            v = float(v)
            return str(int(v)) if v.is_integer() and abs(v) < 1e16 else repr(v)
        if kind == "bytesValue":
            import base64

            return base64.b64decode(v).decode("utf-8", "replace")
        if kind == "arrayValue":
            return "[" + ", ".join(render(x) for x in (v or {}).get("values", [])) + "]"
        if kind == "kvlistValue":
            return "{" + ", ".join(f"{x.get('key', '')}={render(x.get('value'))}" for x in (v or {}).get("values", [])) + "}"
    return ""


@F.pandas_udf(T.StringType())
def _nested(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in parts:
        yield pd.Series([None if v is None else render(json.loads(v)) for v in values])


def any_value(value: Column) -> Column:
    """Scalars by built-in functions; only nested values and bytes go to Python."""
    get = lambda k: F.get_json_object(value, f"$.{k}")
    simple = F.coalesce(get("stringValue"), get("boolValue"), get("intValue"))
    return F.coalesce(simple, F.when(value.isNotNull(), _nested(F.when(simple.isNull(), value))), F.lit(""))


def _flat(attributes: Column, prefix: str) -> Column:
    scalars = F.transform(
        attributes,
        lambda kv: F.struct(
            F.concat(F.lit(prefix), kv["key"]).alias("key"),
            F.coalesce(*[F.get_json_object(kv["value"], f"$.{k}") for k in ("stringValue", "boolValue", "intValue", "doubleValue", "arrayValue", "kvlistValue")], F.lit("")).alias("value"),
        ),
    )
    return F.coalesce(scalars, F.array().cast("array<struct<key:string,value:string>>"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _rendered(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for attributes, prefixes in parts:
        yield pd.Series([{p + kv["key"]: render(json.loads(kv["value"])) if kv["value"] else "" for kv in (a if a is not None else [])} for a, p in zip(attributes, prefixes, strict=True)])


def timestamp(nanos: Column, observed: Column) -> Column:
    """The record's time, else when it was observed; zero is unknown."""
    known = lambda c: F.nullif(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.timestamp_micros(F.floor(F.coalesce(known(nanos), known(observed)) / 1000).cast("long"))


def normalise(df: DataFrame, export: str = "export", peer: str = "peer") -> DataFrame:
    """One event for each log record of JSON exports, with the other columns of the export.

    Attributes have the prefixes ``resource.`` and ``attr.``; host is ``host.name``
    of the resource or the peer.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (export, peer)]
    rows = df.select(*keep, F.col(peer).alias("_peer"), F.explode(F.from_json(export, SCHEMA)["resourceLogs"]).alias("_r"))
    rows = rows.select(*keep, "_peer", F.col("_r.resource.attributes").alias("_ra"), F.explode("_r.scopeLogs").alias("_s"))
    rows = rows.select(*keep, "_peer", "_ra", F.col("_s.scope.name").alias("_scope"), F.explode("_s.logRecords").alias("_l"))
    resource = _rendered("_ra", F.lit("resource."))
    own = _rendered("_l.attributes", F.lit("attr."))
    extra = F.array(
        *[
            F.struct(F.lit(k).alias("key"), v.alias("value"))
            for k, v in (
                ("severity_text", F.col("_l.severityText")), ("severity_number", F.nullif(F.col("_l.severityNumber"), F.lit(0)).cast("string")),
                ("scope", F.col("_scope")), ("trace_id", F.lower("_l.traceId")), ("span_id", F.lower("_l.spanId")),
            )
        ]
    )
    reserved = F.map_from_entries(F.filter(extra, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    rows = rows.withColumns({"_rm": resource, "_am": own})
    return rows.select(
        *keep,
        any_value(F.col("_l.body")).cast("binary").alias("raw"),
        timestamp(F.col("_l.timeUnixNano"), F.col("_l.observedTimeUnixNano")).alias("timestamp"),
        host_or(F.try_element_at("_rm", F.lit("resource.host.name")), F.col("_peer")).alias("host"),
        F.lit("otlp").alias("source"),
        F.map_concat(F.coalesce("_rm", F.create_map().cast("map<string,string>")), F.coalesce("_am", F.create_map().cast("map<string,string>")), reserved).alias("attrs"),
        F.lit(0).alias("body_offset"),
    )

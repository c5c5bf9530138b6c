"""What a triage board reads: totals, filters, sorts and an alarm's details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEVERITIES, severity_rank


def totals(alarms: DataFrame) -> DataFrame:
    return alarms.agg(
        F.count(F.lit(1)).alias("open"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("lane") == "Page").alias("paging"), F.countDistinct("host").alias("hosts")
    )


def by_severity(alarms: DataFrame) -> DataFrame:
    """Every severity but cleared, worst first, with zeros."""
    known = alarms.sparkSession.createDataFrame([(s, k) for k, s in enumerate(SEVERITIES) if k], "severity string, rank int")
    counts = alarms.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), "rank").orderBy(F.desc("rank")).drop("rank")


def by_host(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host")


def filtered(alarms: DataFrame, severity: str | None = None, lane: str | None = None, text: str = "", order: str = "count") -> DataFrame:
    """Alarms by severity, lane and part of template or host, most counted or newest first."""
    out = alarms
    if severity:
        out = out.filter(F.col("severity") == severity)
    if lane:
        out = out.filter(F.col("lane") == lane)
    if text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "template", "host")), F.lit(text.lower())))
    return out.orderBy(F.desc(order), "alarm_id")


def detail(alarms: DataFrame, verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """Each open alarm with the latest verdict and the latest record of its template."""
    v = verdicts.groupBy("template_id").agg(F.max_by(F.struct("severity", "actionable", "judged_at"), "judged_at").alias("verdict"))
    r = records.groupBy("template_id").agg(F.max_by(F.struct("id", "answers_json", "recorded_at"), F.struct("recorded_at", "id")).alias("record"))
    return alarms.join(v, "template_id", "left").join(r, "template_id", "left")


def as_json(alarms: DataFrame) -> DataFrame:
    """(json) of the open alarms, oldest first."""
    return alarms.orderBy("opened_sec", "alarm_id").select(F.to_json(F.struct(*alarms.columns)).alias("json"))


def worst(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("host").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))

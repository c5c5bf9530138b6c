"""Judgments of templates: keys, latest, as-of and history; questions; pluggable deciders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..runtime import ship
from ..schema import severity_name, severity_rank

KEYS = ("template_id", "questions_hash", "bundle_hash", "model")

# The questions of the static set, the merge question and those of a contextual check, with their kinds.
STATIC_QUESTIONS = {
    "kind": "choice", "severity": "score", "actionable": "noul", "transient": "noul", "security": "noul",
    "contextual": "noul", "blast_radius": "score", "runbook_kind": "choice", "page_delay": "score",
}
MERGE_QUESTIONS = {"same_event": "noul"}
CONTEXT_QUESTIONS = {"matters_now": "noul", "correlates_with": "choice", "wake_someone": "noul"}

SEVERITY_FLOOR, ACTIONABLE, CONTEXTUAL = "minor", 0.5, 0.5
PAGE, DASHBOARD = 0.90, 0.60


# Fixed value: the name of the answer that no shown alarm is the same incident.
NONE = "none"


def context_options(open_alarms: Column, most: int = 160) -> Column:
    """What a burst's ``correlates_with`` may be answered with: a map of the ids in its snapshot to their excerpts, and none."""
    shown = F.transform(F.coalesce(open_alarms, F.array().cast("array<struct<opened_sec:bigint,alarm_id:string,template:string>>")), lambda a: F.struct(a["alarm_id"].alias("key"), excerpt(a["template"], most).alias("value")))
    return F.map_from_entries(F.concat(shown, F.array(F.struct(F.lit(NONE).alias("key"), F.lit("another incident").alias("value")))))


def questions_hash(questions: Any) -> str:
    """32 hex digits of the JSON text with sorted keys."""
    text = json.dumps(questions, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def latest(verdicts: DataFrame, *keys: str) -> DataFrame:
    """For each of ``keys`` (default: template, questions, bundle), the row judged last."""
    by = keys or KEYS[:3]
    rest = [c for c in verdicts.columns if c not in by]
    return verdicts.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("judged_at", *[c for c in ("model",) if c in rest])).alias("v")).select(*by, "v.*")


def by_key(verdicts: DataFrame, **key: str) -> DataFrame:
    """The rows of an exact key; parts that are not given are free."""
    for k, v in key.items():
        verdicts = verdicts.filter(F.col(k) == v)
    return verdicts


def history(verdicts: DataFrame) -> DataFrame:
    """All rows with their place in their template's history, oldest first."""
    order = Window.partitionBy("template_id").orderBy("judged_at", "questions_hash", "model")
    return verdicts.withColumn("place", F.row_number().over(order).cast("long"))


def as_of(lines: DataFrame, verdicts: DataFrame, at: str = "received_at") -> DataFrame:
    """Each line with the last verdict judged at or before it, or nulls.

    A verdict is valid until the template's next one: one range join on the template,
    and a template's few verdicts are what is broadcast or shuffled.
    """
    next_at = F.lead("judged_at").over(Window.partitionBy("template_id").orderBy("judged_at"))
    spans = verdicts.withColumn("_until", next_at)
    within = (
        (lines.template_id == spans.template_id)
        & (spans.judged_at <= lines[at])
        & (spans._until.isNull() | (lines[at] < spans._until))
    )
    own = [spans[c] for c in spans.columns if c not in ("template_id", "_until")]
    return lines.join(spans, within, "left").select(*[lines[c] for c in lines.columns], *own)


def unjudged(templates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Distinct templates without a verdict, to be judged once."""
    return templates.dropDuplicates(["template_id"]).join(verdicts.select("template_id"), "template_id", "left_anti")


def severity_of(score: Column) -> Column:
    """A score's severity: rounded, 3 and more critical, 2 major, 1 minor, else info; null for null."""
    r = F.round(score)
    return F.when(r >= 3, "critical").when(r == 2, "major").when(r == 1, "minor").when(r.isNotNull(), "info")


def gate(score: Column, actionable: Column, floor: str = SEVERITY_FLOOR, least: float = ACTIONABLE) -> Column:
    """Whether a judged line may raise; a missing answer closes the gate."""
    open_ = (severity_rank(severity_of(score)) >= severity_rank(F.lit(floor))) & (actionable >= least)
    return F.coalesce(open_, F.lit(False))


def contextual(flag: Column, least: float = CONTEXTUAL) -> Column:
    return F.coalesce(flag >= least, F.lit(False))


def lane(wake: Column) -> Column:
    """Where an alarm goes; an unknown answer goes to the board."""
    return F.when(wake.isNull(), "Dashboard").when(wake >= PAGE, "Page").when(wake >= DASHBOARD, "Dashboard").otherwise("Record")


def confidence(answer: Column) -> Column:
    return F.when(answer["kind"] != "noul", answer["confidence"])


def headline(answer: Column) -> Column:
    """What the board shows of an answer."""
    return (
        F.when(answer["kind"] == "noul", F.when(answer["noul"] >= 0.5, "yes").otherwise("no"))
        .when(answer["kind"] == "choice", answer["choice"])
        .otherwise(answer["score"].cast("string"))
    )


def distribution(probabilities: Column, most: int = 4) -> Column:
    """The likeliest answers: array of (key, value), by probability and then name."""
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, most), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def record_totals(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")
    )


class Decider(Protocol):
    """Answers the questions of one template; no call is ever made from here."""

    def decide(self, template_id: str, template: str, questions: dict[str, str]) -> dict[str, dict[str, Any]]: ...


class TableDecider:
    """Answers by a table of template to answers, else by a default."""

    def __init__(self, table: dict[str, dict[str, dict[str, Any]]], default: dict[str, dict[str, Any]] | None = None):
        self.table, self.default = table, default

    def decide(self, template_id: str, template: str, questions: dict[str, str]) -> dict[str, dict[str, Any]]:
        found = self.table.get(template, self.table.get(template_id, self.default))
        if found is None:
            raise LookupError(template)
        return {q: found[q] for q in questions if q in found}


JUDGED = "template_id string, template string, questions_hash string, model string, answers_json string, failed boolean"


def judge(templates: DataFrame, decider: Decider, questions: dict[str, str] = STATIC_QUESTIONS, model: str = "table") -> DataFrame:
    """One record for each template of (template_id, template); a failed decision is a row, too."""
    ship(templates.sparkSession)
    asked = questions_hash(questions)

    def run(parts: Iterator) -> Iterator:
        for rows in parts:
            out = []
            for tid, template in zip(rows["template_id"], rows["template"], strict=True):
                try:
                    out.append((tid, template, asked, model, json.dumps(decider.decide(tid, template, questions), sort_keys=True), False))
                except Exception:
                    out.append((tid, template, asked, model, None, True))
            yield rows.__class__(out, columns=[f.split()[0] for f in JUDGED.split(", ")])

    return templates.select("template_id", "template").mapInPandas(run, JUDGED)


def verdict_of(judged: DataFrame, bundle_hash: str, at: Column) -> DataFrame:
    """Verdict rows of the records that did not fail."""
    answers = F.from_json("answers_json", "map<string,struct<score:double,noul:double,choice:string,confidence:double>>")
    rows = judged.filter(~F.col("failed")).withColumn("a", answers)
    part = lambda q, f: F.try_element_at(F.col("a"), F.lit(q))[f]
    return rows.select(
        "template_id", "questions_hash", F.lit(bundle_hash).alias("bundle_hash"), "model", at.alias("judged_at"),
        part("severity", "score").alias("severity"), part("actionable", "noul").alias("actionable"), part("contextual", "noul").alias("contextual"),
    )


def severity_column(score: Column) -> Column:
    return severity_name(severity_rank(severity_of(score)))


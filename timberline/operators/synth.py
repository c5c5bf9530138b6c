"""Proposals for new mask slots from the places where clusters differ."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mask import DEFAULT, BadBundle, Bundle, Slot, mask
from ..functions.text import tokens
from ..runtime import written
from .drain import Config, assign

LEAST, MOST_EXAMPLES, MOST_CANDIDATES, WIDTH = 3, 5, 50, 1


def candidates(lines: DataFrame, bundle: Bundle = DEFAULT, *, least: int = LEAST, config: Config = Config(), masked: bool = False) -> DataFrame:
    """(before, after, examples, occurrences, template, position) of each open place, most frequent first.

    ``lines`` have event_id, received_at and raw (or template, if ``masked``). Examples
    are the first distinct values; values that are placeholders are none.
    """
    masks = F.col("template") if masked else mask(F.col("raw"), bundle)
    # Masked once: mining reads the lines, and so do the examples.
    rows = written(lines.select("event_id", "received_at", masks.alias("template")), "synth-lines")
    assigned, clusters = assign(rows, config)
    wide = clusters.filter(F.col("size") >= least).select("seq", "size", "template", F.posexplode(F.split("template", " ")).alias("position", "t"), F.split("template", " ").alias("ct")).filter(F.col("t") == config.param)
    # Few lines are of clusters with an open place; they are written, so that it is known how few, and only their texts are moved and cut.
    wide = written(wide, "synth-wide")
    open_ = written(assigned.select("event_id", "seq").join(wide.select("seq").distinct(), "seq", "left_semi"), "synth-open")
    values = open_.join(rows, "event_id").select("seq", "event_id", "received_at", tokens(F.col("template"), config.max_tokens).alias("lt"))
    at = wide.join(values, "seq").withColumn("value", F.get("lt", F.col("position"))).filter(F.col("value").isNotNull() & ~F.col("value").rlike("^<VAR:.*>$"))
    first = at.groupBy("seq", "position", "value").agg(F.min(F.struct("received_at", "event_id")).alias("seen"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("seq", "position").orderBy("seen"))).filter(F.col("r") <= MOST_EXAMPLES)
    examples = ranked.groupBy("seq", "position").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("e"))
    p = F.col("position")
    return (
        wide.join(examples, ["seq", "position"])
        .select(
            F.slice("ct", F.greatest(p - WIDTH, F.lit(0)) + 1, F.least(p, F.lit(WIDTH))).alias("before"),
            F.slice("ct", p + 2, WIDTH).alias("after"),
            F.transform("e", lambda x: x["value"]).alias("examples"),
            F.col("size").alias("occurrences"), "template", "position", "seq",
        )
        .orderBy(F.desc("occurrences"), "seq", "position")
        .limit(MOST_CANDIDATES)
        .drop("seq")
    )


def prompt(found: list[Any]) -> str:
    """The request for proposals: one numbered item for each candidate, and the form of the answer."""
    items = [
        f"{k}. before: {' '.join(c['before'])!r}, after: {' '.join(c['after'])!r}, seen {c['occurrences']} times\n   values: {', '.join(c['examples'])}" for k, c in enumerate(found, 1)
    ]
    return "\n".join(
        ["These places in log templates vary. Propose a regex slot for each that is a real variable.", *items, 'Answer with a JSON array of {"name", "pattern", "why"}; names in capitals, no capturing groups.']
    )


def fix_prompt(slot: Slot, error: BadBundle) -> str:
    return f"The slot {json.dumps({'name': slot.name, 'pattern': slot.pattern, 'why': slot.why})} is not valid ({error}). Answer with a corrected JSON object, or null to withdraw it."


def merged(bundle: Bundle, new: list[Slot]) -> Bundle:
    """The bundle with new slots before its last one, checked."""
    slots = (*bundle.slots[:-1], *new, bundle.slots[-1])
    return Bundle.parse(Bundle(slots).to_toml())


def stable(lines: DataFrame, bundle: Bundle, line: str = "raw") -> bool:
    """Whether masking a masked line changes nothing, over all lines."""
    once = lines.select(mask(F.col(line), bundle).alias("m"))
    return once.filter(mask(F.col("m"), bundle) != F.col("m")).isEmpty()


def synthesise(lines: DataFrame, propose: Callable[[str], str], bundle: Bundle = DEFAULT) -> tuple[Bundle, list[Slot]]:
    """The bundle with the accepted proposals, and those.

    One request for proposals and one retry for each slot that fails; what fails again
    is dropped. If masking is not idempotent over the lines, nothing is accepted.
    """
    found = candidates(lines, bundle).collect()
    if not found:
        return bundle, []
    accepted: list[Slot] = []
    for raw in json.loads(propose(prompt(found))):
        slot = Slot(raw["name"], raw["pattern"], raw.get("why", ""))
        for last in (False, True):
            try:
                merged(bundle, [*accepted, slot])
                accepted.append(slot)
                break
            except BadBundle as x:
                again = None if last else json.loads(propose(fix_prompt(slot, x)))
                if not again:
                    break
                slot = Slot(again["name"], again["pattern"], again.get("why", ""))
    result = merged(bundle, accepted) if accepted else bundle
    return (result, accepted) if stable(lines, result) else (bundle, [])

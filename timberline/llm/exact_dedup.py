"""Exact deduplication that one hot text cannot stall.

Digests are counted first, so that only texts whose digest occurs twice or more are
moved. Copies are then combined three times, each time with the full content in the
grouping key: in each map task (partial aggregation), in each salted digest group, and
over the winners of the salts. A group of any size therefore reaches the last step as
at most ``salts`` rows. Rows then look up their group's winner by (digest, salt), so
the lookup is dealt as evenly as the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SALTS, matched, written

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    rows = df.select(df[id_col].alias("id"), normalised(df[text_col]).alias("content"))
    return rows.select(
        "id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )


def _winners(keyed: DataFrame) -> DataFrame:
    """For each digest: how many contents share it, and of each its salts, smallest id and size."""
    local = keyed.groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = (
        local.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"), F.collect_set("salt").alias("found_in"))
    )
    return whole.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"),
        F.flatten(F.collect_list("found_in")).alias("found_in"),
    )


def _repeated(narrow: DataFrame) -> DataFrame:
    """The ids of all rows whose digest occurs twice or more; looked up by (digest, salt), so a hot digest stays dealt."""
    local = narrow.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"))
    whole = local.groupBy("digest").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    places = whole.select("digest", F.explode("salts").alias("salt"))
    return narrow.join(places, ["digest", "salt"], "left_semi").select("id").distinct()


def decisions(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row for each distinct (id, text) pair: id, digest, keep_id, group_size, kept, n_same.

    ``n_same`` is how many input rows have that id and text. Texts whose digests
    collide stay apart. Ids compare with null last; a group with only null ids has
    a null ``keep_id``. Null texts count as empty, and an empty table gives no rows.
    """
    narrow = written(_keyed(df, id_col, text_col, digest, salts).select("id", "digest", "salt"), "dedup-digests")
    asked = written(_repeated(narrow), "dedup-repeated")
    keyed = _keyed(matched(df.select(id_col, text_col), id_col, asked, "left_semi"), id_col, text_col, digest, salts)
    found = written(_winners(keyed).filter("n > 1"), "dedup-groups")
    members = narrow.repartition("digest", "salt").groupBy("digest", "salt", "id").agg(F.count(F.lit(1)).alias("n_same"))
    clean = found.filter("contents = 1").select(
        "digest", F.explode(F.array_distinct("found_in")).alias("salt"), "keep_id", F.col("n").alias("group_size")
    )
    collided = found.filter("contents > 1")
    if collided.isEmpty():
        joined = members.join(clean, ["digest", "salt"], "left")
    else:
        # Contents tell the groups of a shared digest apart.
        rows = keyed.join(collided.select("digest"), "digest", "left_semi")
        groups = (
            rows.groupBy("digest", "salt", "content")
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.collect_set("salt").alias("s"))
            .groupBy("digest", "content")
            .agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.flatten(F.collect_set("s")).alias("s"))
            .select("digest", F.explode(F.array_distinct("s")).alias("salt"), "content", "keep_id", "group_size")
        )
        same = rows.groupBy("digest", "salt", "id", "content").agg(F.count(F.lit(1)).alias("n_same"))
        apart = same.join(groups, ["digest", "salt", "content"]).select("digest", "salt", "id", "n_same", "keep_id", "group_size")
        rest = members.join(collided.select("digest"), "digest", "left_anti")
        joined = (
            rest.join(clean, ["digest", "salt"], "left")
            .select("digest", "salt", "id", "n_same", "keep_id", "group_size")
            .unionByName(apart)
        )
    alone = F.col("group_size").isNull()
    return joined.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "n_same").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "n_same",
    )


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Of rows that agree in id and text one is kept and the others are dropped.
    """
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_same"))).alias("copy")
    return (
        decisions(df, id_col, text_col, salts=salts)
        .select("*", copies)
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS) -> DataFrame:
    """The input rows that stay, with all their columns.

    Null texts count as empty; rows with a null id go where their text has a row with
    an id. Of rows that agree in id and text the first by a hash of all their columns
    stays. Columns may have any names. An empty table gives no rows.
    """
    found = written(decisions(df, id_col, text_col, salts=salts).filter("not kept or n_same > 1"), "dedup-drops")

    def same_text(row: Column, mark: Column) -> Column:
        # No join key, so that digests are made only where ids are equal; both have 64 digits.
        return F.instr(mark.getField("digest"), sha256(normalised(row.getField(text_col)))) == 1

    drops = written(found.filter("not kept").select("id", "digest"), "dedup-dropped")
    again = written(found.filter("kept and n_same > 1").select("id", "digest"), "dedup-again")
    stay = matched(df, id_col, drops, "left_anti", same_text)
    if again.isEmpty():
        return stay
    rows = matched(stay, id_col, again, "left_semi", same_text)
    row = F.struct(*[rows[c] for c in rows.columns])
    key = [rows[id_col].alias("_id"), sha256(normalised(rows[text_col])).alias("_digest")]
    one = rows.select(row.alias("row"), F.xxhash64(F.to_json(row)).alias("order"), *key).groupBy("_id", "_digest").agg(F.min_by("row", "order").alias("row"))
    return matched(stay, id_col, again, "left_anti", same_text).union(one.select("row.*"))

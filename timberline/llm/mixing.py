"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each document is due ``ratio * weight`` copies. Its whole copies are certain; for the
remaining fraction p, documents are ranked by the odds of a uniform draw over the odds
of p, and the smallest ranks are taken until the source's remaining words are filled.
The cut is found from a histogram of ranks, its groups first and then the buckets of
one group, and one ordered look into the bucket where the words run out, so no source is
ever sorted as a whole. What one source needs to
judge its rows is a single row of cuts; the documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Ranks are counted in so many buckets, and first in groups of so many of these.
BUCKETS, GROUP = 1 << 14, 1 << 7
#: Words that count for a document's weight.
LONG = 1000
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(text: Column) -> Column:
    """LONG and a document's words, up to LONG of them: what has a thousand words is due twice as often as what has none."""
    return F.lit(LONG).cast("long") + F.least(n_words(text), F.lit(LONG).cast("long"))


def uniform(id_col: Column, seed: str = "") -> Column:
    """A draw in (0, 1) that depends on the id alone: 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size): words shared by weight under caps.

    Sources weigh ``weights`` in turn, by code point, null last. Caps are ``most`` times
    the size; what is above them is shared again. Sources in order of cap over weight
    are full up to the first one whose cap exceeds its share of what is left.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn - 1) % len(weights) + 1).cast("double")
    cap = F.col("source_size").cast("double") * most
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("turn"))
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sources.select("source", "source_size", turn.alias("turn"), weight.alias("weight"), cap.alias("cap"))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - before) / rest)
        .withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
        .withColumn("shared", F.min_by("level", F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("shared")))
        .select("source", "source_size", "target")
    )


def _with_source(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    t = table.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(t) if small else t, rows.source.eqNullSafe(t.source_), "left").drop("source_")


def _ranked(rows: DataFrame, seed: str, most: int) -> DataFrame:
    """Adds base, rank and bucket to rows with id, weight, ratio."""
    due = F.least(F.col("ratio") * F.col("weight"), F.lit(float(most)))
    u, p = F.col("u"), F.col("p")
    rank = F.when(p > 0, (u / (1 - u)) / (p / (1 - p))).otherwise(F.lit(float("inf")))
    return (
        rows.withColumn("base", F.floor(due))
        .withColumn("p", due - F.col("base"))
        .withColumn("u", uniform(F.col("id"), seed))
        .withColumn("rank", rank)
        .withColumn("bucket", F.when(p > 0, F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS)).otherwise(F.lit(BUCKETS)).cast("int"))
        .drop("u", "p")
    )


class Mix:
    """The cuts of each source, found over all rows of ``df``.

    ``weight`` says how often rows of a source are due against each other; whole
    numbers are summed exactly, null and negative ones count as 0, and rows of weight 0
    come after all others of their source. Rows that share an id and a source are taken
    together. Null texts have size 0 and null sources are a source; an empty table gives
    empty results. Columns may have any names.
    """

    def __init__(
        self, df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *,
        weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "",
    ):
        self.seed, self.most, self.id_col, self.source_col = seed, most, id_col, source_col
        self.weight = F.lit(1).cast("long") if weight is None else F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0))
        self.sized = sized = written(
            df.select(df[id_col].alias("id"), df[source_col].alias("source"), n_words(df[text_col]).alias("size"), self.weight.alias("weight")), "mix-sizes"
        )
        sources = sized.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighted")
        )
        sources = written(sources, "mix-sources")
        self.small = sources.count() <= BROADCAST_SOURCES
        shared = targets(sources.select("source", "source_size"), weights, share, most)
        s, w = shared.alias("s"), sources.alias("w")
        self.plan = written(
            s.join(w, F.col("s.source").eqNullSafe(F.col("w.source"))).select(
                "s.source", "s.source_size", "s.target",
                F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0).alias("ratio"),
            ), "mix-targets",
        )
        self.cuts = written(self._cuts(), "mix-cuts")

    def _cuts(self) -> DataFrame:
        ranked = _ranked(_with_source(self.sized, self.plan, self.small), self.seed, self.most)
        by_bucket = ranked.groupBy("source", "bucket").agg(
            F.sum(F.when(F.col("base") < self.most, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("base") * F.col("size")).alias("certain")
        )
        by_bucket = written(by_bucket, "mix-buckets")
        certain = by_bucket.groupBy("source").agg(F.sum("certain").alias("certain"))
        quotas = _with_source(self.plan, certain, self.small).withColumn("quota", F.col("target") - F.col("certain")).select("source", "quota")
        def where_words_run_out(sums: DataFrame, place: str, before: Column) -> DataFrame:
            so_far = F.sum("words").over(Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            past = sums.withColumn("so_far", before + so_far).filter("so_far > quota").groupBy("source")
            first = past.agg(F.min(F.struct(place, (F.col("so_far") - F.col("words")).alias("before"))).alias("at"), F.first("quota").alias("quota"))
            return first.select("source", F.col(f"at.{place}").alias(f"cut_{place}"), F.col("at.before").alias("before"), "quota")

        group = F.floor(F.col("bucket") / GROUP).cast("int").alias("group")
        groups = by_bucket.groupBy("source", group).agg(F.sum("words").alias("words"))
        cut_groups = written(where_words_run_out(_with_source(groups, quotas, self.small), "group", F.lit(0)), "mix-groups")
        fine = _with_source(by_bucket.withColumn("group", group), cut_groups, self.small).filter("group = cut_group")
        over = where_words_run_out(fine, "bucket", F.col("before"))
        over = written(over, "mix-over")
        free = _with_source(ranked.filter(F.col("base") < self.most), over, self.small)
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id"))
        last = (
            free.filter("bucket = cut_bucket")
            .withColumn("upto", F.col("before") + upto)
            .filter("upto <= quota")
            .groupBy("source")
            .agg(F.max(F.struct("rank", "id")).alias("cut"), F.max("upto").alias("upto"))
        )
        cuts = _with_source(over, last, self.small).withColumn("gap", F.col("quota") - F.coalesce("upto", "before"))
        # One more document per source, the one whose size is nearest to the words still missing.
        left = _with_source(ranked.filter((F.col("base") < self.most) & (F.col("size") > 0)), cuts, self.small).filter(~taken() & (F.col("size") < 2 * F.col("gap")))
        more = left.groupBy("source").agg(
            F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "id")).alias("more")
        )
        return _with_source(cuts, more, self.small).select(
            "source", "cut_bucket", "cut", F.col("more.id").alias("more_id"), F.col("more").isNotNull().alias("has_more")
        )

    def copies(self, rows: DataFrame, id_col: Column, source: Column, weight: Column | None = None) -> DataFrame:
        """Adds ``copies`` to rows; nothing is shuffled."""
        keyed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), id_col.alias("id"), source.alias("source"), (self.weight if weight is None else weight).alias("weight"))
        ranked = _with_source(_ranked(_with_source(keyed, self.plan, self.small), self.seed, self.most), self.cuts, self.small)
        extra = (F.col("base") < self.most) & (F.coalesce(taken(), F.lit(True)) | (F.col("has_more") & F.col("id").eqNullSafe(F.col("more_id"))))
        due = F.col("ratio") > 0
        return ranked.select("row", "source_size", "target", F.when(due, F.col("base") + extra.cast("long")).otherwise(0).cast("long").alias("copies"))

    def report(self) -> DataFrame:
        """id, size, source_size, target and the words taken, for each row."""
        out = self.copies(self.sized, F.col("id"), F.col("source"), F.col("weight"))
        return out.select(
            F.col("row.id").alias(self.id_col), F.col("row.size").alias("size"), "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken")
        )

    def mixed(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, each as often as the mix takes it."""
        out = self.copies(df, df[self.id_col], df[self.source_col])
        return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def taken() -> Column:
    """Whether a row's rank is below its source's cut; null where the source has no cut, as all its rows fit."""
    here = F.struct("rank", "id")
    return (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(here <= F.col("cut"), F.lit(False)))

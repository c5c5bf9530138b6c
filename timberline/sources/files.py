"""Corpora, ground truth and templates in files; exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import written


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty lines (``value``) of a file, or of every file directly in a folder."""
    return spark.read.option("recursiveFileLookup", "false").text(path).filter("value <> ''")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_id from 1, line) of one text file: a row's place in its split, after the counts of the splits before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "numbered")
    splits = rows.groupBy("split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("split", (before - F.col("first") + 1).alias("shift")), "split").select((F.col("at") + F.col("shift")).alias("line_id"), F.col("value").alias("line"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, content, truth) of a CSV with LineId, Content and EventTemplate."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.select(F.col("LineId").cast("long").alias("line_id"), F.col("Content").alias("content"), F.col("EventTemplate").alias("truth"))


def matched_truth(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines with their truth; raises on a line without a row or a row without a line."""
    both = lines.join(rows, "line_id", "full")
    return both.withColumn("truth", F.when(F.col("line").isNull() | F.col("truth").isNull(), F.raise_error(F.concat(F.lit("no match for line "), "line_id"))).otherwise(F.col("truth")))


def template_regex(template: Column, wildcard: str = "<*>") -> Column:
    """A template with wildcards as an anchored pattern."""
    quoted = F.transform(F.split(template, wildcard.replace("*", r"\*"), -1), lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(quoted, ".*?"), F.lit("$"))


def truth_match(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """The most specific template of each line: fewest wildcards, then most literal text; a tie is ambiguous.

    A template's literal tokens, those between spaces without a wildcard, must all be
    tokens of the line, so that a line meets only the templates whose rarest such token
    it has. Lines that share a text are matched once. Templates without a literal token
    (they are few in a reviewed list) are looked at for every text.
    """
    wild = (F.length("template") - F.length(F.replace("template", F.lit("<*>"), F.lit("")))) / 3
    known = templates.select("event", "template", template_regex(F.col("template")).alias("rx"), wild.cast("int").alias("wild"))
    known = known.withColumn("literal", F.length("template") - 3 * F.col("wild"))
    texts = written(lines.select("content").distinct(), "truth-texts")
    plain = known.select("event", "template", F.explode(F.array_distinct(F.filter(F.split("template", " "), lambda t: ~F.contains(t, F.lit("<*>")) & (t != "")))).alias("token"))
    tokens = texts.select("content", F.explode(F.array_distinct(F.split("content", " "))).alias("token"))
    seen = tokens.join(F.broadcast(plain.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = plain.join(seen, "token", "left").groupBy("event", "template").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    keyed = known.join(rarest, ["event", "template"], "left")
    met = tokens.join(keyed.filter("token is not null"), "token").select("content", "event", "rx", "wild", "literal")
    free = keyed.filter("token is null").select(F.collect_list(F.struct("event", "rx", "wild", "literal")).alias("all"))
    any_ = texts.crossJoin(F.broadcast(free)).select("content", F.inline("all"))
    hits = met.unionByName(any_).filter(F.expr("content RLIKE rx")).groupBy("content").agg(F.min(F.struct("wild", (-F.col("literal")).alias("literal"))).alias("best"), F.collect_list(F.struct("event", "wild", "literal")).alias("all"))
    best = F.filter("all", lambda h: (h["wild"] == F.col("best.wild")) & (h["literal"] == -F.col("best.literal")))
    found = hits.select("content", F.when(F.size(best) == 1, F.get(best, 0)["event"]).otherwise(F.lit("ambiguous")).alias("event"))
    return lines.join(found, "content", "left")


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns as tab-separated text; tabs and line ends inside values become spaces."""
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in df.columns]
    df.select(*flat).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)

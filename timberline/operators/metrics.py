"""How well clusters agree with ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouping_accuracy(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: ga, the share of lines in groups reproduced exactly, and fga, the F1 over groups."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    in_truth = pairs.groupBy("t").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.first("p").alias("p"))
    in_predicted = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("sources"))
    right = in_truth.join(in_predicted, "p")
    exact = (F.col("parts") == 1) & (F.col("sources") == 1)
    sums = right.agg(
        F.sum(F.when(exact, F.col("n")).otherwise(0)).alias("lines"), F.sum("n").alias("all_lines"), F.count_if(exact).alias("groups"), F.count(F.lit(1)).alias("truth_groups")
    ).crossJoin(in_predicted.agg(F.count(F.lit(1)).alias("predicted_groups")))
    precision, recall = F.col("groups") / F.col("predicted_groups"), F.col("groups") / F.col("truth_groups")
    return sums.select(
        (F.col("lines") / F.col("all_lines")).alias("ga"), F.when(F.col("groups") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("fga"),
        "groups", "truth_groups", "predicted_groups",
    )


def impurity(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Predicted clusters of more than one truth group, with their parts, largest first."""
    pairs = df.groupBy(F.col(predicted).alias("predicted"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    mixed = pairs.groupBy("predicted").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("lines"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "truth", "n"))).alias("parts")
    )
    return mixed.filter("groups > 1").withColumn("parts", F.transform("parts", lambda p: F.struct(p["truth"].alias("truth"), p["n"].alias("n")))).orderBy(F.desc("lines"), "predicted")


def merge_count(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: how many clusters hold more than one truth group."""
    return df.groupBy(predicted).agg(F.countDistinct(truth).alias("n")).agg(F.count_if(F.col("n") > 1).alias("merges"))


def splits(df: DataFrame, truth: str = "truth", predicted: str = "predicted", most: int = 10) -> DataFrame:
    """The truth groups in most clusters."""
    found = df.groupBy(F.col(truth).alias("truth")).agg(F.countDistinct(predicted).alias("clusters"), F.count(F.lit(1)).alias("lines")).filter("clusters > 1")
    return found.orderBy(F.desc("clusters"), F.desc("lines"), "truth").limit(most)


def agreement(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: the share of lines whose clusters in two runs have the same members.

    Two clusters have the same members when each is all of the other; sizes tell.
    """
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    size_a = pairs.groupBy("a").agg(F.sum("n").alias("n_a"))
    size_b = pairs.groupBy("b").agg(F.sum("n").alias("n_b"))
    same = pairs.join(size_a, "a").join(size_b, "b")
    whole = (F.col("n") == F.col("n_a")) & (F.col("n") == F.col("n_b"))
    return same.agg((F.sum(F.when(whole, F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))


def cluster_list(lines: DataFrame) -> DataFrame:
    """(template, size, example) of (template, raw, event_id): largest first, then by template, with the first line."""
    return lines.groupBy("template").agg(F.count(F.lit(1)).alias("size"), F.min_by("raw", "event_id").alias("example")).orderBy(F.desc("size"), "template")

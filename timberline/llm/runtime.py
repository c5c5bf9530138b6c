"""What the operators share: the shared folder, written stages and lookups that skew cannot stall."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

__all__ = ["dealt_join", "matched", "new_folder", "shared_dir", "ship", "summed", "written"]

#: Narrow tables of up to so many rows (about 60 MB with their digests) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the session names in ``spark.checkpoint.dir``. Only where that is
    unset, as in local tests, a temporary folder of this machine takes its place.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timberline-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages
    before. The rows stay until the folder is emptied, since results are lazy.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matched(rows: DataFrame, id_col: str, marks: DataFrame, how: str, also: Callable[[Column, Column], Column] | None = None, take: Sequence[str] = ()) -> DataFrame:
    """The rows (``left_semi``) or other rows (``left_anti``) whose id is in ``marks.id``, null equal to null; ``inner`` adds the columns ``take`` of the mark.

    ``also(row, mark)`` is looked at only where ids are equal. ``marks`` should be a
    written table: it is counted, and broadcast where it is small, so that rows stay
    where they are; else both sides are shuffled by a hash of the id.
    """
    r = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.xxhash64(rows[id_col]).alias("key"))
    m = marks.select(F.struct(*[marks[c] for c in marks.columns]).alias("mark"), F.xxhash64(marks["id"]).alias("mark_key"))
    same = F.col("row").getField(id_col).eqNullSafe(F.col("mark.id"))
    if also:
        same &= also(F.col("row"), F.col("mark"))
    small = marks.count() <= BROADCAST_ROWS
    return r.join(F.broadcast(m) if small else m, (r.key == m.mark_key) & same, how).select("row.*", *[F.col("mark").getField(c).alias(c) for c in take])


def _salted(rows: DataFrame, spread: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))


def dealt_join(rows: DataFrame, key: str, table: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Joins ``table``, which has each key once, without one task for all rows of a key.

    Rows are dealt by (key, salt of ``spread``), and the table's row goes to each salt
    where its key has rows.
    """
    salted = _salted(rows, spread)
    places = salted.select(key, "salt").distinct()
    return salted.join(places.join(table, key), [key, "salt"], how).drop("salt")


def summed(rows: DataFrame, key: str, spread: Column, least: str) -> DataFrame:
    """Adds ``least_of_key``, the least ``least`` of all rows with the same ``key``; dealt as ``dealt_join`` deals."""
    salted = _salted(rows, spread)
    local = salted.groupBy(key, "salt").agg(F.min(least).alias("m"))
    whole = local.groupBy(key).agg(F.min("m").alias("least_of_key"), F.collect_list("salt").alias("salts"))
    return salted.join(whole.select(key, "least_of_key", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")

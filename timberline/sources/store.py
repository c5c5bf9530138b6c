"""Tables of judgments, records, merge decisions and alarms, as Parquet folders.

Verdicts and records are kept by template: they are dealt into a fixed number of
folders by a hash of the template id, so that reading one template reads one folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

FOLDERS = 64


def _shard(template_id) -> Column:
    return F.pmod(F.xxhash64(template_id), F.lit(FOLDERS)).cast("int")


class Store:
    """Appends and reads; what is read of a table that is not there yet has no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        out = rows.withColumn("shard", _shard(F.col("template_id"))) if "template_id" in rows.columns else rows
        writer = out.write.mode("append")
        (writer.partitionBy("shard") if "shard" in out.columns else writer).parquet(f"{self.path}/{table}")

    def read(self, table: str, schema) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{table}").drop("shard")
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def of_template(self, table: str, template_id: str, at: str) -> DataFrame:
        """The rows of one template, oldest first, from its folder alone."""
        shard = self.spark.range(1).select(_shard(F.lit(template_id))).first()[0]
        rows = self.spark.read.parquet(f"{self.path}/{table}").filter((F.col("shard") == shard) & (F.col("template_id") == template_id))
        return rows.drop("shard").orderBy(at)

    def judged(self, records: DataFrame, verdicts: DataFrame) -> None:
        """Records first: a verdict is never there without its record."""
        self.append("records", records)
        self.append("verdicts", verdicts)

    def merges(self, rows: DataFrame) -> None:
        """Merge decisions with the lesser id first."""
        lo, hi = F.least("id_lo", "id_hi"), F.greatest("id_lo", "id_hi")
        turned = F.col("id_lo") > F.col("id_hi")
        out = rows.withColumns(
            {
                "id_lo": lo, "id_hi": hi,
                "template_lo": F.when(turned, F.col("template_hi")).otherwise(F.col("template_lo")), "template_hi": F.when(turned, F.col("template_lo")).otherwise(F.col("template_hi")),
            }
        )
        self.append("merges", out)

    def alarm_sink(self) -> Callable[[DataFrame, int], None]:
        """For ``streaming.jobs.upsert``: keeps every change; the current alarms are a view of them.

        A batch that runs again replaces what it wrote.
        """

        def sink(rows: DataFrame, batch_id: int) -> None:
            rows.write.mode("overwrite").parquet(f"{self.path}/alarm_changes/batch={batch_id}")

        return sink

    def feed(self, after: int, most_behind: int = 256) -> tuple[str, int, DataFrame]:
        """What a follower that has seen batch ``after`` gets: ("changes" or "resync", the last batch, rows).

        One that is more than ``most_behind`` batches behind, or before the first batch
        that is still there, is given all open alarms instead of the changes in between.
        """
        rows = self.spark.read.parquet(f"{self.path}/alarm_changes")
        first, last = rows.agg(F.min("batch"), F.max("batch")).first()
        if last is not None and (last - after > most_behind or after + 1 < first):
            return "resync", last, self.open_alarms()
        order = [c for c in ("batch", "at_sec") if c in rows.columns]
        return "changes", after if last is None else last, rows.filter(F.col("batch") > after).orderBy(*order)

    def _snapshot(self) -> tuple[int, DataFrame] | None:
        """The last batch that a snapshot covers, and its rows: each alarm's last change and when it opened."""
        try:
            manifest = self.spark.read.schema("through long, path string").parquet(f"{self.path}/alarm_manifest")
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = manifest.agg(F.max_by(F.struct("through", "path"), "through").alias("m")).first().m
        return None if row is None else (row.through, self.spark.read.parquet(row.path))

    def _last_changes(self) -> DataFrame:
        """Each alarm's last change and ``opened_sec``, from the snapshot and what came after."""
        rows = self.spark.read.parquet(f"{self.path}/alarm_changes")
        rest = [c for c in rows.columns if c != "alarm_id"]
        rows, found = rows.withColumn("opened_sec", F.col("at_sec")), self._snapshot()
        if found:
            through, snapshot = found
            rows = rows.filter(F.col("batch") > through).unionByName(snapshot)
        last = rows.groupBy("alarm_id").agg(F.max_by(F.struct(*rest), F.struct("at_sec", "batch")).alias("r"), F.min("opened_sec").alias("opened_sec"))
        return last.select("alarm_id", "opened_sec", "r.*")

    def compact(self, cooldown: int = 1800, most_behind: int = 256) -> int | None:
        """Put the alarms as they are now into a snapshot, so that ``open_alarms`` reads it and later batches alone.

        A cleared alarm stays in the snapshot for as long as it can be revived. The
        snapshot is written whole, then a manifest of one row names it: a reader sees
        the state before or after. Batches of changes that are more than ``most_behind``
        before it are deleted, of older snapshots all but one; who still reads by an
        older manifest must be done within that many batches. Returns the last batch in it.
        """
        last = self._last_changes()
        through, now = last.agg(F.max("batch"), F.max("at_sec")).first()
        found = self._snapshot()
        if through is None or (found and through <= found[0]):
            return found[0] if found else None
        path = f"{self.path}/alarm_snapshots/through={through}-{uuid.uuid4().hex}"
        last.filter((F.col("op") != "Cleared") | (F.col("at_sec") >= now - cooldown)).coalesce(1).write.parquet(path)
        self.spark.createDataFrame([(through, path)], "through long, path string").coalesce(1).write.mode("append").parquet(f"{self.path}/alarm_manifest")
        self._delete("alarm_changes", "batch=", lambda n: n <= through - most_behind)
        self._delete("alarm_snapshots", "through=", lambda n: n < (found[0] if found else through))
        return through

    def _delete(self, table: str, prefix: str, gone: Callable[[int], bool]) -> None:
        """Remove a table's folders by the number in their names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.startswith(prefix) and gone(int(name.removeprefix(prefix).partition("-")[0])):
                fs.delete(status.getPath(), True)

    def open_alarms(self) -> DataFrame:
        """Alarms whose last change is not a clear, oldest first."""
        return self._last_changes().filter("op <> 'Cleared'").orderBy("opened_sec", "alarm_id")


def corrected(verdicts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Verdicts with a reviewer's answers in place of the given ones; null corrections change nothing."""
    fields = [c for c in ("severity", "actionable", "contextual") if c in corrections.columns]
    own = corrections.select("template_id", *[F.col(c).alias(f"_{c}") for c in fields])
    joined = verdicts.join(own, "template_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*verdicts.columns)


def pages(changes: DataFrame, send: Callable[[list[dict]], None], most: int = 1000):
    """A stream's raised alarms of the Page lane, handed to ``send`` in each batch, ``most`` at a time."""

    def push(batch: DataFrame, _: int) -> None:
        held: list[dict] = []
        for row in batch.filter("op = 'Raised' AND lane = 'Page'").toLocalIterator():
            held.append(row.asDict())
            if len(held) == most:
                send(held)
                held = []
        if held:
            send(held)

    return changes.writeStream.outputMode("append").foreachBatch(push)

"""Streaming twins: masked counts, template mining and alarms as streams.

Order matters to mining and alarms, and micro-batches do not keep it, so their state
holds rows back until the watermark passes and then takes them in order of
(received_at, event_id). ``availableNow`` runs end with what the batch operators give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import mask
from ..functions.text import template_id, tokens
from ..operators.alarms import AlarmConfig
from ..operators.drain import Config
from ..runtime import importable, new_folder, ship
from .lines import STORE
from .mining import ASSIGNED, LineMiner


def classified(lines: DataFrame) -> DataFrame:
    """A stream of lines with raw text as lines with template and template_id."""
    return lines.withColumn("template", mask(F.col("raw"))).withColumn("template_id", template_id(F.col("template")))


def template_counts(lines: DataFrame, lateness: str = "10 minutes", bucket: str = "10 seconds") -> DataFrame:
    """Counts of each template in tumbling buckets; later lines than ``lateness`` are left out."""
    return lines.withWatermark("received_at", lateness).groupBy("template_id", F.window("received_at", bucket)).agg(F.count(F.lit(1)).alias("lines"))


def sessions(lines: DataFrame, silence: str = "15 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Lines of each (template, host) between silences."""
    return lines.withWatermark("received_at", lateness).groupBy("template_id", "host", F.session_window("received_at", silence)).agg(F.count(F.lit(1)).alias("lines"))


def mine(lines: DataFrame, config: Config = Config(), lateness: str = "10 minutes") -> DataFrame:
    """Assignments (event_id, n_tokens, local, template_id_at_train, size), mined by token count with keyed state.

    ``max_clusters`` holds for each token count here. Sets the session's state store to
    one with timers.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)
    words = F.array_join(tokens(F.col("template"), config.max_tokens), " ")
    rows = lines.withWatermark("received_at", lateness).select("received_at", "event_id", words.alias("text"), F.unix_micros("received_at").alias("at_us")).withColumn("n", F.size(F.split("text", " ")))
    with importable(spark):
        return rows.groupBy("n").transformWithStateInPandas(LineMiner(config), ASSIGNED, "append", "EventTime")


def to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into the shared folder, a part for each batch, and give back its rows."""
    at = new_folder(spark, "stream")

    def part(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(part).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream into Parquet files, restarted from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert(changes: DataFrame, sink, key: str = "alarm_id"):
    """The change feed's last row of each alarm in every batch, handed to ``sink(frame, batch_id)``."""

    def last(batch: DataFrame, batch_id: int) -> None:
        rows = [c for c in batch.columns if c != key]
        sink(batch.groupBy(key).agg(F.max_by(F.struct(*rows), F.struct("at_sec", "count")).alias("r")).select(key, "r.*"), batch_id)

    return changes.writeStream.outputMode("append").foreachBatch(last)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of lines."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A table of one file is read by few tasks; masking is dealt out.
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).repartition(spark.sparkContext.defaultParallelism)
    raw = F.concat(F.lit("app["), F.col("user_id").cast("string"), F.lit("]: "), "event_type", F.lit(" event "), F.col("event_id").cast("string"), F.lit(" took "), F.floor(F.col("value") * 100).cast("long").cast("string"), F.lit("ms"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("received_at"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("host"), raw.alias("raw"))


def counted_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = to_end(spark, template_counts(classified(event_stream(spark, sf_dir))), "update")
    last = counts.groupBy("template_id", "window").agg(F.max("lines").alias("lines"))
    return last.groupBy("template_id").agg(F.sum("lines").alias("lines"))


def mined_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_end(spark, mine(classified(event_stream(spark, sf_dir)), lateness="0 seconds")).select("event_id", "template_id_at_train", "size")


def dealt_to_end(spark: SparkSession, sf_dir: str, lines) -> DataFrame:
    """Mining as a stream of the orders table, made into lines by ``lines(frame)``."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    rows = lines(orders).withColumn("received_at", F.col("received_at").cast("timestamp"))
    return to_end(spark, mine(rows, lateness="0 seconds")).select("event_id", "template_id_at_train", "size")


def alarms_to_end(spark: SparkSession, sf_dir: str, c: AlarmConfig = AlarmConfig(contextual=float("inf")), answers: DataFrame | None = None) -> DataFrame:
    """The feed from raw lines to alarms; without contextual checks unless ``c`` asks for them."""
    from ..plans.lines import SQUEEZE, table, verdicts
    from .lines import alarm_feed, first_micros

    origin = first_micros(spark, table(spark, sf_dir, "events"))
    feed = alarm_feed(classified(event_stream(spark, sf_dir)), verdicts(spark), c, answers=answers, origin_us=origin, squeeze=SQUEEZE, lateness="0 seconds")
    return to_end(spark, feed)

"""Shipping this package to Python workers, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


#: Most bytes of an Arrow batch, which a worker and its executor hold at once; rows of long texts are far from alike.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver runs; once for each context.

    Also bounds the bytes of the session's Arrow batches, unless it has a bound of its own below Spark's.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size).rstrip("b") == str(64 << 20):
        spark.conf.set(size, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_timberline_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="timberline-"), "timberline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._timberline_shipped = True


@contextmanager
def importable(spark: SparkSession) -> Iterator[None]:
    """Functions made within are read by processes that find this package where the driver has it.

    The driver's own process for keyed state is not given shipped code.
    """
    environment = spark.sparkContext.environment
    before = environment.get("PYTHONPATH")
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(_PACKAGE.parent), before]))
    try:
        yield
    finally:
        if before is None:
            del environment["PYTHONPATH"]
        else:
            environment["PYTHONPATH"] = before


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
    """Write rows as Parquet in the shared folder and read them back.

    What several branches read is then made once, and a lost executor costs the tasks
    it ran, not what came before. The rows stay until the folder is emptied, since
    results are lazy.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer partitions than the cluster has cores, dealt out; others as they are. For work that needs much CPU a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

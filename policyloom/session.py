"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "policyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    On a cluster, leave ``master`` unset and let spark-submit decide it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # text rows are wide: small Arrow batches keep Python memory flat
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's if it names one.

    Only a session whose executors are threads of the driver may do without the
    setting; it gets a folder of its own.  Elsewhere each executor would write to
    its own disk, so a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs that run inside send whole texts to Python in batches of so many rows at most, whatever the session says."""
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` writes inside, once the job that needed them has written its own result.

    What is left of the job's shuffles is let go as well: Spark deletes their files when nothing refers to them.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        jvm = spark.sparkContext._jvm
        for path in own:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        gc.collect()
        jvm.java.lang.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder, and read it back.

    Unlike a checkpoint the result is columnar, so later scans are pruned.  Inside
    ``temporary_tables`` the table is removed at the end.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4()}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

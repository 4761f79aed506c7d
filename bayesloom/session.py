"""Session helpers: local session for tests/bench and the reliable checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "bayesloom") -> SparkSession:
    """Local session used by tests and the bench (a cluster brings its own session)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where it's unset, a folder in the session's warehouse, which every executor shares too; it is removed at exit if the
    warehouse is a local one (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bayesloom-{uuid.uuid4().hex[:12]}"
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, re.sub("^file:/*", "/", path), ignore_errors=True)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for rows whose placement must not change once it has been looked at."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read back: plans that read it know its size and not its history."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = df.__dict__.get("_written")
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cached(df: DataFrame) -> DataFrame:
    """A table that is read several times; a lost part is computed again from its inputs. The caller unpersists it where
    it knows the last reader; model tables that a result still reads stay until the session drops them."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

"""Session construction shared by bench and tests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quillspark", **conf: str) -> SparkSession:
    """Session with the settings every operator assumes; on a cluster pass the cluster's own master and conf."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which the driver and all executors share; only a local session may lack it. What is written there is
    deleted when the driver's JVM ends, or by ``drop_work``."""
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        folder = _own[app]
    at, store = _located(spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{at.toString()}/{name}"


def _located(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_work(spark: SparkSession, path: str) -> None:
    """Delete what was written to a ``work_path``."""
    at, store = _located(spark, path)
    store.delete(at.getParent(), True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a work table and read again: worked out once, and safe from lost executors."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

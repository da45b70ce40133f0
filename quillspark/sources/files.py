"""Files through Hadoop's file system, on the driver, and single files written by tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = hadoop_path(spark, path)
    return store.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    at, store = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, store = hadoop_path(spark, path)
    store.delete(at, True)


def publish(spark: SparkSession, private: str, final: str) -> bool:
    """Give a folder its final name by one rename; false, and the folder is deleted, if the name is taken."""
    (at, store), (to, _) = hadoop_path(spark, private), hadoop_path(spark, final)
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), context._jsc.hadoopConfiguration())
    none = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(at, to, none)  # fails if the name is taken
    except Exception:
        store.delete(at, True)
        if store.exists(to):
            return False
        raise
    return True


def _write(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = f"{base.rstrip('/')}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(content)
            yield batch[["name"]]

    return run


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row (name, content binary) as a file below ``root``, a folder's URI that all executors reach, in the task that holds it; how
    many were written. A task that runs again writes the same files again."""
    # Hadoop spells a local folder file:/a as well as /a; Arrow knows file:///a only.
    root = re.sub("^(file:)?/(?!/)", "file:///", root)
    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(_write(root), "name string").count()


#: Rows that a listing task hands over at once.
_LISTED = 10_000


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, rows = ["path", "bytes", "folder"], []
    for batch in batches:
        for folder in batch["path"]:
            with os.scandir(re.sub("^file:/+", "/", folder)) as entries:
                for e in entries:
                    name = os.fsencode(e.name).decode("utf-8", "replace")
                    try:
                        is_folder = _seen(name) and e.is_dir()
                        size = e.stat().st_size if _seen(name) else 0
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
                    if is_folder or size > 0:
                        rows.append((f"{folder.rstrip('/')}/{name}", size, is_folder))
                    if len(rows) == _LISTED:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of the files below ``root`` (a path or a pattern of paths) that Spark's readers would read: hidden and empty ones are none.

    A local folder, which all executors must reach, is listed by tasks, level by level and a folder at a time, into work tables; neither the driver nor a task
    holds the names. Other stores are listed by Spark, whose driver holds them.
    """
    at, store = hadoop_path(spark, root)
    if store.getUri().getScheme() != "file":
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    roots = store.globStatus(at)
    if not roots:
        raise FileNotFoundError(root)
    schema, rows = "path string, bytes long, folder boolean", [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in roots]
    levels = [spark.createDataFrame(rows, schema)]
    while levels[-1].where("folder").limit(1).count():
        folders = levels[-1].where("folder").select("path")
        tasks = min(folders.count(), 4 * spark.sparkContext.defaultParallelism)
        levels.append(written(folders.repartition(tasks).mapInPandas(_list, schema), "listing"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionAll(level)
    return found.where("NOT folder AND bytes > 0").select("path", "bytes")

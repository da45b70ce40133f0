"""Shared pieces: work tables in the shared folder, and word codes and hashes over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 3 << 20
_own: dict[str, str] = {}
_made: dict[str, str] = {}
_scope: contextvars.ContextVar[set[str] | None] = contextvars.ContextVar("work", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _own[context.applicationId]


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table through Hadoop's file system, so any store works."""
    at, store = hadoop_path(spark, path)
    store.delete(at, True)
    _made.pop(path, None)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path, app in list(_made.items()):
        if spark is not None and spark.sparkContext.applicationId == app:
            with contextlib.suppress(Exception):  # the context may be gone at exit
                drop_path(spark, path)


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by ``work`` around it or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark.sparkContext.applicationId
    if (inside := _scope.get()) is not None:
        inside.add(path)
    return path


@contextlib.contextmanager
def work(spark: SparkSession):
    """Work tables that are made inside, in this context, are deleted at the end, but for those that the caller appends to the list given, which
    belong to the ``work`` around then. Other threads' tables are left alone."""
    around, inside, kept = _scope.get(), set(), []
    token = _scope.set(inside)
    try:
        yield kept
    finally:
        _scope.reset(token)
        for path in inside - set(kept):
            drop_path(spark, path)
        if around is not None:
            around.update(kept)


def quoted(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and reread it: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", most: int = 400_000) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and which says in ``rows`` how many rows of ``left`` have each.

    Up to ``most`` keys are broadcast, those with the most rows; the others, if there are more, meet in a shuffle. A key of that
    shuffle has at most 2 / ``most`` of all rows. ``right`` is read several times, so pass a written table.
    """
    level = F.floor(F.log2(F.greatest(F.col(rows), F.lit(1)))).cast("int")
    sizes = right.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 64 rows at most
    if sum(r["n"] for r in sizes) <= most:
        return left.join(F.broadcast(right.drop(rows)), on, how)
    taken, least = 0, 1 << 62
    for r in sizes:
        taken += r["n"]
        if taken > most:
            break
        least = 1 << r["level"]
    hot = right.where(F.col(rows) >= least)
    rest = right.where(F.col(rows) < least).drop(rows)
    return left.join(F.broadcast(hot.drop(rows)), on, how).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest.hint("merge"), on, how))


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo: the fold a row falls in."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes of text (one row, if it is longer) and ``rows`` rows; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(k), "")
        batch = batch.set_column(k, text, filled)
        size = np.cumsum(np.asarray(pc.binary_length(filled)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(size, base + limit, side="right"))))
            yield batch.slice(start, end - start)
            start = end
            pa.default_memory_pool().release_unused()  # what one chunk took isn't kept beside the next one's


class Words:
    """Words of a batch of texts: runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased unless ``fold`` is false.

    ``codes``: a code into ``words`` for each word in order; ``offsets``: where each text's words begin.
    """

    def __init__(self, texts: pa.Array, fold: bool = True):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if fold else texts)
        flat = split.flatten()
        owner = np.repeat(np.arange(len(split)), np.asarray(pc.list_value_length(split)))
        coded = flat.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.codes = np.asarray(coded.indices).astype(np.int64)
        full = np.asarray(pc.binary_length(self.words))[self.codes] > 0 if len(self.codes) else np.zeros(0, bool)
        if not full.all():
            self.codes, owner = self.codes[full], owner[full]
        counts = np.bincount(owner, minlength=len(split))
        self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


_BYTES = _table(11, 256)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, by differences of a running polynomial sum; no row at a time."""
    values = values.cast(pa.large_string())
    if not len(values):
        return np.zeros(0, np.uint64)
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    base = int(at[0])
    raw = np.frombuffer(data, np.uint8)[base : int(at[-1])] if data is not None else np.zeros(0, np.uint8)
    at = at - base
    down = np.full(len(raw) + 1, _BACK, np.uint64)
    up = np.full(len(raw) + 1, _STEP, np.uint64)
    down[0] = up[0] = 1
    down, up = np.multiply.accumulate(down), np.multiply.accumulate(up)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * down[:-1], out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) * up[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64) * np.uint64(_STEP))


def binary_rows(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

"""Size-tiered compaction: arrivals become small immutable shards, alike shards merge into target-sized files, and a
versioned manifest is committed atomically."""

from __future__ import annotations

import contextlib
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import names, publish

TARGET_BYTES = 64 << 20
SHARD_ROWS = 4000
FANOUT = 4
#: Shards whose paths one merge takes to the driver; a tier with more is merged in turns.
MOST_PATHS = 10_000
#: Seconds that a data folder is kept after its last change though no manifest names it: longer than any append or merge takes.
GRACE = 86_400.0
_MANIFEST = "path string, bytes long, rows long, tier int"


class Conflict(RuntimeError):
    """Another writer has committed the version first; nothing of the shards written for it counts."""


class ShardStore:
    """A table of immutable Parquet shards under ``root`` (any store that Spark can read and rename in).

    ``data/<batch>/`` holds shards, ``manifest/v<number>`` one small Parquet table for each version: the shards that
    make it up. A version counts once its folder has its final name, which is given by one rename that fails if the
    name is taken; readers see a whole version or none, and a writer that lost the race gets ``Conflict``. A number is never
    given twice: ``vacuum`` empties the folders of old versions, but leaves their names.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.shard_rows, self.fanout = target_bytes, shard_rows, fanout
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _session(self) -> SparkSession:
        """A session of its own, so that file packing is set without touching the caller's settings."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return session

    def _numbers(self) -> list[int]:
        """All numbers ever given."""
        return sorted(int(n[1:]) for n in names(self.spark, f"{self.root}/manifest") if n.startswith("v"))

    def latest(self) -> int:
        """The last version; 0 if there is none."""
        return max(self._numbers(), default=0)

    def versions(self) -> list[int]:
        """The versions that can be read."""
        return [v for v in self._numbers() if self._has_files(f"{self.root}/manifest/v{v}")]

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, tier) of the shards of a version, by default the latest."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{version}")

    @contextlib.contextmanager
    def _against(self, base: int):
        """What fails inside because another writer has replaced version ``base`` in the meantime, and cleaned up after it, is a ``Conflict``."""
        try:
            yield
        except Conflict:
            raise
        except Exception as e:
            if self.latest() != base:
                raise Conflict(f"version {base} isn't the latest any more") from e
            raise

    def _commit(self, shards: DataFrame, base: int) -> int:
        """Make ``shards`` version ``base`` + 1: written under a private name, then renamed."""
        private, final = f"{self.root}/manifest/_{uuid.uuid4().hex}", f"{self.root}/manifest/v{base + 1}"
        with self._against(base):
            shards.select("path", "bytes", "rows", F.col("tier").cast("int").alias("tier")).coalesce(1).write.parquet(private)
        if not publish(self.spark, private, final):
            raise Conflict(f"version {base + 1} is there")
        return base + 1

    def _has_files(self, folder: str) -> bool:
        names = self.fs.listStatusIterator(self._path(folder))
        while names.hasNext():
            if names.next().getPath().getName().startswith("part-"):
                return True
        return False

    def _listed(self, session: SparkSession, folder: str) -> DataFrame:
        """Shards of a folder with their sizes and row counts, found by Spark's own reader; none, if nothing was written."""
        if not self._has_files(folder):
            return self.spark.createDataFrame([], _MANIFEST).select("path", "bytes", "rows")
        read = session.read.parquet(folder)
        at = read.metadataColumn("_metadata")
        rows = read.select(at["file_path"].alias("path"), at["file_size"].alias("bytes"))
        return rows.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))

    def append(self, df: DataFrame) -> int:
        """Write ``df`` as new shards of at most ``shard_rows`` rows, one or more for each of its partitions; tier 0."""
        base = self.latest()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(folder)
        new = self._listed(self.spark, folder).withColumn("tier", F.lit(0))
        return self._commit(self.manifest(base).unionByName(new) if base else new, base)

    def tier_of(self, size) -> F.Column:
        """Tiers of powers of ``fanout`` below the target; the top tier holds what is at least half the target."""
        top = max(1, math.ceil(math.log(max(2, self.target / (64 << 10)), self.fanout)))
        step = F.floor(F.log(float(self.fanout), F.greatest(size / F.lit(float(64 << 10)), F.lit(1.0)))).cast("int")
        return F.when(size * 2 >= self.target, F.lit(top + 1)).otherwise(F.least(step, F.lit(top)))

    def compact(self) -> int | None:
        """Merge each tier that holds ``fanout`` shards or more; the new version's number, or None if no tier does.

        A tier's shards are read by jobs of at most MOST_PATHS shards, in which Spark's reader packs whole files into partitions of about
        the target size, and each partition (coalesced to the files due) is written as one file: no shuffle, no row looked at
        by the driver, as many tasks as files to write. Old shards stay for readers of older versions until ``vacuum``.
        """
        base = self.latest()
        if not base:
            return None
        with self._against(base):
            return self._merged(base)

    def _merged(self, base: int) -> int | None:
        now = self.manifest(base).withColumn("tier", self.tier_of(F.col("bytes")))
        top = max(1, math.ceil(math.log(max(2, self.target / (64 << 10)), self.fanout))) + 1
        sizes = now.where(F.col("tier") < top).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).orderBy("tier").collect()
        # A merge has to leave half the shards at most, so that every call comes nearer to the end.
        due = [r["tier"] for r in sizes if 2 * max(1, -(-r["bytes"] // self.target)) <= r["n"]]
        if not due:
            return None
        session, made = self._session(), None
        for tier in due:
            batch, size = [], 0
            shards = now.where(F.col("tier") == tier).select("path", "bytes").orderBy("path")
            for r in [*shards.toLocalIterator(), None]:
                if r is not None:
                    batch.append(r["path"])
                    size += r["bytes"]
                if batch and (r is None or len(batch) >= MOST_PATHS):
                    folder = f"{self.root}/data/{uuid.uuid4().hex}"
                    session.read.parquet(*batch).coalesce(max(1, -(-size // self.target))).write.option("compression", "zstd").parquet(folder)
                    new = self._listed(self.spark, folder)
                    made = new if made is None else made.unionAll(new)
                    batch, size = [], 0
        kept = now.where(~F.col("tier").isin(*due)).select("path", "bytes", "rows")
        return self._commit(kept.unionByName(made).withColumn("tier", self.tier_of(F.col("bytes"))), base)

    def _folders(self, shards: DataFrame) -> list[str]:
        """Data folders that shards lie in: one for each append or merge."""
        found = shards.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).distinct()
        return sorted(r["folder"] for r in found.toLocalIterator())

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete data folders that the latest version doesn't name and that were last changed more than ``grace`` seconds ago, and the contents of
        older manifests; how many folders went. An append or merge of another writer that isn't committed yet keeps its folder for that time;
        0 is for a store without other writers or readers."""
        live, gone = set(self._folders(self.manifest())), 0
        before = time.time() - grace
        for status in self.fs.listStatus(self._path(f"{self.root}/data")):
            if status.getPath().getName() not in live and status.getModificationTime() / 1000 <= before:
                self.fs.delete(status.getPath(), True)
                gone += 1
        for version in self.versions()[:-1]:
            for status in self.fs.listStatus(self._path(f"{self.root}/manifest/v{version}")):
                self.fs.delete(status.getPath(), True)
        return gone

    def located(self, version: int | None = None) -> DataFrame:
        """(row, shard) of a version's rows: all own columns in ``row``, and its shard's path, bytes, rows and tier in ``shard``. The folders that the
        version names are read, and rows of shards that are superseded drop out where the shards are joined."""
        shards = self.manifest(version)
        folders = self._folders(shards)
        if not folders:
            raise ValueError("the version has no shard")
        read = self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders])
        rows = read.select(F.struct(*[F.col(f"`{c}`") for c in read.columns]).alias("row"), read.metadataColumn("_metadata")["file_path"].alias("path"))
        return rows.join(shards, "path").select("row", F.struct("path", "bytes", "rows", "tier").alias("shard"))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version. Folders whose shards all belong to it are read as a whole, single shards of the others by their paths, so no row is
        joined with the manifest."""
        shards = self.manifest(version).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
        whole, parts = [], []
        for r in shards.groupBy("folder").agg(F.count("*").alias("n")).orderBy("folder").toLocalIterator():
            there = sum(n.startswith("part-") for n in names(self.spark, f"{self.root}/data/{r['folder']}"))
            (whole if there == r["n"] else parts).append(r["folder"])
        if not whole and not parts:
            raise ValueError("the version has no shard")
        groups = [[f"{self.root}/data/{f}" for f in whole]] if whole else []
        paths = [r["path"] for r in shards.where(F.col("folder").isin(parts)).orderBy("path").toLocalIterator()] if parts else []
        groups += [paths[k : k + MOST_PATHS] for k in range(0, len(paths), MOST_PATHS)]
        both = self.spark.read.parquet(*groups[0])
        for more in groups[1:]:
            both = both.unionByName(self.spark.read.parquet(*more))
        return both


def sharded(documents: DataFrame, root: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, shard, shard_rows, tier, version, n_chars, text_crc32) of each row, read back after appends and compactions.

    Two arrivals (even ids; odd and null ids) are appended, tiers are merged until none is due, and superseded shards
    are removed. Every row lies in exactly one shard; null texts stay null (n_chars and text_crc32 are null), repeated rows
    stay repeated, and columns of any name and type go through the files unchanged. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    store = ShardStore(spark, root, target_bytes)
    even = F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit(False))
    for part in (documents.where(even), documents.where(~even)):
        store.append(part)
    while store.compact():
        store.vacuum(0)  # no one else knows the store
    if store.manifest().isEmpty():
        return spark.createDataFrame([], "doc_id long, shard string, shard_rows long, tier int, version int, n_chars long, text_crc32 long")
    text, shard = F.col("row.text"), F.col("shard")
    return store.located().select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.element_at(F.split(shard["path"], "/"), -1).alias("shard"), shard["rows"].alias("shard_rows"), shard["tier"].alias("tier"),
        F.lit(store.latest()).alias("version"), F.length(text).cast("long").alias("n_chars"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )

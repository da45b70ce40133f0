"""Line dedup: levelled sorted runs of line hashes, compacted periodically; each new batch merge-anti-joins the runs and adds its own."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import names, publish
from .common import chunks, cut, drop_path, new_path, spread_join

#: A line found in so many documents goes everywhere; a key of fewer code points never does.
LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Arrivals that a whole table is taken in as.
ARRIVALS = 4
SPACE = " \t\n\x0b\x0c\r"
_RUN = re.compile(r"run=(\d+)-(\d+)-(\d+)$")
#: Level, first and last batch.
Run = tuple[int, int, int]


def _name(run: Run) -> str:
    return "-".join(map(str, run))


class LineRuns:
    """How many documents hold each line, as sorted runs of (h1, h2, n) under ``root``.

    Every batch adds a run of level 0. ``fanout`` runs of a level are merged into one of the next, so there are about
    ``fanout`` runs for each level and each count is rewritten once a level. All runs are bucketed and sorted by the hash in the
    same way, so that batches merge-join them, and runs are merged, without moving a run's rows.

    A run is named after its level and the batches it covers and gets its name by one rename: it is there as a whole or not at all. A run within
    another's batches counts no more and is deleted by the next ``add``, so readers have until then. Adding a batch again changes nothing. One
    writer at a time; a second one that adds the same batch loses and does no harm.
    """

    def __init__(self, spark: SparkSession, root: str, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least, fanout
        known = [n for n in names(spark, root) if re.fullmatch(r"buckets-\d+", n)]
        # Fixed by the first writer; by default as many as a shuffle has partitions, so that a batch's aggregate lies as the runs do.
        name = known[0] if known else f"buckets-{buckets or int(spark.conf.get('spark.sql.shuffle.partitions'))}"
        self.buckets, self.root = int(name.split("-")[1]), f"{root.rstrip('/')}/{name}"
        self.tables: list[str] = []

    def runs(self) -> list[Run]:
        """(level, first batch, last batch) of the runs that count, by batch."""
        known = [tuple(map(int, m.groups())) for n in names(self.spark, self.root) if (m := _RUN.match(n))]
        return sorted((r for r in known if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in known)), key=lambda r: r[1])

    def _read(self, runs: list[Run]) -> DataFrame:
        """(h1, h2, n) of some runs: partitions of one bucketed table, so that a task reads its bucket of them all."""
        name = f"line_runs_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}'"
        )
        self.tables.append(name)
        for run in runs:
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (run = '{_name(run)}') LOCATION '{self.root}/run={_name(run)}'")
        return self.spark.table(name).select("h1", "h2", "n")

    def _write(self, counts: DataFrame, run: Run) -> None:
        name, private = f"line_run_{uuid.uuid4().hex}", f"{self.root}/_{uuid.uuid4().hex}"
        counts.select("h1", "h2", "n").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", private).option("compression", "zstd").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        publish(self.spark, private, f"{self.root}/run={_name(run)}")

    def totals(self, runs: list[Run] | None = None) -> DataFrame:
        """(h1, h2, n) of all runs: an aggregate of each bucket, without an exchange."""
        return self._read(self.runs() if runs is None else runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """(h1, h2, n) of the lines that ``least`` documents or more hold."""
        return self.totals().where(F.col("n") >= self.least)

    def add(self, batch: int, lines: DataFrame) -> None:
        """Take in the lines (h1, h2), one row for each document that holds one, of the batch of that number (1 and on).

        Lines that a single run has ``least`` documents of are settled: a merge anti-join with the runs takes them out of the batch, so the most
        frequent lines aren't written again and again. The others make the batch's run.
        """
        known = self.runs()
        for name in names(self.spark, self.root):
            m = _RUN.match(name)
            if m and tuple(map(int, m.groups())) not in known:
                drop_path(self.spark, f"{self.root}/{name}")
        if any(r[1] <= batch <= r[2] for r in known):
            return
        counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if known:
            settled = self._read(known).where(F.col("n") >= self.least).select("h1", "h2")
            counts = counts.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, (0, batch, batch))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while True:
            of = [r for r in self.runs() if r[0] == level]
            if not of and not any(r[0] > level for r in self.runs()):
                return
            if len(of) >= self.fanout:
                some = of[: self.fanout]
                self._write(self.totals(some), (level + 1, some[0][1], some[-1][2]))
            else:
                level += 1

    def close(self) -> None:
        """Forget the catalog's names of the runs; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Where each text's lines begin, the lines, and their keys: stripped of ASCII white space, A-Z lower-cased."""
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    flat = lines.flatten()
    return np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lines)))]).astype(np.int64), flat, pc.ascii_lower(pc.ascii_trim(flat, SPACE))


def _hashed(keys: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (two longs) of the keys, and which of them are long enough to count."""
    coded = keys.dictionary_encode()
    words = coded.dictionary
    raw = b"".join([xxhash.xxh3_128_digest(x) for x in words.cast(pa.large_binary()).to_pylist()])
    code = np.asarray(coded.indices).astype(np.int64)
    counts = np.asarray(pc.greater_equal(pc.utf8_length(words), least_chars)) if len(words) else np.zeros(0, bool)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)[code], counts[code]


def _lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            ends, _, keys = _split(b.column("text"))
            hashes, counts = _hashed(keys, least_chars)
            owner = np.repeat(np.arange(b.num_rows), np.diff(ends))[counts]
            each = np.unique(np.column_stack([owner, hashes[counts]]), axis=0)
            at = pa.array(each[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("t").take(at), pa.array(each[:, 1]), pa.array(each[:, 2])], ["doc_id", "t", "h1", "h2"])

    return run


def _without(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            ends, lines, keys = _split(b.column("text"))
            n = np.diff(ends)
            gone = np.zeros(len(lines), bool)
            lost = b.column("lost")
            some = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(lost), 0)) > 0)
            if len(some):
                place = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in some])
                hashes, counts = _hashed(keys.take(pa.array(place)), least_chars)
                owner = np.repeat(some, n[some])
                pairs = lost.take(pa.array(some)).flatten()
                theirs = np.column_stack([np.repeat(some, np.asarray(pc.list_value_length(lost))[some].astype(np.int64)), np.asarray(pairs.field("h1")), np.asarray(pairs.field("h2"))])
                kind = [("owner", np.int64), ("h1", np.int64), ("h2", np.int64)]
                of_lines = np.ascontiguousarray(np.column_stack([owner, hashes])).view(kind).ravel()
                gone[place] = np.isin(of_lines, np.ascontiguousarray(theirs.astype(np.int64)).view(kind).ravel()) & counts
            owner = np.repeat(np.arange(len(n)), n)
            kept = np.concatenate([[0], np.cumsum(np.bincount(owner[~gone], minlength=len(n)))]).astype(np.int32)
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), lines.filter(pa.array(~gone))), pa.scalar("\n", pa.large_string()))
            dropped = np.bincount(owner[gone], minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(dropped), left.cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def document_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t, h1, h2): each document's different lines as hashes; ``t`` is a hash of its text."""
    return _texts(documents).mapInArrow(_lines(least_chars), "doc_id long, t long, h1 long, h2 long")


def without_lines(documents: DataFrame, lines: DataFrame, common: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): documents without the lines in ``common`` (h1, h2, n documents), given their ``document_lines``.

    A common line may stand in a third of all documents: see ``spread_join``. Texts are shuffled at most once, by id and hash, to meet what they lose.
    """
    found = spread_join(lines, common, ["h1", "h2"], "n")
    lost = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "lost")
    texts = _texts(documents)
    rows = texts.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left")
    return rows.select("doc_id", "text", "lost").mapInArrow(_without(least_chars), "doc_id long, n_lines long, n_dropped long, kept string")


def without_common_lines(documents: DataFrame, least: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, arrivals: int = ARRIVALS, root: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row: its lines, how many went, and its text without the lines that ``least`` rows or more hold.

    Lines end at \\n. Lines are the same if they are equal without ASCII white space at both ends and with A-Z lower-cased; those of fewer than ``least_chars`` code
    points in that form always stay. The table is taken in as ``arrivals`` batches into the runs under ``root`` (a new work folder, if none is given), which
    see; the result is that of all batches together.

    Null texts count as empty: one empty line. Each row is a document of its own, so a repeated row counts again for its lines, and null ids stay.
    A very long text is one row of one task; its lines are rows of their own in the counts. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    lines = document_lines(documents, least_chars)
    # Arrivals by id and text: the parts of the table that would come one after the other.
    path = new_path(spark, "lines")
    lines.withColumn("arrival", F.pmod(F.xxhash64("doc_id", "t"), F.lit(arrivals)).cast("int")).write.partitionBy("arrival").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, t long, h1 long, h2 long, arrival int").parquet(path)
    runs = LineRuns(spark, root or new_path(spark, "line-runs"), least)
    for k in range(arrivals):
        runs.add(k + 1, lines.where(F.col("arrival") == k).select("h1", "h2"))
    common = cut(runs.common(), "common")
    runs.close()
    return without_lines(documents, lines.drop("arrival"), common, least_chars)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of the rows of ``without_common_lines``."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT row, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {_CHARS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM (SELECT DISTINCT row, key FROM keyed WHERE length(key) >= {LEAST_CHARS}) GROUP BY key HAVING count(*) >= {LEAST_DOCUMENTS}),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""

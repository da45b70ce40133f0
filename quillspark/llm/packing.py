"""Packing of tokenised documents into fixed-size sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut
from .spfhp import pack_histogram
from .tokens import word_bpe

SIZE = 2048
END = 1
ENCODE_BYTES = 12 << 20
ROWS_A_SALT = 50_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in chunks(batches, limit=ENCODE_BYTES):
            ids, offsets = bpe.encode(b.column("text"))
            n = np.diff(offsets) + 1
            many = -(-n // size)
            owner = np.repeat(np.arange(len(n)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * size
            length = np.minimum(size, n[owner] - start)
            crc = np.zeros(len(owner), np.int64)
            low = ids.astype("<u4")
            tail = np.array([end], "<u4").tobytes()
            for k, (d, s, m) in enumerate(zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)):
                last = s + m == n[d]
                crc[k] = zlib.crc32(low[offsets[d] + s : offsets[d] + s + m - last].tobytes() + tail * int(last))
            ids_of = b.column("doc_id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(start), pa.array(length), pa.array(crc), pa.array(n[owner])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def plan_rows(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, how often in each, first offset): the ranks lo to hi - 1 of a length, in turn.

    Bounded by ``size``, whatever the input: at most twice ``size`` patterns of at most sqrt(2 * size) lengths each.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for many, pattern in pack_histogram(counts, size):
        offset = 0
        for length, times in pattern:
            lo = taken.get(length, 0)
            taken[length] = lo + many * times
            rows.append((length, lo, taken[length], sequence, times, offset))
            offset += length * times
        sequence += many
    return rows


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row.

    A document is its ids and then ``end``; it is cut into pieces of ``size`` and a rest. Pieces are counted by length
    (at most ``size`` counts, which alone reach the driver), the histogram is packed shortest pack first, and the
    patterns are joined back by each piece's rank within its length. Ranks are taken within salted parts of a length,
    as many as its rows need, and shifted by the parts before, so a length that a third of all pieces has is never in
    one task. Sequence ids run from 0 without gaps, as do the offsets in each.

    Null or empty texts: one piece, the end alone. Repeated rows are packed each; null ids are kept. A very long text
    gives many pieces. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    pieces = documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(_pieces(tokenizer, size, end), _PIECE)
    pieces = cut(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_rows(counts, size), "length long, lo long, hi long, first long, times long, at long")
    salts = max(16, sum(counts.values()) // ROWS_A_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    parts = cut(parts.select("length", "salt", before.alias("before")), "parts")
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("place", place).join(parts, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo AND rank < hi")
    return placed.selectExpr(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        "first + (rank - lo) DIV times AS sequence_id",
        "at + ((rank - lo) % times) * length AS offset",
    )

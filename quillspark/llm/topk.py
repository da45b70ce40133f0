"""Exact top-k inner products over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import dense, usable

PIVOTS = 32
#: Vectors the pivots are chosen from, and Lloyd steps on them; every vector is then indexed.
PIVOT_SAMPLE = 2000
BLOCK = 2048
#: Annuli of the index at most (besides one a pivot): more vectors make wider ones, so bounds stay a small table. Annuli lie in blocks of about BLOCK rows.
MOST_BLOCKS = 20_000
QUERY_BLOCK = 1024
#: Pairs of query block and annulus that one batch holds, with their queries.
PAIRS = 32


def choose_pivots(x: np.ndarray, pivots: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of ``x`` by Lloyd's steps from spread-out rows; no more than there are distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(pivots, len(x)), replace=False)].astype(float)
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = x[near == k].mean(axis=0)
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :])


def _keyed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = dense(b.column("x"), pivots.shape[1])
            d = np.sqrt(_squares(x, pivots))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), pa.array(np.sqrt((x * x).sum(axis=1)))], ["vec_id", "x", "pivot", "distance", "norm"])

    return run


#: Products of norms up to which double precision gives integer products exactly.
EXACT = 2.0**52


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's ``k`` highest scores, ties to smaller ids, without the row's own id."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    k = min(k, scores.shape[1])
    if not k:
        return np.zeros(0, int), ids[:0], scores.ravel()[:0]
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort([ids[col], -scores[row, col], row])
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], ids[col[keep]], scores[row[keep], col[keep]]


def _best_large(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """As ``_best`` for products that doubles round: those that may be among the highest are worked out in whole numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ x.T
        off = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :] * (2.0**-50 * q.shape[1])
        most, least = scores + off, scores - off
    most[np.isnan(most)], least[np.isnan(least)] = np.inf, -np.inf
    other = ids[None, :] != own[:, None]
    most[~other], least[~other] = -np.inf, -np.inf
    row, found, score = [], [], []
    whole = lambda v: [int(c) for c in v]
    for r in range(len(q)):
        bar = -np.partition(-least[r], min(k, len(ids)) - 1)[min(k, len(ids)) - 1]
        near, mine = np.flatnonzero((most[r] >= bar) & other[r]), whole(q[r])
        exact = sorted((-sum(a * b for a, b in zip(mine, whole(x[c]), strict=True)), int(ids[c])) for c in near)[:k]
        row += [r] * len(exact)
        found += [i for _, i in exact]
        score += [-s for s, _ in exact]
    return row, found, score


def _sortable(score: int) -> str:
    """Text that sorts as whole numbers do."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _visit(k: int, width: int, large: bool):
    """Scores of the queries that visit an annulus, of one query block, against one of its blocks: at most ``k`` rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: np.frombuffer(b.column(name)[r].as_buffer(), np.int64 if "ids" in name else np.float64)  # noqa: B023, E731
                ids, x = get("ids"), get("block").reshape(-1, width)
                qids, q = get("query_ids"), get("queries").reshape(-1, width)
                if large:
                    row, found, exact = _best_large(q, x, ids, qids, k)
                    clip = lambda s, most: max(-most, min(most, s))
                    more = [pa.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], pa.int64()), pa.array([float(clip(s, 10**307)) for s in exact], pa.float64()), pa.array([_sortable(s) for s in exact], pa.string())]
                else:
                    row, found, score = _best(q @ x.T, ids, qids, k)
                    more = [pa.array(score.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(qids[row], pa.int64()), pa.array(found, pa.int64()), *more], ["query_id", "vec_id", "score", "near", "by"][: 2 + len(more)])

    return run


def _packed(names: list[str], width: int):
    """One row of bytes for each group: its ids, vectors and bounds."""

    def run(_, table):
        table = table.combine_chunks()
        x = dense(table.column("x"), width)
        ids = np.asarray(table.column("vec_id"))
        d, norm = np.asarray(table.column("distance")), np.asarray(table.column("norm"))
        values = {
            "block_id": pa.array([table.column("block_id")[0].as_py()], pa.int64()), "pivot": pa.array([table.column("pivot")[0].as_py()], pa.int32()),
            "lo": pa.array([d.min()]), "hi": pa.array([d.max()]), "norm": pa.array([norm.max()]), "least_norm": pa.array([norm.min()]), "rows": pa.array([len(ids)], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "block": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
        }
        return pa.table({n: values[n] for n in names})

    return run


_INDEX = "block_id long, pivot int, lo double, hi double, norm double, rows long, ids binary, block binary"


def _admitted(bounds: dict[str, np.ndarray], pivots: np.ndarray, width: int, start: int, end: int):
    """(block_id, query_block, active, query_ids, queries): for each query block, the annuli that some of its queries visit next, and these queries alone.

    With |q - p| and the block's distances from its pivot p, the triangle inequality bounds |q - x| from below, and so
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 from above. A query's annuli are sorted by that bound; it visits those in
    places ``start`` to ``end`` whose bound reaches its k-th score so far (a null one admits all), and as bounds fall, none after one
    that doesn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, lo, hi, norm, block_ids = (bounds[n] for n in ("pivot", "lo", "hi", "norm", "block_id"))
        for b in batches:
            for r in range(b.num_rows):
                every = np.frombuffer(b.column("queries")[r].as_buffer(), np.float64).reshape(-1, width)
                ids = np.frombuffer(b.column("query_ids")[r].as_buffer(), np.int64)
                least = np.array([-np.inf if v is None else float(v) for v in b.column("least")[r].as_py()])
                active: dict[int, list[int]] = {}
                for s in range(0, len(every), 64):
                    q = every[s : s + 64]
                    with np.errstate(over="ignore", invalid="ignore"):
                        d = np.sqrt(_squares(q, pivots))[:, pivot]
                        apart = np.maximum(0, np.maximum(d - hi, lo - d))
                        own = (q * q).sum(axis=1)[:, None]
                        most = np.fmin((own + norm * norm - apart * apart) / 2, np.sqrt(own) * norm)
                        most += 1e-6 * (1 + np.abs(most))
                    most[np.isnan(most)] = np.inf
                    order = np.argsort(-most, axis=1, kind="stable")[:, start:end]
                    row, place = np.nonzero(np.take_along_axis(most, order, axis=1) >= least[s : s + 64, None])
                    for j, k in zip((row + s).tolist(), order[row, place].tolist(), strict=True):
                        active.setdefault(k, []).append(j)
                at = sorted(active)
                for k in range(0, len(at), PAIRS):
                    some = at[k : k + PAIRS]
                    packed = [pa.array([np.ascontiguousarray(x[active[j]]).tobytes() for j in some], pa.binary()) for x in (ids, every)]
                    yield pa.RecordBatch.from_arrays([pa.array(block_ids[some]), pa.array(np.full(len(some), b.column("query_block")[r].as_py())), pa.array([active[j] for j in some], pa.list_(pa.int32())), *packed], ["block_id", "query_block", "active", "query_ids", "queries"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5, pivots: int = PIVOTS, visits: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact highest inner products of ``vectors`` (vec_id, x array<double>, integers).

    Queries are the rows that the SQL ``is_query`` picks; candidates are all rows but the query's own id; ties go to the
    smaller id. Every vector is keyed by its nearest pivot and its distance from it; a pivot's vectors, sorted by
    distance, form annuli (blocks). A query's annuli are sorted by the bound that the triangle inequality gives for their
    products. It visits the best one, then four times as many in each round; each round raises its k-th score, and it stops where the next
    bound doesn't reach that; so nothing is lost. Pivots come from a bounded sample; the annuli's bounds are the only table sent
    to all (at most MOST_BLOCKS and one a pivot). ``visits`` gets a table (query_block, block_id, active) for each round. A
    round moves the queries that visit an annulus to it, and each annulus once, in blocks of bounded size.

    Products that doubles would round are worked out and compared in whole numbers; a score beyond a long is given as the nearest long.
    Shorter vectors count as ended by zeros. Fewer candidates than ``k``: all of them. An empty table
    or no query gives an empty result. Repeated ids are candidates each (not for their own id's query); of repeated query ids the
    smallest vector is asked.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    count, width, longest = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    if not count:
        return spark.createDataFrame([], result)
    large = not longest <= EXACT
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1 << 30, (1 << 30) * PIVOT_SAMPLE // count + 1)
    sample = vectors.where(draw).select("x").toArrow()
    if not sample.num_rows:
        sample = vectors.limit(1).select("x").toArrow()
    with np.errstate(over="ignore", invalid="ignore"):
        centres = choose_pivots(dense(sample.column("x"), width), min(pivots, max(1, count // BLOCK * 2)))
    centres = centres[np.isfinite(centres).all(axis=1)] if np.isfinite(centres).all(axis=1).any() else np.zeros((1, width))
    keyed = cut(vectors.mapInArrow(_keyed(centres), "vec_id long, x array<double>, pivot int, distance double, norm double"), "keyed")
    rows = max(BLOCK, -(-count // MOST_BLOCKS))
    # Annuli of a pivot: quantiles of its distances; ranges, so that a pivot with most of the rows is split like any other.
    marks = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", [v / 1000 for v in range(1, 1000)], 10_000).alias("q"))
    many = F.ceil(F.col("n") / rows)
    edges = F.expr("array_distinct(transform(filter(sequence(1L, many), j -> j < many AND j * 1000 DIV many >= 1), j -> element_at(q, CAST(j * 1000 DIV many AS int))))")
    marks = cut(marks.withColumn("many", many.cast("long")).select("pivot", edges.alias("e")), "edges")
    placed = keyed.join(F.broadcast(marks), "pivot").withColumn("annulus", F.expr("size(filter(e, v -> v < distance))")).drop("e")  # PIVOTS rows
    # Equal distances fall into one annulus, however many; salts keep its blocks bounded.
    sizes = cut(placed.groupBy("pivot", "annulus").agg(F.ceil(F.count("*") / (2 * rows)).alias("salts")), "sizes")
    salted = placed.join(F.broadcast(sizes), ["pivot", "annulus"])  # at most MOST_BLOCKS rows and one a pivot
    placed = salted.withColumn("block_id", F.col("pivot").cast("long") * (1 << 40) + F.col("annulus").cast("long") * (1 << 20) + F.expr("pmod(xxhash64(vec_id), salts)"))
    # A value of the index holds about BLOCK vectors, whatever the table's size.
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, rows // BLOCK))))
    index = cut(placed.groupBy("block_id", "piece").applyInArrow(_packed([c.split()[0] for c in _INDEX.split(", ")], width), _INDEX), "index")
    bounds = index.groupBy("block_id").agg(F.first("pivot").alias("pivot"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")).orderBy("block_id").toArrow()
    bounds = {n: np.asarray(bounds.column(n)) for n in bounds.column_names}

    asked = cut(vectors.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).mapInArrow(_keyed(centres), "vec_id long, x array<double>, pivot int, distance double, norm double"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block_id", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    queries = cut(asked.groupBy("block_id").applyInArrow(_packed(["block_id", "ids", "block"], width), "block_id long, ids binary, block binary").selectExpr("block_id AS query_block", "ids AS query_ids", "block AS queries"), "queries")
    order = cut(queries.mapInArrow(_listed, "query_block long, query_id long, place int"), "order")
    found_row, pair_row = "query_id long, vec_id long, score long" + ", near double, by string" * large, "block_id long, query_block long, active array<int>, query_ids binary, queries binary"
    by_query = Window.partitionBy("query_id").orderBy(F.desc("by" if large else "score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    found = spark.createDataFrame([], found_row + ", rank int")
    start, end = 0, 1
    while start < len(bounds["block_id"]):
        kth = found.where(F.col("rank") == k).selectExpr("query_id", f"{'near' if large else 'score'} AS least")
        least = order.join(kth, "query_id", "left").groupBy("query_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda v: v["least"].cast("double")).alias("least"))
        pairs = cut(queries.join(least, "query_block").mapInArrow(_admitted(bounds, centres, width, start, end), pair_row), "pairs")
        if pairs.isEmpty():
            break
        if visits is not None:
            visits.append(pairs)
        seen = pairs.drop("active").join(index.select("block_id", "ids", "block"), "block_id").mapInArrow(_visit(k, width, large), found_row)
        found = cut(ranked(found.drop("rank").unionAll(seen)), "found")
        start, end = end, end + 4 * (end - start)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            ids = np.frombuffer(b.column("query_ids")[r].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column("query_block")[r].as_py())), pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int32))], ["query_block", "query_id", "place"])


def _whole(x: Column) -> Column:
    """floor(256 * x) as a double; from 2^52 on a double is whole."""
    wide = x * 256.0
    return F.when(F.abs(wide) < EXACT, F.floor(wide).cast("double")).otherwise(wide)


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top ``k`` of each row whose vec_id is divisible by ``every``, over components floor(256 * x); see ``top_k``.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do those with a component whose 256-fold isn't
    finite. Columns but vec_id and embedding are ignored.
    """
    whole = usable(embeddings).select("vec_id", F.transform("v", _whole).alias("x")).where(F.forall("x", lambda x: F.abs(x) < float("inf")))
    return top_k(cut(whole, "whole"), f"vec_id % {every} = 0", k)


SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

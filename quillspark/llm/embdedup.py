"""Near-duplicate vectors by randomly rotated binary codes with correction factors, and exact cosines where these can't decide."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, cut, mix
from .grouping import joining, linked, shared_buckets
from .vectors import dense, usable

#: Rotations whose codes and factors are stored for estimates, and the confidence bound's width in standard errors.
ESTIMATES = 4
SURE = 5.0
#: Chance to miss a pair that lies exactly on the threshold; closer pairs are missed far more rarely.
MISS = 1e-4
BLOCK = 1024


def rotations(width: int, count: int, seed: int = 17) -> np.ndarray:
    """``count`` random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def same_chance(width: int, least: float, draws: int = 20_000, seed: int = 23) -> float:
    """Chance that a random rotation gives two unit vectors of cosine ``least`` the same signed largest coordinate: measured on random
    pairs, less two standard errors."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, draws, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    share = (largest(x) == largest(least * x + math.sqrt(1 - least * least) * z)).mean()
    return max(1e-3, share - 2 * math.sqrt(share * (1 - share) / draws))


def largest(y: np.ndarray) -> np.ndarray:
    """Place and sign of each row's largest coordinate: 2 * width values."""
    at = np.abs(y).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], axis=-1)[..., 0] >= 0)


def table_shape(rows: int, width: int, least: float, miss: float = MISS) -> tuple[int, int, int]:
    """Largest coordinates and signs in a key, and the number of tables: buckets of unlike vectors hold a fraction of a row; a pair at the
    threshold is missed with chance ``miss``. A largest coordinate parts rows like log2(2 * width) signs, but close pairs less."""
    bits, each = max(10, math.ceil(math.log2(max(2, rows))) + 2), math.log2(2 * width)
    whole = int(bits // each) if width >= 4 else 0
    signs = max(0, math.ceil(bits - whole * each))
    same = (same_chance(width, least) ** whole if whole else 1.0) * (1 - math.acos(least) / math.pi) ** signs
    return whole, signs, math.ceil(math.log(miss) / math.log1p(-same))


class Tables:
    """The rotations of the codes and of the tables, made from seeds wherever they are needed."""

    def __init__(self, rows: int, width: int, least: float):
        self.width = width
        self.whole, self.signs, self.tables = table_shape(rows, width, least)

    def turns(self) -> np.ndarray:
        return rotations(self.width, ESTIMATES)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The keys of the tables: signed largest coordinates of ``whole`` rotations each, and signs of further rotated coordinates."""
        x, key = unit.astype(np.float32), np.zeros((len(unit), self.tables), np.uint64)
        if self.whole:
            turns = _turns(self.width, self.whole * self.tables, 18)
            for t in range(self.tables):
                for turn in turns[t * self.whole : (t + 1) * self.whole]:
                    key[:, t] = key[:, t] * np.uint64(2 * self.width) + largest(x @ turn).astype(np.uint64)
        if self.signs:
            some = np.concatenate(_turns(self.width, -(-self.signs * self.tables // self.width), 19), axis=1)[:, : self.signs * self.tables]
            flat = ((x @ some) >= 0).reshape(len(unit), self.tables, self.signs)
            for k in range(self.signs):
                key = key * np.uint64(2) + flat[:, :, k]
        return mix(key ^ mix(np.arange(1, self.tables + 1, dtype=np.uint64))[None, :]).view(np.int64)


@functools.lru_cache(maxsize=4)
def _turns(width: int, count: int, seed: int) -> np.ndarray:
    return rotations(width, count, seed).astype(np.float32)


def encode(unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs of the rotations) and their correction factors <code, vector>."""
    rotated = [unit @ turn for turn in turns]
    return np.concatenate([np.packbits(y >= 0, axis=1) for y in rotated], axis=1), np.array([np.abs(y).sum(axis=1) / math.sqrt(unit.shape[1]) for y in rotated]).T


def estimate(codes: np.ndarray, factors: np.ndarray, other: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <vector, other> from the vectors' codes, and the half-width of their confidence bound, by row.

    With c the unit code of o, <c, q> / <c, o> estimates <o, q>; its error has a standard deviation of about
    sqrt((1 - <c, o>^2) / <c, o>^2 / (width - 1)). The estimates of several rotations are averaged.
    """
    width = other.shape[1]
    each = codes.shape[1] // ESTIMATES
    total, variance = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(ESTIMATES):
        c = np.unpackbits(codes[:, k * each : (k + 1) * each], axis=1, count=width) * 2.0 - 1
        f = factors[:, k]
        total += ((other @ turns[k]) * c).sum(axis=1) / math.sqrt(width) / f
        variance += np.maximum(0, 1 - f * f) / (f * f) / max(1, width - 1)
    return total / ESTIMATES, SURE * np.sqrt(variance) / ESTIMATES + 1e-9


def estimates(codes: np.ndarray, factors: np.ndarray, others: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``estimate``, of every vector (column) with each of ``others`` (row), which are rotated once; bounds by column."""
    width = others.shape[1]
    each = codes.shape[1] // ESTIMATES
    total, variance = np.zeros((len(others), len(codes))), np.zeros(len(codes))
    for k in range(ESTIMATES):
        c = np.unpackbits(codes[:, k * each : (k + 1) * each], axis=1, count=width) * 2.0 - 1
        f = factors[:, k]
        total += ((others @ turns[k]) @ c.T) / (math.sqrt(width) * f)
        variance += np.maximum(0, 1 - f * f) / (f * f) / max(1, width - 1)
    return total / ESTIMATES, SURE * np.sqrt(variance) / ESTIMATES + 1e-9


def _units(lists: pa.Array, width: int) -> np.ndarray:
    x = dense(lists, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


_CODED = "vec_id long, v array<double>, class string, code binary, factors array<double>, keys array<long>"


def _coded(width: int, tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = tables.turns()
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                b = whole.slice(s, 2048)
                x = dense(b.column("v"), width) + 0.0
                unit = _units(b.column("v"), width)
                code, factor = encode(unit, turns)
                key = tables.keys(unit)
                rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), rows(unit), pa.array([xxhash.xxh3_128_hexdigest(r.tobytes()) for r in x]), binary_rows([r.tobytes() for r in code]), rows(factor), rows(key)], ["vec_id", "v", "class", "code", "factors", "keys"])

    return run


def _estimated(width: int, turns: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            guess, sure = estimate(code, dense(b.column("factors"), ESTIMATES), dense(b.column("v"), width), turns)
            yield b.select(["a", "b"]).filter(pa.array(guess + sure >= least))

    return run


def _exact(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array((dense(b.column("va"), width) * dense(b.column("vb"), width)).sum(axis=1) >= least))

    return run


def _blocks(width: int, turns: np.ndarray, least: float):
    """Links between groups within dealt blocks; pairs that the codes' bounds rule out are not recomputed."""

    def run(_, table):
        table = table.combine_chunks()
        probe = np.asarray(table.column("probe"))
        x, y = np.flatnonzero(probe), np.flatnonzero(~probe)
        ids, group = np.asarray(table.column("id")), np.asarray(table.column("c"))
        major = table.column("major")[0].as_py()
        v = dense(table.column("v"), width)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        factors = dense(table.column("factors"), ESTIMATES)
        open_ = (group[x][:, None] != group[y][None, :]) & ((group[y] == major)[None, :] | (ids[x][:, None] < ids[y][None, :]))
        guess, sure = estimates(code[y], factors[y], v[x], turns)
        p, r = np.nonzero(open_ & (guess + sure[None, :] >= least))
        p, r = x[p], y[r]
        near = np.concatenate([np.einsum("ij,ij->i", v[p[s : s + 65536]], v[r[s : s + 65536]]) for s in range(0, len(p), 65536)] or [np.zeros(0)]) >= least
        p, r = p[near], r[near]
        one = np.unique(np.stack([p, group[r]]), axis=1, return_index=True)[1] if len(p) else []
        found = [(int(p[k]), int(r[k])) for k in sorted(one)]
        good = joining(found, [int(group[p]) for p, _ in found], [int(group[r]) for _, r in found], lambda _: True)
        return pa.table({"a": pa.array([int(ids[found[k][0]]) for k in good], pa.int64()), "b": pa.array([int(ids[found[k][1]]) for k in good], pa.int64())})

    return run


def _counted(width: int, least: float):
    """Links of each id within its component's block (or, of two blocks, with the other's ids), by multiplicity."""

    def run(_, table):
        table = table.combine_chunks()
        ids, comp, many, side = (np.asarray(table.column(n)) for n in ("id", "component", "many", "side"))
        v = dense(table.column("v"), width)
        order = np.argsort(comp, kind="stable")
        ids, comp, many, side, v = ids[order], comp[order], many[order], side[order], v[order]
        links = np.zeros(len(ids), np.int64)
        starts = np.concatenate([np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])), [len(comp)]])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            a, b = s + np.flatnonzero(side[s:e] != 2), s + np.flatnonzero(side[s:e] != 1)
            near = v[a] @ v[b].T >= least
            near &= ids[a][:, None] != ids[b][None, :]
            np.add.at(links, a, near.astype(np.int64) @ many[b])
            if (side[s:e] == 2).any():
                np.add.at(links, b, near.T.astype(np.int64) @ many[a])
        return pa.table({"id": ids, "links": links})

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding; others are ignored).

    Rows with equal vectors are one class, and only its smallest id goes on. Signs of randomly rotated vectors are the
    codes; with their stored factors they give unbiased estimates of the inner product. Candidates share a key of hash tables (as many as
    ``table_shape`` says for the threshold) of signed largest coordinates and signs of further rotations. A candidate pair is recomputed in
    double precision only where the estimate's confidence bound reaches the threshold, and links only if the
    cosine itself does. Ids then form components, and within each, in blocks, every id's links are counted exactly.

    Vectors that are null, empty or zero, or hold null or non-finite components: 0 links, kept. Shorter vectors count as
    ended by zeros. A null vec_id: null component, kept. Repeated rows are copies of each other (one id's rows with
    different vectors count as one vertex). An empty table gives an empty result.
    """
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    able = cut(usable(embeddings).where("exists(v, x -> x <> 0)"), "able")
    count, width = able.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = F.col("vec_id").alias("component_id")
    if not count:
        return whole.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    tables = Tables(count, width, least)
    first = tables.turns()
    coded = cut(able.mapInArrow(_coded(width, tables), _CODED), "coded")
    classes = cut(coded.groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "classes")
    reps = cut(coded.join(classes.selectExpr("class", "id AS vec_id", "many"), ["class", "vec_id"]).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "id"), "reps")
    buckets = shared_buckets(reps.select(F.explode("keys").alias("key"), "id", F.lit(1).alias("size")))

    def verify(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(reps.selectExpr("id AS a", "code", "factors"), "a").join(reps.selectExpr("id AS b", "v"), "b")
        likely = cut(with_a.mapInArrow(_estimated(width, first, least), "a long, b long"), "likely")
        return likely.join(reps.selectExpr("id AS a", "v AS va"), "a").join(reps.selectExpr("id AS b", "v AS vb"), "b").mapInArrow(_exact(width, least), "a long, b long")

    def in_blocks(blocks: DataFrame) -> DataFrame:
        return blocks.join(reps.select("id", "v", "code", "factors"), "id").groupBy("key", "i", "j").applyInArrow(_blocks(width, first, least), "a long, b long")

    grouped = linked(buckets, verify, in_blocks)
    # Small components share groups of about BLOCK rows; a large one is cut into blocks, each of which meets every other.
    sizes = cut(grouped.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    bins = max(1, sizes.where(F.col("n") <= BLOCK).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK)
    member = grouped.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = member.withColumn("block", F.expr("CAST(pmod(xxhash64(id), blocks) AS int)"))
    small = member.where("blocks = 1").selectExpr("id", "component", f"CAST(pmod(xxhash64(component), {bins}) AS long) AS g", "0 AS i", "0 AS j", "0 AS side")
    large = member.where("blocks > 1").select("id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    large = large.selectExpr("id", "component", "component AS g", "least(block, o) AS i", "greatest(block, o) AS j", "CASE WHEN block = o THEN 0 WHEN block < o THEN 1 ELSE 2 END AS side")
    tagged = cut(small.selectExpr("*", "0 AS kind").unionAll(large.selectExpr("*", "1 AS kind")), "tagged")
    dealt = tagged.join(reps.select("id", "v", "many"), "id")
    links = dealt.groupBy("kind", "g", "i", "j").applyInArrow(_counted(width, least), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(grouped, "id", "left").join(links, "id", "left")
    named = cut(named.select("class", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")), "named")
    out = coded.select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    rest = whole.join(coded.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), alone)
    own = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return out.unionAll(rest).select("vec_id", "n_links", "component_id", own.alias("kept"))


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
, counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN found f ON f.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary_rows, chunks, cut, hash_strings, mix
from .grouping import joining, linked, only_ids, shared_buckets

SHINGLE = 5
SLOTS = 128
ROWS = 4
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and each text's offsets.

    A text of fewer than ``size`` words has one shingle, the whole sequence; one without words has none.
    """
    words = Words(texts)
    h = hash_strings(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = np.diff(words.offsets)
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size if len(full) else 0):
        full += h[k : k + len(full)] * _MULTIPLIERS[k]
    full = mix(full)
    sets = []
    for k, count in enumerate(n):
        s = words.offsets[k]
        if count >= size:
            sets.append(np.unique(full[s : s + count - size + 1]))
        elif count:
            sets.append(mix((h[s : s + count] * _MULTIPLIERS[:count]).sum(keepdims=True) + np.full(1, count, np.uint64) * _MULTIPLIERS[size]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def superminhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (one row of ``slots`` values for each set).

    Every element walks a random permutation of the slots (Fisher-Yates, drawn from its hash) and offers slot number
    ``j`` of its walk the value j + r, 0 <= r < 1. A set stops after step j once all its slots lie below j + 1.
    The permutation is kept as the list of its swaps, so the usual two or three steps need no array of ``slots``.
    """
    n = len(offsets) - 1
    h = np.full(n * slots, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    to: list[np.ndarray] = []
    put: list[np.ndarray] = []

    def at(place: np.ndarray) -> np.ndarray:
        value = place.copy()
        for k, q in zip(to, put, strict=True):
            np.copyto(value, q, where=k == place)
        return value

    for j in range(slots):
        if not len(elements):
            break
        u = mix(elements + np.full(1, j + 1, np.uint64) * _STEP)
        r = (u >> np.uint64(32)).astype(np.float64) * 2.0**-32
        k = (j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot, moved = at(k), at(np.full(len(k), j, np.int16))
        to.append(k)
        put.append(moved)
        np.minimum.at(h, owner * slots + slot, j + r)
        open_ = h.reshape(n, slots).max(axis=1) >= j + 1
        keep = open_[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            to, put = [x[keep] for x in to], [x[keep] for x in put]
    return h.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` slots, different for each band."""
    bits = mix(np.ascontiguousarray(signatures).view(np.uint64))
    n, slots = bits.shape
    bands = bits.reshape(n, slots // rows, rows)
    key = np.full(bands.shape[:2], 0, np.uint64) + np.arange(slots // rows, dtype=np.uint64) * _STEP
    for k in range(rows):
        key = mix(key + bands[:, :, k] * _MULTIPLIERS[k])
    return key.view(np.int64)


def _blocks(percent: int, slack: float):
    """Links between groups within dealt blocks: pairs by the first band they share, likely ones first, on full sets."""

    def run(_, table):
        table = table.combine_chunks()
        probe = np.asarray(table.column("probe"))
        x, y = np.flatnonzero(probe), np.flatnonzero(~probe)
        ids, group, n = (np.asarray(table.column(c)) for c in ("id", "c", "n"))
        major, key = table.column("major")[0].as_py(), table.column("key")[0].as_py()
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = table.column("elements")
        kx, ky = keys[x], keys[y]
        open_ = (group[x][:, None] != group[y][None, :]) & ((group[y] == major)[None, :] | (ids[x][:, None] < ids[y][None, :]))
        small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
        open_ &= 100 * small >= percent * large
        band = int(np.flatnonzero(keys[x[0]] == key)[0]) if len(x) else 0
        for k in range(band):
            open_ &= kx[:, k, None] != ky[None, :, k]
        same = np.zeros(open_.shape, np.uint16)
        for k in range(sketch.shape[1]):
            same += sketch[x][:, k, None] == sketch[y][None, :, k]
        open_ &= same >= (percent / 100 - slack) * sketch.shape[1]
        pairs = np.argwhere(open_)
        pairs = pairs[np.argsort(-same[open_].astype(int), kind="stable")]
        held: dict[int, np.ndarray] = {}

        def elements(k: int) -> np.ndarray:
            if k not in held:
                held[k] = np.frombuffer(sets[k].as_py(), np.uint64)
            return held[k]

        def links(pair) -> bool:
            p, q = elements(int(x[pair[0]])), elements(int(y[pair[1]]))
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            return 100 * shared >= percent * (len(p) + len(q) - shared)

        a, b = x[pairs[:, 0]], y[pairs[:, 1]]
        good = joining(pairs, group[a].tolist(), group[b].tolist(), links)
        return pa.table({"a": ids[a[good]], "b": ids[b[good]]})

    return run


_SIGNED = "doc_id long, n_shingles long, class string, sketch binary, keys array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        elements, offsets = shingle_sets(b.column("text"))
        signatures = superminhash(elements, offsets)
        n = np.diff(offsets)
        keys = band_keys(signatures)
        sketch = (mix(signatures.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
        classes = [xxhash.xxh3_128_hexdigest(elements[offsets[k] : offsets[k + 1]].tobytes()) if n[k] else None for k in range(len(n))]
        bands = keys.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(classes, pa.string()), binary_rows([x.tobytes() for x in sketch]), lists], ["doc_id", "n_shingles", "class", "sketch", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        elements, offsets = shingle_sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary_rows([elements[offsets[k] : offsets[k + 1]].tobytes() for k in range(b.num_rows)])], ["id", "elements"])


def _alike(least: float, slack: float):
    """Pairs whose set sizes allow the similarity and whose sketches agree in nearly as many slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = np.asarray(b.column("na")), np.asarray(b.column("nb"))
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            good = (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9) & ((x == y).mean(axis=1) >= least - slack)
            yield b.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("ea"), b.column("eb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(documents: DataFrame, percent: int = 75, slack: float = 0.25) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents`` (doc_id, text; others are ignored).

    Sets: distinct shingles of five words over whole texts. Rows with equal sets are one class, and only its smallest
    doc_id goes on; classes that share a band are compared with the band's smallest id and, where that leaves groups
    apart, with each other; a link is confirmed on full sets rebuilt from the texts. ``slack``: how far below the
    threshold the share of equal slots may lie (over six standard deviations of a signature of 128 slots).

    Null or empty texts and texts without words: an empty set, linked with nothing, kept. A null doc_id takes no part:
    component_id is null and the row is kept. Repeated rows are returned each; they are copies of each other. An empty
    table gives an empty result.
    """
    docs = documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    signed = cut(docs.mapInArrow(_signed, _SIGNED), "signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(able.groupBy("class").agg(F.min("doc_id").alias("id")), "reps")
    sketches = cut(able.join(reps.selectExpr("id AS doc_id", "class"), ["doc_id", "class"], "left_semi").selectExpr("doc_id AS id", "n_shingles AS n", "sketch", "keys"), "sketches")
    buckets = shared_buckets(sketches.select(F.explode("keys").alias("key"), "id", F.col("n").cast("int").alias("size")))
    plain = sketches.select("id", "n", "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = plain.selectExpr("id AS a", "n AS na", "sketch AS sa"), plain.selectExpr("id AS b", "n AS nb", "sketch AS sb")
        likely = cut(pairs.join(right, "b").join(left, "a").mapInArrow(_alike(percent / 100, slack), "a long, b long"), "likely")
        wanted = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        sets = cut(only_ids(docs, wanted, "doc_id").mapInArrow(_sets, "id long, elements binary"), "sets")
        return likely.join(sets.selectExpr("id AS b", "elements AS eb"), "b").join(sets.selectExpr("id AS a", "elements AS ea"), "a").mapInArrow(_confirmed(percent), "a long, b long").distinct()

    def in_blocks(blocks: DataFrame) -> DataFrame:
        wanted = cut(blocks.select("id").distinct(), "wanted")
        sets = only_ids(docs, wanted, "doc_id").mapInArrow(_sets, "id long, elements binary")
        held = cut(sketches.join(sets, "id"), "held")
        return blocks.join(held, "id").groupBy("key", "i", "j").applyInArrow(_blocks(percent, slack), "a long, b long")

    grouped = linked(buckets, verify, in_blocks, f"100 * least(p, q) >= {percent} * greatest(p, q)")
    named = cut(reps.join(grouped, "id", "left").select("class", F.coalesce("component", "id").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared) UNION ALL SELECT b, a FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN found ON a = doc_id
"""

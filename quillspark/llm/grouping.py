"""Groups from links, and candidate pairs from bucket rows, without expanding a bucket into all its pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Ids (some 16 bytes each in a hash table) up to which a side is broadcast.
BROADCAST_IDS = 1_000_000
#: Ids of a bucket up to which its open pairs are rows.
SMALL = 24


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long): the smallest id that it reaches.

    Parent pointers are hooked to the smallest grandparent seen over any link and then shortened, until none
    changes; every round is written to the shared folder. No links give an empty result.
    """
    links = cut(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    both = links.selectExpr("a AS u", "b AS v").unionAll(links.selectExpr("b AS u", "a AS v"))
    label = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "labels")
    before = None
    while True:
        total = label.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return label.selectExpr("u AS id", "p AS component")
        before = total
        of_v, of_u = label.selectExpr("u AS v", "p AS pv"), label.selectExpr("u AS u", "p AS pu")
        seen = both.join(of_v, "v").join(of_u, "u")
        seen = seen.select(F.explode(F.array(F.struct("u", F.col("pv").alias("p")), F.struct(F.col("pu").alias("u"), F.col("pv").alias("p")))).alias("x")).select("x.*")
        short = label.alias("l").join(label.selectExpr("u AS p", "p AS pp"), "p").selectExpr("u", "pp AS p")
        label = cut(seen.unionAll(short).unionAll(label).groupBy("u").agg(F.min("p").alias("p")), "labels")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, size) of the buckets that two or more ids share, with their pivot: the bucket's smallest id."""
    pivots = cut(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot <> other").select("key", "pivot"), "pivots")
    return cut(rows.join(pivots, "key"), "buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b): each id against its buckets' pivots; as many rows as bucket rows at most."""
    return buckets.where("id <> pivot").selectExpr("pivot AS a", "id AS b").distinct()


class Open:
    """What a grouping leaves open: the buckets with members of several groups."""

    def __init__(self, buckets: DataFrame, grouped: DataFrame):
        named = buckets.join(grouped.selectExpr("id", "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        each = named.groupBy("key", "c").agg(F.count("*").alias("n"))
        mixed = each.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.count("*").alias("groups"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
        mixed = cut(mixed.where("groups > 1"), "mixed")
        #: Pairs of one bucket and two groups, over all buckets.
        self.pairs = int(mixed.agg(F.sum(F.expr("CAST((all * all - same) DIV 2 AS decimal(38,0))"))).first()[0] or 0)
        columns = ["key", "id", "size", "pivot", "c"]
        self.named = cut(named.select(*columns).join(mixed.select("key", "major", "all"), "key"), "named") if self.pairs else None

    def again(self, grouped: DataFrame) -> Open:
        """What later groups leave open: only the buckets that are still open, since groups only grow."""
        return Open(self.named.select("key", "id", "size", "pivot"), grouped)

    def drawn(self, turn: int) -> DataFrame:
        """Distinct (a, b): each id outside its bucket's largest group against one member of that group, drawn anew each turn."""
        pivot = self.named.where("c = major").groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("drawn"))
        pairs = self.named.where("c <> major").select("key", "id").join(cut(pivot, "drawn"), "key")
        return pairs.selectExpr("least(id, drawn) AS a", "greatest(id, drawn) AS b").distinct()

    def small(self, fits: str) -> DataFrame:
        """Distinct (a, b): the open pairs of buckets of at most SMALL ids, so fewer rows than SMALL times the ids."""
        few = self.named.where(F.col("all") <= SMALL)
        probes = few.where("c <> major").selectExpr("key", "id AS x", "c AS cx", "size AS p")
        others = few.selectExpr("key", "id AS y", "c AS cy", "size AS q", "major", "pivot")
        pairs = probes.join(others, "key").where(f"cx <> cy AND (cy = major OR x < y) AND x <> pivot AND y <> pivot AND ({fits})")
        return pairs.selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct()

    def blocks(self, rows: int = 1024, weight: int = 1 << 21) -> DataFrame:
        """(key, i, j, probe, id, c, major): larger buckets cut into blocks of bounded rows and summed size; the probes'
        block i meets block j of all the bucket's ids. Rows, not pairs: each id once for every block it meets."""
        many = self.named.where(F.col("all") > SMALL)
        count = lambda which: F.greatest(F.ceil(F.count_if(which) / rows), F.ceil(F.sum(F.when(which, F.col("size").cast("long")).otherwise(0)) / weight)).cast("int")
        cut_in = cut(many.groupBy("key").agg(count(F.expr("c <> major")).alias("ni"), count(F.lit(True)).alias("nj")), "cuts")
        dealt = many.join(cut_in, "key").withColumn("h", F.xxhash64("id"))
        probes = dealt.where("c <> major").selectExpr("key", "CAST(pmod(h, ni) AS int) AS i", "explode(sequence(0, nj - 1)) AS j", "true AS probe", "id", "c", "major")
        others = dealt.selectExpr("key", "explode(sequence(0, ni - 1)) AS i", "CAST(pmod(h, nj) AS int) AS j", "false AS probe", "id", "c", "major")
        return cut(probes.unionAll(others), "blocks")


def joining(pairs, of_a, of_b, test) -> list[int]:
    """Indices of the ``pairs`` (in order) that pass ``test`` and join two groups that those before leave apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for k in range(len(pairs)):
        x, y = root(of_a[k]), root(of_b[k])
        if x != y and test(pairs[k]):
            parent[x] = y
            found.append(k)
    return found


def only_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids`` (id), which must be a written table: broadcast after a count, else a shuffled join."""
    ids = ids.withColumnRenamed("id", column)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, "left_semi")


def linked(buckets: DataFrame, verify, in_blocks, fits: str = "true", turns: int = 8, few: int = 20_000) -> DataFrame:
    """(id, component) of buckets (key, id, size, pivot).

    ``verify(pairs)`` gives the pairs (a, b) that link; ``in_blocks(blocks)`` gives links (a, b) that join what
    ``Open.blocks`` deals; ``fits`` is SQL over the sizes p and q that a linking pair fulfils.

    First every id is compared with its buckets' pivots. Where that leaves a bucket in several groups, its outsiders are
    compared with one drawn member of its largest group, in turns, for as long as each turn takes away a fifth of
    the open pairs: in a large group of copies most are linked after a few turns, at one row an outsider. What is then
    open is compared whole: in small buckets pair by pair, in large ones block against block, where only the links that
    join two groups come out. No link between groups is missed.
    """
    grouped = components(verify(star_pairs(buckets)).select("a", "b"))
    left = Open(buckets, grouped)
    joined = lambda more: components(grouped.selectExpr("id AS a", "component AS b").unionAll(more.select("a", "b")))
    for turn in range(turns):
        if left.pairs <= few:
            break
        before = left.pairs
        grouped = joined(verify(left.drawn(turn)))
        left = left.again(grouped)
        if left.pairs > 0.8 * before:
            break
    if not left.pairs:
        return grouped
    return joined(verify(left.small(fits)).select("a", "b").unionAll(in_blocks(left.blocks()).select("a", "b")))

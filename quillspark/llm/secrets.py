"""Secret scans with an incremental ledger: content-addressed blobs, each scanned once for each version of the rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, hadoop_path, new_path, quoted

# The base kinds in their order, then the kinds that this operator adds.
BASE = ("assign", "access", "hex")
ADDED = ("key", "jwt", "github", "slack", "google")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = {
    "key": ("-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{20,}")),
    "google": ("AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
}
SPANS = "array<struct<kind:string,start:int,end:int>>"
MASK = "[SECRET]"
#: Spans (some 40 bytes each) up to which findings are broadcast; and digests of blobs (some 80 bytes each).
BROADCAST_SPANS = 500_000
BROADCAST_BLOBS = 200_000


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, (sign, rule) in _MORE.items():
        if sign in text:
            spans += [(kind, *m.span()) for m in rule.finditer(text)]
    order = {kind: k for k, kind in enumerate(BASE + ADDED)}
    return sorted(spans, key=lambda x: (x[1], order[x[0]]))


@dataclass(frozen=True)
class Rules:
    """A version of the rules; a new version makes all blobs unseen again."""

    version: str = "3"
    scan: object = field(default=find)


def _scanner(rules: Rules):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in rules.scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "spans"])

    return run


def scan_history(versions: DataFrame, path: str, ledger: str | None = None, rules: Rules | None = None) -> DataFrame:
    """(path, blob, spans) for each row of ``versions`` (``path``, text): findings of all historical versions.

    A blob is the SHA-256 of a text's bytes. The ledger, a table in the shared folder or a store, holds (blob,
    rule_version, spans); only blobs that it lacks for this version of the rules are scanned, one copy of each, then
    appended, and its findings are joined back to every path. To scan one copy of each blob without moving texts, the
    rows to leave out (or, if fewer, those to scan) are joined by id: broadcast after a count, else shuffled.

    Null texts count as empty, and have no span; texts are scanned whole, however long. Null paths and repeated rows are
    returned each. An empty table gives an empty result; other columns are ignored.
    """
    spark = versions.sparkSession
    rules = rules or Rules()
    ledger = ledger or new_path(spark, "ledger")
    rows = versions.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    addressed = cut(rows.select("path", "blob"), "addressed")
    first = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    at, store = hadoop_path(spark, ledger)
    if store.exists(at):
        known = spark.read.parquet(ledger).where(F.col("rule_version") == rules.version)
        first = first.join(known.select("blob"), "blob", "left_anti")
    unseen = cut(first, "unseen")
    copies = cut(addressed.alias("v").join(unseen.alias("u"), F.expr("v.blob = u.blob AND v.path <=> u.path"), "left_anti"), "copies")
    many, few = copies.count(), unseen.count()
    side, how = (copies, "left_anti") if many <= few else (unseen, "left_semi")
    if min(many, few) <= BROADCAST_BLOBS:
        side = F.broadcast(side)
    todo = rows.alias("v").join(side.alias("s"), F.expr("v.blob = s.blob AND v.path <=> s.path"), how)
    # A row that is repeated with its path is read as often; the ledger gets its blob once.
    found = todo.select("blob", "text").mapInArrow(_scanner(rules), f"blob string, spans {SPANS}").dropDuplicates(["blob"])
    found.withColumn("rule_version", F.lit(rules.version)).write.mode("append").option("compression", "zstd").parquet(ledger)
    # Only blobs with findings travel; a version of a blob that was written twice is the same row.
    hits = spark.read.parquet(ledger).where((F.col("rule_version") == rules.version) & (F.size("spans") > 0)).select("blob", "spans")
    hits = cut(hits.groupBy("blob").agg(F.max("spans").alias("spans")), "hits")
    out = addressed.join(hits, "blob", "left")
    return out.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.from_json(F.lit("[]"), SPANS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of findings by doc_id."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS long) AS n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans (sorted by start) replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, x: Column) -> Column:
        grown = F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(MASK))
        return F.struct(F.when(x["start"] >= done["at"], grown).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(documents: DataFrame, path: str = "doc_id", ledger: str | None = None, rules: Rules | None = None) -> DataFrame:
    """``documents`` with every span that the ledger holds for its text masked, and n_chars, if there, counted anew.

    No row goes; null texts stay null, and texts without findings stay as they are. Repeated rows are masked each; columns of
    any name go through. Texts with findings are few: their spans are joined to the rows, broadcast after a count of the
    spans, else shuffled.
    """
    found = cut(scan_history(documents.select(path, "text"), path, ledger, rules).where(F.size("spans") > 0).select("blob", "spans").distinct(), "found")
    if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    # The documents' own columns lie in a struct, where no name can clash.
    keyed = documents.select(F.struct(*map(quoted, documents.columns)).alias("own"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    hit = keyed.join(found, "blob", "left").withColumn("new", F.when(F.col("spans").isNotNull(), masked(F.col("own.text"), F.col("spans"))))
    new = {"text": F.coalesce("new", "own.text"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("own")["n_chars"]).cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None}
    return hit.select(*[new.get(c, F.col("own")[c]).alias(c) for c in documents.columns])


# The same expressions for SQL, with the group and the length that a match must have.
_SQL_RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    *[(kind, rule.pattern, 0, 1) for kind, (_, rule) in _MORE.items()],
]
_found = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS g, unnest(regexp_split_to_array(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap, {least} AS least FROM t"
    for k, (kind, p, group, least) in enumerate(_SQL_RULES)
)
SCAN_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS (SELECT *, row_number() OVER () AS r FROM ({_found})
), p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY r) AS e FROM f
), s AS (SELECT doc_id, k, kind, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least
), j AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, k) AS spans, coalesce(string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, k) FILTER (k < 3), '') AS base FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (doc_id)
"""

"""Cleaning joins, stratified splits and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import or_empty, strip
from .resume import with_ordinal

SALTS = 64


def kept_and_removed(rows: DataFrame, clean: DataFrame, key: str, clean_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose stripped key is among the clean keys, and the others; a blank key never matches."""
    keys = clean.select(strip(or_empty(F.col(clean_key or key).cast("string"))).alias("__k")).where("__k <> ''").distinct()
    keyed = rows.withColumn("__k", strip(or_empty(F.col(key).cast("string"))))
    return keyed.join(keys, "__k", "left_semi").drop("__k"), keyed.join(keys, "__k", "left_anti").drop("__k")


def filter_summary(rows: DataFrame, clean: DataFrame, key: str, clean_key: str | None = None) -> DataFrame:
    """One row: input rows, distinct clean keys, kept and removed rows."""
    keys = clean.select(strip(or_empty(F.col(clean_key or key).cast("string"))).alias("__k")).where("__k <> ''").distinct()
    flagged = rows.select(strip(or_empty(F.col(key).cast("string"))).alias("__k")).join(keys.withColumn("__hit", F.lit(True)), "__k", "left")
    counts = flagged.agg(F.count("*").alias("rows"), F.count_if(F.col("__hit").isNotNull()).alias("kept"), F.count_if(F.col("__hit").isNull()).alias("removed"))
    return counts.join(F.broadcast(keys.agg(F.count("*").alias("clean_keys"))))  # one row each


def write_kept_and_removed(rows: DataFrame, clean: DataFrame, key: str, path: str, clean_key: str | None = None) -> dict[str, int]:
    """Write ``rows`` to ``path`` in the parts ``kept=true`` and ``kept=false``; the counts of ``filter_summary``, taken by the pass that writes."""
    keys = clean.select(strip(or_empty(F.col(clean_key or key).cast("string"))).alias("__k")).where("__k <> ''").distinct()
    of_keys, of_rows = Observation(), Observation()
    seen = keys.observe(of_keys, F.count("*").alias("clean_keys")).withColumn("__hit", F.lit(True))
    marked = rows.withColumn("__k", strip(or_empty(F.col(key).cast("string")))).join(seen, "__k", "left").withColumn("kept", F.col("__hit").isNotNull()).drop("__k", "__hit")
    counts = F.count("*").alias("rows"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed")
    marked.observe(of_rows, *counts).write.partitionBy("kept").parquet(path)
    return {**of_rows.get, **of_keys.get}


def matching_ids(rows: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Rows whose id, as text, is among the clean ids; missing ids are the text nan on both sides."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("nan"))
    return rows.withColumn("__k", text).join(clean.select(text.alias("__k")).distinct(), "__k", "left_semi").drop("__k")


def valid_and_invalid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the others with it; ``error`` is null for valid rows."""
    marked = rows.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def numbered_errors(rows: DataFrame, error: Column, order: str) -> DataFrame:
    """(row_number, order, error) of the invalid rows; numbers are those of a file's lines whose first row follows its header."""
    placed = with_ordinal(rows.withColumn("__error", error), order, "__n")
    return placed.where("__error IS NOT NULL").select((F.col("__n") + 2).alias("row_number"), order, F.col("__error").alias("error"))


def contrast_eligible(labels: Column) -> Column:
    """Whether any label is one whose images may get local contrast enhancement."""
    return F.arrays_overlap(labels, F.array(*map(F.lit, dims.CONTRAST_TAGS)))


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by a key that each holds once; a key that one side lacks or repeats is an error when the rows are read or counted.

    Both sides meet in one aggregate by the key. The check is a filter on its counts, so no projection drops it.
    """
    sides = {"__l": [c for c in left.columns if c != key], "__r": [c for c in right.columns if c != key]}
    none = {n: F.lit(None).cast(df.select(F.struct(*sides[n])).schema[0].dataType).alias(n) for n, df in (("__l", left), ("__r", right))}
    both = left.select(key, F.struct(*sides["__l"]).alias("__l"), none["__r"]).unionByName(right.select(key, none["__l"], F.struct(*sides["__r"]).alias("__r")))
    met = both.groupBy(key).agg(*[f(n).alias(n + tail) for n in sides for f, tail in ((lambda c: F.first(c, ignorenulls=True), ""), (F.count, "_n"))])
    wrong = F.raise_error(F.concat(F.lit("no one-to-one match for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return met.where(F.when((F.col("__l_n") == 1) & (F.col("__r_n") == 1), F.lit(True)).otherwise(wrong)).select(key, "__l.*", "__r.*")


def load_counters(rows: DataFrame, text: str, found: Column, order: str, most: int | None = None) -> DataFrame:
    """One row of loading counters: rows seen, empty, unresolved and kept, up to the row that makes ``most`` kept ones.

    Where counting has to stop early, the last row's place is found by an ordered limit, not by a window over all rows.
    """
    empty = strip(or_empty(F.col(text))) == ""
    marked = rows.select(F.col(order).alias("__o"), empty.alias("__e"), found.alias("__f"))
    if most is not None and most > 0:
        last = marked.where("NOT __e AND __f").orderBy("__o").limit(most).agg(F.max("__o").alias("last"), F.count("*").alias("got"))
        marked = marked.join(F.broadcast(last)).where(F.expr(f"got < {most} OR __o <= last"))  # one row
    return marked.agg(F.count("*").alias("seen"), F.count_if("__e").alias("empty"), F.count_if(F.expr("NOT __e AND NOT __f")).alias("unresolved"), F.count_if(F.expr("NOT __e AND __f")).alias("kept"))


def write_loaded(rows: DataFrame, text: str, found: Column, path: str) -> dict[str, int]:
    """Write the rows that loading keeps, those with a text and a file, to ``path``; the counters of ``load_counters`` over all rows, taken by the pass
    that writes. Null ``found`` is no file."""
    counts = Observation()
    marked = rows.withColumns({"__e": strip(or_empty(F.col(text))) == "", "__f": F.coalesce(found, F.lit(False))})
    empty, there = F.col("__e"), F.col("__f")
    marked = marked.observe(counts, F.count("*").alias("seen"), F.count_if(empty).alias("empty"), F.count_if(~empty & ~there).alias("unresolved"), F.count_if(~empty & there).alias("kept"))
    marked.where(~empty & there).select(*rows.columns).write.parquet(path)
    return counts.get


def quota(n: Column, val: float, test: float) -> dict[str, Column]:
    """Rows of a stratum of ``n`` that go to train, val and test.

    Half-even rounding, at least one each from ten rows on, and at least one row for train: what is over is taken from
    the larger of val and test (val at a tie), in closed form.
    """
    least = lambda ratio: F.when((n >= 10) & F.lit(ratio > 0), F.greatest(F.bround(n * F.lit(float(ratio))).cast("long"), F.lit(1))).otherwise(F.bround(n * F.lit(float(ratio))).cast("long"))
    v, t = least(val), least(test)
    over = F.greatest(F.lit(0), v + t - (n - 1))
    apart = v - t
    first = F.least(over, F.abs(apart))
    rest = over - first
    v2 = v - F.when(apart > 0, first).otherwise(F.lit(0)) - F.ceil(rest / 2)
    t2 = t - F.when(apart < 0, first).otherwise(F.lit(0)) - F.floor(rest / 2)
    one = n <= 1
    zero = F.lit(0).cast("long")
    v2, t2 = F.when(one, zero).otherwise(v2.cast("long")), F.when(one, zero).otherwise(t2.cast("long"))
    return {"train": n - v2 - t2, "val": v2, "test": t2}


def stratum_quotas(rows: DataFrame, stratum: str, val: float = 0.02, test: float = 0.02) -> DataFrame:
    """(stratum, n, train, val, test) of each stratum."""
    return rows.groupBy(stratum).agg(F.count("*").alias("n")).select(stratum, "n", *[c.alias(k) for k, c in quota(F.col("n"), val, test).items()])


def stratified_split(rows: DataFrame, stratum: str, key: str, val: float = 0.02, test: float = 0.02, seed: int = 42, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``split``: by md5 of key and seed within each stratum, the first to train, then val, then test.

    A row's place is its rank within its hash prefix plus the rows of smaller prefixes, so that a stratum with a
    third of all rows is ranked in ``salts`` pieces and never in one task.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    hashed = rows.withColumn("__h", digest)
    width = 1
    while 16**width < salts:
        width += 1
    hashed = hashed.withColumn("__s", F.substring("__h", 1, width))
    sizes = hashed.groupBy(stratum, "__s").agg(F.count("*").alias("__m"))
    by_prefix = Window.partitionBy(stratum).orderBy("__s")
    sizes = sizes.select(stratum, "__s", (F.sum("__m").over(by_prefix) - F.col("__m")).alias("__before"), F.sum("__m").over(Window.partitionBy(stratum)).alias("n"))
    local = F.row_number().over(Window.partitionBy(stratum, "__s").orderBy("__h", key))
    sizes = sizes.withColumnsRenamed({stratum: "__g", "__s": "__t"})
    placed = hashed.withColumn("__r", local).join(sizes, F.expr(f"`{stratum}` <=> __g AND __s = __t")).withColumn("__p", F.col("__r") + F.col("__before"))
    q = quota(F.col("n"), val, test)
    split = F.when(F.col("__p") <= q["train"], F.lit("train")).when(F.col("__p") <= q["train"] + q["val"], F.lit("val")).otherwise(F.lit("test"))
    return placed.withColumn("split", split).select(*rows.columns, "split")


def split_sizes(split: DataFrame, stratum: str) -> DataFrame:
    """(split, rows, strata) of each split."""
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(stratum).alias("strata"))


def most_common(rows: DataFrame, value: str, order: str, k: int = 20) -> DataFrame:
    """(value, n, first) of the ``k`` most frequent values; ties to the one that appears first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def label_vocabulary(rows: DataFrame, labels: Column) -> DataFrame:
    """(label, index): distinct labels in code-point order, numbered from 0. The vocabulary is the small side by nature."""
    found = rows.select(F.explode(labels).alias("label")).distinct()
    return found.withColumn("index", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def label_support(rows: DataFrame, labels: Column, vocabulary: DataFrame) -> DataFrame:
    """(label, support): in how many rows each label of the vocabulary occurs; 0 included."""
    counts = rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("support"))
    return vocabulary.join(counts, "label", "left").select("label", F.coalesce("support", F.lit(0)).alias("support"))


def class_balanced_weights(support: DataFrame, beta: float = 0.9999) -> DataFrame:
    """(label, support, weight): (1 - beta) / (1 - beta^n), divided by its mean over all labels, then 1 where n is 0."""
    if not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    raw = (1 - F.lit(beta)) / F.greatest(1 - F.pow(F.lit(beta), F.greatest(F.col("support"), F.lit(1)).cast("double")), F.lit(1e-12))
    rows = support.withColumn("__w", raw).withColumn("__mean", F.avg("__w").over(Window.partitionBy()))  # a row a label
    weight = F.when(F.col("support") <= 0, F.lit(1.0)).otherwise(F.col("__w") / F.greatest("__mean", F.lit(1e-12)))
    return rows.select("label", "support", weight.alias("weight"))

"""Aggregate metrics over scored reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from .score import MEASURES, safe_div


def mean_scores(scored: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row: the mean of each measure (0 for no rows) and the number of rows."""
    return scored.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in (*MEASURES, *extra)], F.count("*").alias("num_samples"))


def label_pairs(scored: DataFrame, pred: str = "pred_diagnosis_labels", ref: str = "ref_diagnosis_labels") -> DataFrame:
    """(p, r, n): how many rows have each pair of predicted and given label sets. Rows are read once and counted map-side; what metrics need of labels
    is worked out on the pairs, of which there are few, and no row is exploded."""
    return scored.groupBy(F.array_sort(F.array_distinct(pred)).alias("p"), F.array_sort(F.array_distinct(ref)).alias("r")).agg(F.count("*").alias("n"))


def label_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of the labels in ``label_pairs``."""
    both = pairs.select(F.explode(F.array_union("p", "r")).alias("label"), "p", "r", "n")
    in_p, in_r = F.array_contains("p", F.col("label")), F.array_contains("r", F.col("label"))
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return both.groupBy("label").agg(rows(in_p & in_r).alias("tp"), rows(in_p & ~in_r).alias("fp"), rows(~in_p & in_r).alias("fn"))


def _rates(df: DataFrame, n: Column) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    df = df.withColumn("precision", safe_div(tp, tp + fp)).withColumn("recall", safe_div(tp, tp + fn))
    df = df.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return df.withColumn("accuracy", safe_div(n - fp - fn, n)).withColumn("support", tp + fn)


def label_metrics(scored: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, accuracy, support) of each label that is predicted or given."""
    pairs = label_pairs(scored)
    rows = F.broadcast(pairs.agg(F.sum("n").alias("n")))  # one row, over the same exchange
    return _rates(label_counts(pairs).join(rows), F.col("n")).drop("n")


def micro_macro(scored: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 over all labels, and the plain mean of the labels' F1."""
    each = label_metrics(scored)
    sums = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return sums.select(p.alias("micro_precision"), r.alias("micro_recall"), safe_div(2 * p * r, p + r).alias("micro_f1"), "macro_f1")


def family_accuracy(scored: DataFrame, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(family, support, correct, accuracy): of rows that have a label of the family, those predicted with the same ones."""
    families = families or dims.FAMILIES
    found = []
    for name, members in families.items():
        own = F.array(*map(F.lit, members))
        r, p = F.array_sort(F.array_intersect("r", own)), F.array_sort(F.array_intersect("p", own))
        found.append(F.struct(F.lit(name).alias("family"), (F.size(r) > 0).alias("has"), (r == p).alias("same")))
    each = label_pairs(scored).select("n", F.explode(F.array(*found)).alias("x")).select("n", "x.*")
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = each.groupBy("family").agg(rows(F.col("has")).alias("support"), rows(F.col("has") & F.col("same")).alias("correct"))
    return out.withColumn("accuracy", safe_div(F.col("correct"), F.col("support")))


def family_mean(families: DataFrame) -> DataFrame:
    """One row: the plain mean over families that occur (0 if none does)."""
    return families.where("support > 0").agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("family_level_accuracy"))


def exact_median(rows: DataFrame, value: str, few: int = 10_000) -> float | None:
    """The exact median of a column's values that aren't null or NaN; of an even number of them, the mean of the middle two. None without any.

    The middle places are closed in on by passes over the column: a mergeable sketch gives two values near a place, counts say on which side of them it lies,
    until at most ``few`` values or equal ones are left between, which one task sorts. Each pass brings down the number of values between by some
    thousand times; only counts, ends and sketches' values reach the driver. ``rows`` is read in every pass, so pass a written table.
    """
    v = F.col(value).cast("double")
    rows = rows.select(v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    many, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not many:
        return None
    middle = {(many - 1) // 2, many // 2}
    found = {k: _at_place(rows, k, many, lo, hi, few) for k in sorted(middle)}
    return sum(found.values()) / len(found)


def _at_place(rows: DataFrame, place: int, many: int, lo: float, hi: float, few: int) -> float:
    """The value that ``place`` values come before in order, given all ``many`` and their ends."""
    while lo < hi and many > few:
        share = place / many
        near = rows.agg(F.percentile_approx("v", [max(0.0, share - 5e-4), min(1.0, share + 5e-4)], 10_000)).first()[0]
        a, b = near
        below, at_a, at_b = rows.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") == a), F.count_if((F.col("v") > a) & (F.col("v") < b))).first()
        if place < below:
            rows, many = rows.where(F.col("v") < a), below
        elif place < below + at_a:
            return a
        elif place < below + at_a + at_b:
            rows, place, many = rows.where((F.col("v") > a) & (F.col("v") < b)), place - below - at_a, at_b
        else:
            rows, place, many = rows.where(F.col("v") >= b) if b > a else rows.where(F.col("v") > a), place - below - at_a - at_b, many - below - at_a - at_b
        lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    return lo if lo == hi else rows.agg(F.get(F.array_sort(F.collect_list("v")), F.lit(place))).first()[0]

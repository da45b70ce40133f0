"""Scores of a predicted report against its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.structure import measured
from ..functions.text import let

MEASURES = (
    "format_correct", "diagnosis_exact_set_acc", "description_exact_match", "description_finding_set_f1", "description_location_f1",
    "description_count_bucket_acc", "description_cdr_abs_error", "description_cdr_tol_hit",
)
LABELS = ("pred_diagnosis_labels", "ref_diagnosis_labels")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets (arrays): 1 if both are empty, 0 if one is."""
    rates = lambda x: F.struct(safe_div(x["shared"], x["a"]).alias("p"), safe_div(x["shared"], x["b"]).alias("r"))
    counts = F.struct(F.size(F.array_intersect(a, b)).cast("double").alias("shared"), F.size(F.array_distinct(a)).alias("a"), F.size(F.array_distinct(b)).alias("b"))
    f1 = let(let(counts, rates), lambda x: safe_div(2 * x["p"] * x["r"], x["p"] + x["r"]))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(f1)


def bucket_accuracy(pred: Column, ref: Column) -> Column:
    """Share of the reference's keys for which the prediction has the same bucket; without keys 1 if neither has any."""
    return F.when(F.size(ref) == 0, (F.size(pred) == 0).cast("double")).otherwise(F.size(F.array_intersect(ref, pred)).cast("double") / F.size(ref).cast("double"))


def ratio_error(pred: Column, ref: Column) -> Column:
    return F.when(ref.isNull(), F.lit(0.0)).when(pred.isNull(), F.lit(1.0)).otherwise(F.abs(pred - ref))


def ratio_hit(pred: Column, ref: Column, tolerance: float = dims.RATIO_TOLERANCE) -> Column:
    return F.when(ref.isNull(), pred.isNull()).when(pred.isNull(), F.lit(False)).otherwise(F.abs(pred - ref) <= F.lit(tolerance)).cast("double")


def score_reports(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """``df`` with the eight measures and both sorted label lists (arrays)."""
    both = measured(MEASURES, LABELS)(F.col(prediction), F.col(reference))
    return df.select("*", both.alias("__both")).select(*df.columns, "__both.*")


def flat_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """Prediction rows for a sink: measures, and labels joined by 、."""
    return scored.select(*keys, *MEASURES, *[F.array_join(c, "、").alias(c) for c in LABELS])


def weighted_scores(df: DataFrame, parts: dict[str, float] | None = None, weights: dict[str, float] | None = None, diagnosis: str = "diagnosis_exact_set_acc", prefix: str = "") -> DataFrame:
    """``df`` with description_score (weighted mean; 0 without weight), format_score, diagnosis_score and final_score."""
    parts, weights = parts or dims.DESCRIPTION_PARTS, weights or dims.FINAL_WEIGHTS
    total = float(sum(parts.values()))
    mean = sum((F.col(prefix + n) * F.lit(float(w)) for n, w in parts.items()), F.lit(0.0)) / F.lit(total) if total > 0 else F.lit(0.0)
    df = df.withColumns({prefix + "description_score": mean, prefix + "format_score": F.col(prefix + "format_correct"), prefix + "diagnosis_score": F.col(prefix + diagnosis)})
    final = F.lit(weights["description"]) * F.col(prefix + "description_score") + F.lit(weights["format"]) * F.col(prefix + "format_score") + F.lit(weights["diagnosis"]) * F.col(prefix + "diagnosis_score")
    return df.withColumn(prefix + "final_score", final)

"""Preference pairs from scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import has_report_format, normalized
from ..session import written
from .metrics import exact_median
from .score import MEASURES, score_reports, weighted_scores


def candidates(df: DataFrame) -> DataFrame:
    """``df`` (ord, img_id, reference, prediction) as candidates: the chosen text scored against itself, the rejected one's
    measures and scores, and the margin. Against itself a text has every measure but the format's, so it isn't parsed again."""
    w = dims.FINAL_WEIGHTS
    own = F.lit(w["description"]) + F.lit(w["format"]) * has_report_format(normalized(F.col("reference"))).cast("double") + F.lit(w["diagnosis"])
    other = weighted_scores(score_reports(df))
    rows = other.withColumnRenamed("final_score", "score_rejected").withColumn("score_chosen", own)
    return rows.select("ord", "img_id", F.col("reference").alias("chosen"), F.col("prediction").alias("rejected"), "score_chosen", "score_rejected", (F.col("score_chosen") - F.col("score_rejected")).alias("margin"), *MEASURES, "description_score")


def learnable(threshold: float = dims.LEARNING_THRESHOLD):
    """Whether a rejected text has something wrong that is worth learning."""
    return (F.coalesce("diagnosis_exact_set_acc", F.lit(0.0)) < 1) | (F.coalesce("format_correct", F.lit(0.0)) < 1) | (F.coalesce("description_score", F.lit(0.0)) < threshold)


def select_pairs(rows: DataFrame, threshold: float = dims.LEARNING_THRESHOLD) -> DataFrame:
    """Rows with margin_kept (at least the exact median of all margins) and selected (kept and learnable).

    ``rows`` are written to a work table: the median's passes read the margins of that, and nothing is scored twice.
    """
    scored = written(rows, "candidates")
    middle = exact_median(scored, "margin")
    kept = scored.withColumn("margin_threshold", F.lit(middle or 0.0)).withColumn("margin_kept", F.coalesce("margin", F.lit(0.0)) >= F.col("margin_threshold"))
    return kept.withColumn("selected", F.col("margin_kept") & learnable(threshold))


def preference_records(selected: DataFrame, *keys: str) -> DataFrame:
    """Selected rows with the fields of a preference data set; missing numbers are 0."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return selected.where("selected").select(*keys, "chosen", "rejected", *[number(c) for c in ("score_chosen", "score_rejected", "margin", "format_correct", "diagnosis_exact_set_acc", "description_score")])


def _figures(threshold: float) -> list[Column]:
    wrong = {"format_error": F.col("format_correct") < 1, "diagnosis_error": F.col("diagnosis_exact_set_acc") < 1, "low_description_score": F.col("description_score") < threshold}
    chosen = F.col("selected")
    return [
        F.count("*").alias("num_candidates"), F.count_if("margin_kept").alias("num_margin_kept"), F.count_if("selected").alias("num_selected"), F.coalesce(F.max("margin_threshold"), F.lit(0.0)).alias("margin_threshold"),
        F.coalesce(F.avg("margin"), F.lit(0.0)).alias("avg_margin_all"), F.coalesce(F.avg(F.when(chosen, F.col("margin"))), F.lit(0.0)).alias("avg_margin_selected"),
        *[F.count_if(c).alias(f"{n}_count_all") for n, c in wrong.items()], *[F.count_if(c & chosen).alias(f"{n}_count_selected") for n, c in wrong.items()],
    ]


def summary(marked: DataFrame, threshold: float = dims.LEARNING_THRESHOLD) -> DataFrame:
    """One row of counts, mean margins and error counts over all and over selected candidates."""
    return marked.agg(*_figures(threshold))


def write_preferences(marked: DataFrame, path: str, *keys: str, threshold: float = dims.LEARNING_THRESHOLD) -> dict[str, float]:
    """Write the ``preference_records`` of all candidates to ``path``; the figures of ``summary``, taken by the pass that writes."""
    figures = Observation()
    preference_records(marked.observe(figures, *_figures(threshold)), *keys).write.parquet(path)
    return figures.get

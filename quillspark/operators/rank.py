"""Checkpoint ranking and loss series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims

NO_STEP = 10**18


def checkpoint_step(name: Column) -> Column:
    """Number at the end of a checkpoint's name; names without one come last."""
    return F.coalesce(F.regexp_extract(F.coalesce(name, F.lit("")), r"checkpoint-([0-9]+)$", 1).try_cast("long"), F.lit(NO_STEP))


def ranked(rows: DataFrame, metrics: list[str], step: str = "step") -> DataFrame:
    """``rows`` in order of the metrics, largest first and missing last, then of the step; ``rank`` from 1.

    Rows are checkpoints of one run, so one task ranks them.
    """
    order = [F.desc_nulls_last(m) for m in metrics] + [F.coalesce(F.col(step), F.lit(NO_STEP))]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best(rows: DataFrame, metric: str, step: str = "step") -> DataFrame:
    """The row with the largest metric (missing lowest), ties to the smaller step."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))).alias("m"), (-F.coalesce(F.col(step), F.lit(NO_STEP))).alias("s"))).alias("x")).select("x.*")


def training_hint(rows: DataFrame, metric: str, step: str = "step") -> DataFrame:
    """One row: the best and the latest step, and whether the best one lies before, at or mixed with the latest."""
    top = rows.agg(
        F.max_by(F.struct(F.col(step).alias("s"), F.col(metric).alias("v")), F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))), -F.coalesce(F.col(step), F.lit(NO_STEP)))).alias("b"),
        F.max_by(F.struct(F.col(step).alias("s"), F.col(metric).alias("v")), F.col(step)).alias("l"),
    )
    kind = F.when((F.col("b.s") < F.col("l.s")) & (F.col("l.v") <= F.col("b.v")), F.lit("best_earlier")).when(F.col("b.s") == F.col("l.s"), F.lit("best_latest")).otherwise(F.lit("mixed"))
    return top.select(F.col("b.s").alias("best_step"), F.col("l.s").alias("latest_step"), kind.alias("hint"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, step, epoch, loss, eval_loss) of the log in each trainer state, a JSON document, under ``path``; ``ord`` is the record's place from 0."""
    rows = spark.read.option("multiLine", True).schema("log_history array<struct<step: double, epoch: double, loss: double, eval_loss: double>>").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode("log_history").alias("ord", "x")).select("path", "ord", "x.*")


def loss_series(history: DataFrame, order: str, step: str = "step", loss: str = "loss", eval_loss: str = "eval_loss", epoch: str | None = None) -> DataFrame:
    """(ord, step, kind, value) of log records that have a step, and their epoch (0 if missing) if that is named: a record with an
    evaluation loss is an evaluation, whatever other loss it holds; one with a training loss alone is training."""
    kind = F.when(F.col(eval_loss).isNotNull(), F.lit("eval")).when(F.col(loss).isNotNull(), F.lit("train"))
    epochs = [F.coalesce(F.col(epoch).cast("double"), F.lit(0.0)).alias("epoch")] if epoch else []
    value = F.coalesce(F.col(eval_loss), F.col(loss)).cast("double").alias("value")
    return history.where(F.col(step).isNotNull()).select(F.col(order).alias("ord"), F.col(step).alias("step"), *epochs, kind.alias("kind"), value).where("kind IS NOT NULL")


def best_eval(series: DataFrame) -> DataFrame:
    """The evaluation record with the smallest value, the first at a tie."""
    return series.where("kind = 'eval'").agg(F.min_by(F.struct("ord", "step", "value"), F.struct("value", "ord")).alias("x")).where("x IS NOT NULL").select("x.*")


def scaled(value: Column, lo: Column, hi: Column, start: float, end: float) -> Column:
    """Linear map of lo to hi onto start to end; the middle if lo equals hi."""
    share = (value - lo) / F.nullif(hi - lo, F.lit(0.0))
    return F.when(hi == lo, F.lit((start + end) / 2)).otherwise(F.lit(start) + share * F.lit(end - start))


def polyline(series: DataFrame, width: float = 800.0, height: float = 400.0) -> DataFrame:
    """``series`` with x and y in a drawing, over the range of all its steps and values."""
    span = series.agg(*[f(c).alias(f"__{n}_{c}") for c in ("step", "value") for n, f in (("lo", F.min), ("hi", F.max))])
    col = lambda n: F.col(n).cast("double")
    both = series.join(F.broadcast(span))  # one row
    return both.select(*series.columns, scaled(col("step"), col("__lo_step"), col("__hi_step"), 0.0, width).alias("x"), scaled(col("value"), col("__lo_value"), col("__hi_value"), height, 0.0).alias("y"))


def greater_is_better(metric: str | Column) -> bool | Column:
    return metric not in dims.LESS_IS_BETTER if isinstance(metric, str) else ~metric.isin(*dims.LESS_IS_BETTER)


def structured_metric(metric: str | Column) -> bool | Column:
    """Whether a metric comes from generated reports."""
    return metric in dims.STRUCTURED_METRICS if isinstance(metric, str) else metric.isin(*dims.STRUCTURED_METRICS)


def runs_structured(metric: str | Column, wanted: bool | Column | None) -> bool | Column:
    """Whether reports are generated in training: as wanted, or else if the metric needs them."""
    if isinstance(metric, str):
        return structured_metric(metric) if wanted is None else wanted
    return F.coalesce(wanted, structured_metric(metric))


def scalar_metrics(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, metric, value) of the numeric and boolean columns, under ``prefix`` and their names; null values go."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    names = [c for c, kind in rows.dtypes if c != key and (kind in kinds or kind.startswith("decimal"))]
    each = F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return rows.select(key, F.inline(each)).where("value IS NOT NULL")


def evaluated_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` rows by a declared order; all, if it is null, not positive or not less than their number."""
    return rows if most is None or most <= 0 else rows.orderBy(order).limit(most)


def aligned_save_steps(save: Column, evaluate: Column) -> Column:
    """Save steps raised to a multiple of the evaluation steps."""
    return (F.ceil(save / evaluate) * evaluate).cast("long")

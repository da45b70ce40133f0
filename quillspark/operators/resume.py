"""Resumable work: what is left, what is there, and roll-ups of its log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def pending(tasks: DataFrame, outputs: DataFrame, log: DataFrame, key: str, output: str) -> DataFrame:
    """Tasks whose output isn't there and whose input isn't in the log. Failed inputs are in the log and count as done."""
    left = tasks.join(outputs.select(output).distinct(), output, "left_anti")
    return left.join(log.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*tasks.columns)


def skip_counts(tasks: DataFrame, outputs: DataFrame, log: DataFrame, key: str, output: str) -> DataFrame:
    """One row: all tasks, those skipped for their output, for the log, and those left."""
    marked = tasks.join(outputs.select(output).distinct().withColumn("__o", F.lit(True)), output, "left").join(log.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__l", F.lit(True)), key, "left")
    there, logged = F.col("__o").isNotNull(), F.col("__l").isNotNull()
    return marked.agg(F.count("*").alias("tasks"), F.count_if(there).alias("skipped_output"), F.count_if(~there & logged).alias("skipped_log"), F.count_if(~there & ~logged).alias("pending"))


def write_pending(tasks: DataFrame, outputs: DataFrame, log: DataFrame, key: str, output: str, path: str) -> dict[str, int]:
    """Write the tasks that are left to ``path``; the counts of ``skip_counts``, taken by the pass that writes."""
    there = outputs.select(output).distinct().withColumn("__o", F.lit(True))
    logged = log.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__l", F.lit(True))
    marked = tasks.join(there, output, "left").join(logged, key, "left")
    has, seen = F.col("__o").isNotNull(), F.col("__l").isNotNull()
    counts = Observation()
    marked = marked.observe(counts, F.count("*").alias("tasks"), F.count_if(has).alias("skipped_output"), F.count_if(~has & seen).alias("skipped_log"), F.count_if(~has & ~seen).alias("pending"))
    marked.where(~has & ~seen).select(*tasks.columns).write.parquet(path)
    return counts.get


def existing_records(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """One record a key over several files: later files, and within one later records, win."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("__file", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    names = [c for c in every.columns if c != "__file"]
    return every.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("__file", order)).alias("x")).select("x.*")


def status_rollup(log: DataFrame) -> DataFrame:
    """(status, mode, n): records by status, those that went well by mode as well."""
    mode = F.when(F.col("status") == "ok", F.coalesce("mode", F.lit(""))).otherwise(F.lit(""))
    return log.groupBy("status", mode.alias("mode")).agg(F.count("*").alias("n"))


def with_ordinal(rows: DataFrame, order: str, name: str = "source_index") -> DataFrame:
    """``rows`` numbered from 0 by a declared order.

    Numbers are a rank within ranges of the order (a number) plus the rows of earlier ranges, so no task holds all rows.
    """
    edges = rows.agg(F.percentile_approx(order, [k / 64 for k in range(1, 64)], 1000)).first()[0] or []
    ranged = rows.withColumn("__part", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order))) if edges else F.lit(0))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("__r", local).join(F.broadcast(before), "__part").withColumn(name, F.col("__r") + F.col("__before")).select(*rows.columns, name)  # 64 rows


def state_matches(saved: dict, now: dict) -> bool:
    """Whether a saved run state agrees with the present one on every present key; more saved keys don't matter."""
    return all(k in saved and saved[k] == v for k, v in now.items())


def output_mode(exists: bool, saved: dict | None, now: dict, resume: bool, overwrite: bool) -> str:
    """fresh, overwrite or resume; an error where existing results would be mixed with another run's."""
    if not exists:
        return "fresh"
    if overwrite:
        return "overwrite"
    if resume:
        if saved is None or not state_matches(saved, now):
            raise ValueError("the saved run has other settings")
        return "resume"
    raise FileExistsError("the output is there; resume or overwrite it")

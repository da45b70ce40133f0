"""Kernels over dense arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import safe_div


def multi_hot(labels: Column, vocabulary: Column) -> Column:
    """1 or 0 for each label of the vocabulary; other labels are ignored."""
    return F.transform(vocabulary, lambda v: F.array_contains(labels, v).cast("double"))


def bce(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def logit_metrics(rows: DataFrame, key: str, logits: str, targets: str) -> DataFrame:
    """One row: mean cross-entropy, share of rows with all labels right, micro F1, and macro F1 over labels that occur."""
    cells = rows.select(key, F.posexplode(F.arrays_zip(F.col(logits).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))).alias("pos", "z")).select(key, "pos", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    p, t = F.col("x") > 0, F.col("y") > 0.5
    labels = cells.groupBy("pos").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.sum(bce(F.col("x"), F.col("y"))).alias("loss"), F.count("*").alias("n"))
    f1 = safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    sums = labels.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("loss").alias("loss"), F.sum("n").alias("n"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, f1)).alias("macro"))
    exact = rows.agg(F.avg(F.forall(F.arrays_zip(F.col(logits).alias("x"), F.col(targets).alias("y")), lambda z: (z["x"] > 0) == (z["y"] > 0.5)).cast("double")).alias("exact"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    micro = safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.join(F.broadcast(exact)).select(zero(F.col("loss") / F.nullif(F.col("n"), F.lit(0))).alias("diag_bce_loss"), zero("exact").alias("diag_exact_set_acc"), zero(micro).alias("diag_micro_f1"), zero("macro").alias("diag_macro_f1"))


def focal_loss(logits: Column, targets: Column, weights: Column, gamma: float) -> Column:
    """Sum over positions of cross-entropy times (1 - p of the truth)^gamma times the class weight."""
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    z = F.arrays_zip(logits.alias("x"), targets.alias("y"), weights.alias("w"))

    def one(v: Column) -> Column:
        p = 1 / (1 + F.exp(-v["x"]))
        truth = p * v["y"] + (1 - p) * (1 - v["y"])
        return bce(v["x"], v["y"]) * F.pow(1 - truth, F.lit(float(gamma))) * v["w"]

    return F.aggregate(F.transform(z, one), F.lit(0.0), lambda a, b: a + b)


def pooled(rows: DataFrame, group: str, order: str, vector: str, mask: str, how: str = "mean") -> DataFrame:
    """(group, pos, value): masked mean, first or last vector of each group, by element; 0 if all are masked out."""
    m = F.col(mask).cast("double")
    if how in ("first", "last"):
        # One whole vector of each group is kept; only it is taken apart.
        pick = F.min_by if how == "first" else F.max_by
        whole = rows.groupBy(group).agg(pick(vector, F.when(m > 0, F.col(order))).alias("__v"), F.max(F.size(vector)).alias("__n"))
        zeros = F.array_repeat(F.lit(0.0), F.col("__n"))
        return whole.select(group, F.posexplode(F.coalesce(F.col("__v").cast("array<double>"), zeros)).alias("pos", "value"))
    if how != "mean":
        raise ValueError(f"no such pooling: {how}")
    cells = rows.select(group, mask, F.posexplode(vector).alias("pos", "v"))
    mean = F.sum(F.col("v").cast("double") * m) / F.greatest(F.sum(m), F.lit(1.0))
    return cells.groupBy(group, "pos").agg(F.coalesce(mean, F.lit(0.0)).alias("value"))


def token_cross_entropy(rows: DataFrame, group: str, order: str, logits: str, label: str) -> DataFrame:
    """One row: mean cross-entropy of each position's logits for the next position's label; labels of -100 don't count."""
    from pyspark.sql import Window

    following = rows.withColumn("__next", F.lead(label).over(Window.partitionBy(group).orderBy(order))).where("__next IS NOT NULL AND __next <> -100")
    x = F.col(logits).cast("array<double>")
    top = F.array_max(x)
    lse = top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b))
    return following.agg(F.coalesce(F.avg(lse - F.get(x, F.col("__next").cast("int"))), F.lit(0.0)).alias("loss"))


def multitask_loss(lm: Column, diagnosis: Column, weight: float) -> Column:
    return lm + F.lit(float(weight)) * diagnosis


def longest_side(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    """Size whose longest side is at most ``limit``: sides scaled alike, rounded half to even, at least 1."""
    longest = F.greatest(width, height)
    scale = F.lit(float(limit)) / longest
    side = lambda c: F.when(longest <= limit, c.cast("long")).otherwise(F.greatest(F.bround(c * scale).cast("long"), F.lit(1)))
    return side(width), side(height)


def padded_box(width: Column, height: Column, out_width: int, out_height: int) -> dict[str, Column]:
    """Size of an image scaled into a canvas, rounded half to even and at least 1, and where its corner lies in the canvas."""
    scale = F.least(F.lit(float(out_width)) / width, F.lit(float(out_height)) / height)
    side = lambda c: F.greatest(F.bround(c * scale).cast("long"), F.lit(1))
    w, h = side(width), side(height)
    return {"width": w, "height": h, "left": F.floor((F.lit(out_width) - w) / 2), "top": F.floor((F.lit(out_height) - h) / 2)}


def crop_box(width: Column, height: Column, box: tuple[Column, Column, Column, Column], margin: float = 0.02) -> dict[str, Column]:
    """The square around a mask's box (left, right, top, bottom, all inside it) with a margin, cut at the image's edges; without a
    mask the whole image."""
    x1, x2, y1, y2 = box
    side = F.greatest(x2 - x1 + 1, y2 - y1 + 1)
    half = F.floor((side + 2 * F.floor(side * F.lit(margin))) / 2)
    cx, cy = F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2)
    edge = lambda inside, whole: F.when(x1.isNull() | y1.isNull(), whole).otherwise(inside).cast("long")
    return {"left": edge(F.greatest(F.lit(0), cx - half), F.lit(0)), "right": edge(F.least(width, cx + half), width), "top": edge(F.greatest(F.lit(0), cy - half), F.lit(0)), "bottom": edge(F.least(height, cy + half), height)}

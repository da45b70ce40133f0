"""Rarity scores, and the bookkeeping of quota-based augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import normalized_report, or_empty, strip


def tail_scores(rows: DataFrame, key: str, labels: Column, beta: float = dims.TAIL_BETA, mix: float = dims.TAIL_LAMBDA) -> DataFrame:
    """(key, single, combo, tail, score): mean rarity of a row's labels, rarity of their combination, and both mixed.

    Single: mean of (1 - beta) / (1 - beta^n) over the labels. Combination: how far the logarithm of its count lies
    below the largest, between the largest and the smallest (1 for all if these are equal). The score is ``tail`` moved to 0
    to 1 by its smallest and largest value, which is an assumption: the normalisation isn't stated anywhere.
    """
    base = rows.select(F.col(key), F.array_sort(F.array_distinct(labels)).alias("__l")).withColumn("__c", F.array_join("__l", "、"))
    # All scores depend on the combination alone: they are worked out once for each, and rows only look theirs up.
    combos = base.groupBy("__c", "__l").agg(F.count("*").alias("n"))
    each = combos.select("__c", "n", F.explode("__l").alias("__x"))
    rare = each.groupBy("__x").agg(F.sum("n").alias("m")).select("__x", ((1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.col("m").cast("double")))).alias("__r"))
    single = each.join(rare, "__x").groupBy("__c").agg(F.avg("__r").alias("single"))
    span = combos.agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    combo = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.log1p("hi") - F.log1p("n")) / F.nullif(F.log1p("hi") - F.log1p("lo"), F.lit(0.0)))
    both = combos.join(F.broadcast(span)).select("__c", combo.alias("combo")).join(single, "__c", "left").withColumn("single", F.coalesce("single", F.lit(0.0)))  # one row
    both = both.withColumn("tail", (1 - F.lit(mix)) * F.col("single") + F.lit(mix) * F.col("combo"))
    ends = both.agg(F.min("tail").alias("lo"), F.max("tail").alias("hi"))
    score = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("tail") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    scored = both.join(F.broadcast(ends)).select("__c", "single", "combo", "tail", score.alias("score"))  # one row
    return base.select(key, "__c").join(scored, "__c").select(key, "single", "combo", "tail", "score")


def tail_level(score: Column) -> Column:
    out = F.lit(dims.TAIL_LEVELS[0][1])
    for low, name in dims.TAIL_LEVELS[1:]:
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def tail_bins(scores: DataFrame, score: str = "score") -> DataFrame:
    """(bin, n, share): ten bins of width 0.1, the last one closed."""
    counts = scores.groupBy(F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("all")).alias("share"))


def with_tail_metadata(rows: DataFrame, table: DataFrame, answer: str, diagnosis: str) -> DataFrame:
    """``rows`` with level and score of ``table`` (ord, description, diseases, aug_level, TailScore): by the report text, else
    by the diagnosis, else weak and 0. The first entry of the table wins for either key; a match counts even if its values
    are the defaults."""
    level = F.when(strip(or_empty(F.col("aug_level"))) == "", F.lit("weak")).otherwise(strip(or_empty(F.col("aug_level"))))
    meta = table.select("ord", normalized_report(F.col("description")).alias("d"), strip(or_empty(F.col("diseases"))).alias("x"), F.struct(level.alias("level"), F.coalesce(F.col("TailScore").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
    first = lambda k, out: meta.where(F.col(k) != "").groupBy(F.col(k).alias(f"__{k}")).agg(F.min_by("m", "ord").alias(out))
    keyed = rows.withColumn("__d", normalized_report(F.col(answer))).withColumn("__x", strip(or_empty(F.col(diagnosis))))
    joined = keyed.join(first("d", "__by_text"), "__d", "left").join(first("x", "__by_label"), "__x", "left")
    found = F.coalesce("__by_text", "__by_label", F.struct(F.lit("weak").alias("level"), F.lit(0.0).alias("score")))
    return joined.withColumn("__m", found).select(*rows.columns, F.col("__m.level").alias("aug_level"), F.col("__m.score").alias("tail_score"))


def base_rows(rows: DataFrame, fixed6) -> DataFrame:
    """Original rows of an augmented split; ``fixed6`` makes text with six decimals."""
    return rows.select("img_id", "image_path", "answer", "institution_name", "diagnosis", F.lit("0").alias("is_augmented"), "aug_level", fixed6(F.col("tail_score")).alias("tail_score"), F.lit("").alias("aug_ops"), F.col("img_id").alias("source_img_id"))


def policies(level: Column) -> Column:
    """struct(target, batch, copies) of a level; unknown levels are weak."""
    out = None
    for name, (total, batch, copies) in dims.POLICIES.items():
        value = F.struct(F.lit(total - 1).alias("target"), F.lit(batch).alias("batch"), F.lit(copies).alias("copies"))
        out = value if out is None else F.when(level == name, value).otherwise(out)
    return out


def attempts(sources: DataFrame, key: str, level: str, most: int = 8) -> DataFrame:
    """One row for each attempt that a source may make: key, level, target, copies, attempt and its batch."""
    rows = sources.withColumn("__p", policies(F.col(level))).where("__p.target > 0 AND __p.batch > 0")
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.greatest("__p.target", "__p.batch") * most - 1)))
    return rows.select(*sources.columns, F.col("__p.target").alias("target"), F.col("__p.copies").alias("copies"), "attempt", F.floor(F.col("attempt") / F.col("__p.batch")).cast("int").alias("batch"))


def quota_outcomes(tried: DataFrame, key: str, passes: Column) -> DataFrame:
    """``tried`` attempts that are made, with ``event``: accepted, unused_accepted or rejected, and ``nth`` accepted.

    Batches go on until the target-th pass or the last attempt; a batch is always made whole. Windows are over one
    source's attempts, whose number the policy bounds.
    """
    by_source = Window.partitionBy(key).orderBy("attempt")
    counted = tried.withColumn("__ok", passes).withColumn("nth", F.sum(F.col("__ok").cast("int")).over(by_source))
    last = F.coalesce(F.min(F.when(F.col("__ok") & (F.col("nth") == F.col("target")), F.col("batch"))).over(Window.partitionBy(key)), F.max("batch").over(Window.partitionBy(key)))
    event = F.when(F.col("__ok") & (F.col("nth") <= F.col("target")), F.lit("accepted")).when(F.col("__ok"), F.lit("unused_accepted")).otherwise(F.lit("rejected"))
    return counted.withColumn("__last", last).where("batch <= __last").withColumn("event", event).drop("__last", "__ok")


def candidate_id(key: Column, attempt: Column) -> Column:
    return F.concat(key, F.format_string("__aug%03d", attempt))


def candidate_seed(seed: int, index: Column, attempt: Column) -> Column:
    return F.lit(seed) + index * 100_000 + attempt


def oversampled(accepted: DataFrame, key: str, identity: str) -> DataFrame:
    """Copies of accepted rows (key, nth, copies, identity): ids end in __osRR_NNN and ``ops`` says which copy it is."""
    copies = accepted.where("copies > 1").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("copies") - 1)))
    return copies.select(key, F.format_string("%s__os%02d_%03d", F.col(identity), F.col("repeat"), F.col("nth")).alias("img_id"), F.format_string("oversample_copy_%02d", F.col("repeat")).alias("ops"), F.col(identity).alias("copy_of"))


def counters(outcomes: DataFrame, sources: DataFrame, level: str) -> DataFrame:
    """(counter, n): how often each event occurs at each level, with candidates, copies of accepted rows and what falls short of the targets; none of 0.

    ``outcomes`` are counted once, by level; all counters come from that row a level.
    """
    of = lambda event: F.count_if(F.col("event") == event)
    counted = {"accepted": of("accepted"), "unused_accepted": of("unused_accepted"), "rejected": of("rejected"), "candidate": F.count("*"), "oversampled": F.coalesce(F.sum(F.when(F.col("event") == "accepted", F.col("copies") - 1)), F.lit(0))}
    made = outcomes.groupBy(F.col(level).alias("__made")).agg(*[c.alias(n) for n, c in counted.items()])
    wanted = sources.groupBy(level).agg(F.sum(policies(F.col(level))["target"]).alias("__wanted"))
    both = wanted.join(made, F.col(level) == F.col("__made"), "left").withColumn("shortfall", F.col("__wanted") - F.coalesce("accepted", F.lit(0)))
    each = F.array(*[F.struct(F.concat_ws("_", F.lit(n), level).alias("counter"), F.col(n).cast("long").alias("n")) for n in (*counted, "shortfall")])
    return both.select(F.inline(each)).where("n > 0")

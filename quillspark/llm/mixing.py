"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

MARGINS = ("source", "lang", "topic")
TEMPERATURE = 0.7
BUDGET = 0.8
#: Rounds end when no margin is off by more than TOLERANCE, or when a round lowers what it is off by less than SETTLED.
ROUNDS = 100
TOLERANCE = 1e-6
SETTLED = 0.01
#: Rounds of one job over a few cells.
ROUNDS_AT_ONCE = 4
BROADCAST_CELLS = 100_000
MISSING = "(none)"


def words_in(text: Column) -> Column:
    """Number of words (runs without white space) of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by the signs that a whole text holds: code, data, shout, prose or empty."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda signs: F.length(F.translate(text, signs, "")) < size * F.lit(0.97)
    return (
        F.when(text.isNull() | (F.length(text) == 0), F.lit("empty"))
        .when(share("{}();=<>"), F.lit("code"))
        .when(share("0123456789"), F.lit("data"))
        .when(share("!?#$%&*"), F.lit("shout"))
        .otherwise(F.lit("prose"))
    )


def targets(cells: DataFrame, temperature: float = TEMPERATURE) -> dict[str, DataFrame]:
    """For each margin (value, share): its token shares to the power of ``temperature``, made to sum to 1."""
    out = {}
    for m in MARGINS:
        sums = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0").withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
        total = sums.agg(F.sum("w").alias("total"))
        out[m] = cut(sums.join(F.broadcast(total)).select("value", (F.col("w") / F.col("total")).alias("share")), "target")
    return out


def given_targets(cells: DataFrame, given: DataFrame, margin: str) -> DataFrame:
    """Shares (value, share) that the caller wants for a margin, of the values that the cells hold, made to sum to 1."""
    there = cells.where("tokens > 0").select(F.col(margin).alias("value")).distinct()
    shares = given.select(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias("value"), F.col("share").cast("double").alias("share"))
    shares = cut(shares.where("share > 0").groupBy("value").agg(F.sum("share").alias("share")).join(there, "value", "left_semi"), "target")
    return cut(shares.join(F.broadcast(shares.agg(F.sum("share").alias("total")))).select("value", (F.col("share") / F.col("total")).alias("share")), "target")


def _scaled(now: DataFrame, margin: str, few: bool) -> DataFrame:
    """``now`` with weights scaled to a margin's shares, and off raised to what it was off by. Few cells stay in one task
    without an exchange; else masses are summed in parts and joined back."""
    if few:
        now = now.select("*", F.sum("weight").over(Window.partitionBy(margin)).alias("mass"))
    else:
        now = now.join(now.groupBy(margin).agg(F.sum("weight").alias("mass")), margin)
    share = F.col(f"share_{margin}")
    own = [c for c in now.columns if c not in ("weight", "off", "mass")]
    return now.select(*own, (F.col("weight") * share / F.col("mass")).alias("weight"), F.greatest("off", F.abs(share - F.col("mass"))).alias("off"))


def rake(cells: DataFrame, wanted: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """Cells (source, lang, topic, tokens) with weight, their token mass fitted to the margins in turn; and the residual.

    In each round every margin's mass is compared with its share of the whole and the cells are scaled by the ratio. It
    ends once no margin is off by more than ``tolerance``, once rounds hardly bring it nearer (margins that contradict each
    other, as where a source has one language only, settle at the last fitted), or after ``rounds``. The residual is the
    most that a margin was off in the last round. Values without target keep no mass.
    """
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        now = now.join(wanted[m].select(F.col("value").alias(m), F.col("share").alias(f"share_{m}")), m)
    now = cut(now.withColumn("off", F.lit(0.0)), "raked")
    few, residual, k = now.count() <= BROADCAST_CELLS, 0.0, 0
    at_once = ROUNDS_AT_ONCE if few else 1
    while k < rounds:
        now = now.coalesce(1) if few else now
        for _ in range(min(at_once, rounds - k)):
            now = now.withColumn("off", F.lit(0.0))
            for m in MARGINS:
                now = _scaled(now, m, few)
            k += 1
        now = cut(now, "raked")
        before, residual = residual, now.agg(F.max("off")).first()[0] or 0.0
        # The first rounds start from counts, not shares.
        if residual <= tolerance or k > 2 * at_once and residual > (1 - SETTLED) ** at_once * before:
            break
    return now.select(*MARGINS, "tokens", "weight"), residual


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """Cells with p, the chance of each of their documents: the same factor on weight / tokens everywhere, cut at 1, so
    that the expected tokens are ``budget`` of all.

    The factor lies between the cells' smallest and largest tokens / weight. It is bracketed in logarithmic steps by sums
    over the table of cells, so one extreme cell takes nothing from the others' precision, and then solved for the cells
    that the bracket cuts at 1.
    """
    ratio = F.col("weight") / F.col("tokens")
    total, least, most = raked.where("weight > 0").agg(F.sum("tokens"), F.min(1 / ratio), F.max(1 / ratio)).first()
    if not total:
        return raked.withColumn("p", F.lit(0.0))
    all_tokens = raked.agg(F.sum("tokens")).first()[0]
    lo, hi, steps = math.log(least) - 1e-9, math.log(most) + 1e-9, 24
    lo = min(lo, math.log(budget * all_tokens) if budget > 0 else lo)  # below it no cell is cut, and the weights sum to 1
    for _ in range(3):
        at = [lo + (hi - lo) * k / steps for k in range(steps + 1)]
        each = raked.select("tokens", ratio.alias("ratio"), F.posexplode(F.array(*[F.lit(math.exp(x)) for x in at])).alias("k", "factor"))
        sums = {r["k"]: r["s"] for r in each.groupBy("k").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * F.col("factor"))).alias("s")).collect()}
        k = max(k for k in range(steps + 1) if k == 0 or sums[k] <= budget * all_tokens)
        lo, hi = at[k], at[min(steps, k + 1)]
    certain, open_ = raked.agg(F.coalesce(F.sum(F.when(ratio * math.exp(lo) >= 1, F.col("tokens"))), F.lit(0)), F.sum(F.when(ratio * math.exp(lo) < 1, F.col("weight")))).first()
    factor = min(max((budget * all_tokens - certain) / open_, math.exp(lo)), math.exp(hi)) if open_ else math.exp(hi)
    return raked.withColumn("p", F.least(F.lit(1.0), ratio * factor))


#: Columns that ``weigh`` adds.
ADDED = ("topic", "tokens", "weight", "p", "sampled", "residual")


def weigh(documents: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = 0, wanted: dict[str, DataFrame] | None = None, returned: list[str] | None = None) -> DataFrame:
    """``documents`` (doc_id, text, lang, source, further columns) with topic, tokens, weight, p, sampled and residual.

    ``wanted`` gives target shares (value, share) for any of the margins source, lang and topic; the others' are their
    token shares to the power of ``temperature``. ``returned`` names the columns to return beside the added ones, by default all.
    Texts are looked at once: what is needed of them is written with the returned columns. Each document gets its cell's
    ``weight`` per token and is ``sampled`` if a hash of its id and text, uniform in 0 to 1, lies below p; ``residual``, the
    same in all rows, is what the margins were off by at the end of the fit.

    Tokens are words of whole texts, however long. A null source or language is a value of its own; a null text counts as
    empty. Documents without words carry no mass: p is 0. Repeated rows are sampled alike. An empty table gives an
    empty result. Columns of the added names are replaced; other names may be any. The table of cells joins by broadcast after a
    count, else shuffled.
    """
    names = [c for c in (returned or documents.columns) if c not in ADDED]
    text, own = F.col("text"), F.struct(*map(quoted, names))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # The documents' own columns lie in a struct, where no name can clash.
    keyed = cut(documents.select(own.alias("row"), value("source").alias("source"), value("lang").alias("lang"), topic_of(text).alias("topic"), words_in(text).alias("tokens"), draw.alias("draw")), "keyed")
    cells = cut(keyed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    shares = targets(cells, temperature) | {m: given_targets(cells, t, m) for m, t in (wanted or {}).items()}
    raked, residual = rake(cells, shares)
    cell = cut(calibrate(raked, budget).select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("weight"), "p"), "fitted")
    if cell.count() <= BROADCAST_CELLS:
        cell = F.broadcast(cell)
    chance = F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0))
    joined = keyed.join(cell, list(MARGINS), "left").withColumn("p", chance)
    added = {"topic": F.col("topic"), "tokens": F.col("tokens"), "weight": F.coalesce("weight", F.lit(0.0)), "p": F.col("p"), "sampled": F.col("draw") < F.col("p"), "residual": F.lit(residual)}
    return joined.select(*[F.col("row")[c].alias(c) for c in names], *[added[c].alias(c) for c in ADDED])

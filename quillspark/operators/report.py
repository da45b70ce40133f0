"""Report text from wide measurement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, wording
from ..functions.text import one_decimal, safe_int


def total_of(prefix: str) -> Column:
    return sum((safe_int(F.col(prefix + q)) for q in dims.QUADRANTS[1:]), safe_int(F.col(prefix + dims.QUADRANTS[0])))


def mask_of(prefix: str) -> Column:
    """The quadrants with a count above 0, a bit each."""
    return sum((F.when(safe_int(F.col(prefix + q)) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, q in enumerate(dims.QUADRANTS)), F.lit(0))


def counted_code(prefix: str) -> Column:
    """Code of where and how many, see ``wording.LEVELS``; NONE if the total isn't above 0."""
    total = total_of(prefix)
    level = F.when(total < 5, F.lit(wording.LEVELS.index(dims.FEW))).when(total > 50, F.lit(wording.LEVELS.index(dims.MANY))).otherwise(F.lit(0))
    return F.when(total > 0, mask_of(prefix) * len(wording.LEVELS) + level).otherwise(F.lit(wording.NONE))


def code_of(name: str) -> Column:
    """Code of a clause of ``wording.CODES``."""
    if name == dims.LASER:
        return (total_of(name) > 0).cast("int")
    return counted_code(name) if any(name == p for p, *_ in dims.COUNTED) else (safe_int(F.col(name)) > 0).cast("int")


def report_text(parameter: DataFrame, ratio_format=None) -> DataFrame:
    """(img_id, description, institution_name, img_path) of ``parameter`` rows.

    Five sections of clauses in fixed order, each clause once a section; labels add their clauses in their own order;
    the diagnosis line lists known labels by rank. ``ratio_format`` makes text of the ratio, by default ``one_decimal``.
    """
    ratio_text = (ratio_format or one_decimal)(F.col("ratiocdv").cast("double"))
    codes = [*map(code_of, wording.CODES), mask_of("bloodnumberdistribution_"), safe_int(F.col("arteriovenouscrossingnumber"))]
    text = wording.report_words()(F.array(*[c.cast("long") for c in codes]), ratio_text, F.coalesce("tags", F.array().cast("array<string>")))
    return parameter.select("img_id", text.alias("description"), "institution_name", "img_path")

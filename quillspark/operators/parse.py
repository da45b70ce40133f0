"""Structure of a description: findings, places, level buckets and the cup-to-disc ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structure import parsed_report

FIELDS = ("norm", "description", "diagnosis", "labels", "format", "findings", "places", "buckets", "ratio")


def parsed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>`` norm, description, diagnosis, labels, format, findings, places, buckets (array of key, bucket) and ratio of a report.

    ``column`` holds raw reports over the restricted alphabet (see ``text.normalized``); null counts as empty.
    Findings and places are sorted sets, a key's last bucket and the last ratio count.
    """
    found = df.select("*", parsed_report()(F.col(column)).alias("__parsed"))
    return found.select(*df.columns, *[F.col(f"__parsed.{name}").alias(f"{prefix}{name}") for name in FIELDS])

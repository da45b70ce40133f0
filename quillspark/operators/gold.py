"""The gold side of scoring, parsed once and stored where completions meet it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import names
from .reward import gold_fields, scored_against_gold


class StoredGold:
    """Gold fields of true reports by a key, as a bucketed and sorted table under ``root``.

    ``write`` parses the truths once. ``scored`` moves completions alone: they are dealt as the table's buckets are, each meets its gold in a merge of sorted rows, and
    no truth is parsed or exchanged again. Equal completions for the same key are scored once. A key has one truth: the first by its text, if several are written.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key"):
        self.spark, self.root, self.key, self.tables = spark, root.rstrip("/"), key, []

    def _name(self) -> str:
        self.tables.append(f"gold_{uuid.uuid4().hex}")
        return self.tables[-1]

    def write(self, truths: DataFrame, truth: str, buckets: int | None = None) -> None:
        """Store the gold of ``truths`` (key, truth); null keys go, as nothing meets them."""
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        once = truths.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(truth).alias(truth))
        gold = gold_fields(once, truth).drop(truth)
        gold.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.root}/buckets-{buckets}").saveAsTable(self._name())

    def table(self) -> DataFrame:
        found = [n for n in names(self.spark, self.root) if re.fullmatch("buckets-[0-9]+", n)]
        if not found:
            raise FileNotFoundError(f"no gold under {self.root}")
        path, buckets, name = f"{self.root}/{found[0]}", int(found[0].split("-")[1]), self._name()
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def scored(self, completions: DataFrame, completion: str) -> DataFrame:
        """The different ``completions`` (key, completion) of each key with how often each occurs (``times``) and the eight measures against its gold; completions
        without a gold are left out."""
        once = completions.groupBy(self.key, completion).agg(F.count("*").alias("times"))
        met = once.join(self.table().hint("merge"), self.key)
        kept = [self.key, completion, "times"]
        found = scored_against_gold(met, completion)
        return found.select(*kept, *[c for c in found.columns if c not in met.columns])

    def close(self) -> None:
        """Forget the catalog's names of the table; its files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

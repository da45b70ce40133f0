"""Outputs of long runs that can be interrupted, resumed and replaced: rows and settings become visible together, by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.resume import output_mode
from .files import delete, exists, names, publish


class Taken(RuntimeError):
    """Another run has published its rows in the meantime; nothing of this one counts."""


class RunOutput:
    """The output of runs with the same settings under ``root``.

    ``parts/<id>/`` holds the rows of one write, ``state/v<n>/`` one document: the settings and the parts that make up version n. A part that no document
    names doesn't count, so rows and settings are published together by the rename that gives a document's folder its name, and an interrupted
    write leaves the version before as it was. Readers keep their version; its parts go when the next but one is published.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in names(self.spark, f"{self.root}/state") if n[:1] == "v" and n[1:].isdigit())

    def state(self, version: int | None = None) -> dict | None:
        """{"settings", "parts"} of a version, by default the last; None if there is none."""
        known = self._versions()
        if not known:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/state/v{known[-1] if version is None else version}", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        """The rows of the last version; None if there is none."""
        state = self.state()
        return self.spark.read.parquet(*[f"{self.root}/parts/{p}" for p in state["parts"]]) if state else None

    def run(self, tasks: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], settings: dict, resume: bool = False, overwrite: bool = False) -> int:
        """Write ``work(tasks)`` as a new version and return its number.

        Where there is a version: an error unless told to ``overwrite`` it, or to ``resume`` it, which needs the same settings and hands ``work`` only the tasks
        whose key has no row yet. Both at once are an error.
        """
        if resume and overwrite:
            raise ValueError("resume or overwrite, not both")
        known, saved = self._versions(), self.state()
        mode = output_mode(saved is not None, saved and saved["settings"], settings, resume, overwrite)
        kept = saved["parts"] if mode == "resume" else []
        if mode == "resume":
            tasks = tasks.join(self.read().select(key).distinct(), key, "left_anti")
        part = uuid.uuid4().hex
        work(tasks).write.parquet(f"{self.root}/parts/{part}")
        private, number = f"{self.root}/state/_{part}", (known or [0])[-1] + 1
        document = json.dumps({"settings": settings, "parts": [*kept, part]}, sort_keys=True, ensure_ascii=False)
        self.spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(private)
        if not publish(self.spark, private, f"{self.root}/state/v{number}"):
            delete(self.spark, f"{self.root}/parts/{part}")
            raise Taken(f"version {number} is there")
        self._forget([v for v in known if v < number - 1], {*kept, part, *(saved["parts"] if saved else [])})
        return number

    def _forget(self, old: list[int], live: set[str]) -> None:
        """Delete parts of old versions that no later one names. Documents stay, so that no number is given twice."""
        for version in old[-1:]:
            for part in set(self.state(version)["parts"]) - live:
                if exists(self.spark, f"{self.root}/parts/{part}"):
                    delete(self.spark, f"{self.root}/parts/{part}")

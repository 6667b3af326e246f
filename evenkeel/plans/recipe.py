"""Ordered preprocessing steps over an untouched source."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from evenkeel.session import cut_lineage


@dataclass
class Recipe:
    """Steps applied to a raw DataFrame; any change drops what was derived from the old result."""

    raw: DataFrame
    actions: list[str] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)       # rows of raw and of the frames counted so far
    encodings: dict[str, dict[str, int]] = field(default_factory=dict)
    derived: dict[str, object] = field(default_factory=dict)

    @property
    def current(self) -> DataFrame:
        return self.frames[-1] if self.frames else self.raw

    def apply(self, action: str, step: Callable[[DataFrame], DataFrame]) -> "Recipe":
        self.frames.append(step(self.current))
        self.steps.append(step)
        self.actions.append(action)
        self.derived.clear()
        return self

    def reset(self) -> "Recipe":
        for part in (self.actions, self.frames, self.steps, self.sizes, self.encodings, self.derived):
            part.clear()
        return self

    def key(self) -> str:
        return hashlib.sha256("\n".join(self.actions).encode()).hexdigest()[:24]

    def log(self) -> DataFrame:
        """(step_no, action, rows_before, rows_after).

        Each step not counted yet is written once, from the written result of the step before it, and counted from the
        files' footers; the recipe goes on from there. k steps take k passes and the count of the raw table.
        """
        spark = self.raw.sparkSession
        if self.actions and not self.sizes:
            self.sizes.append(self.raw.count())
        for k in range(max(0, len(self.sizes) - 1), len(self.actions)):
            self.frames[k] = cut_lineage(self.steps[k](self.frames[k - 1] if k else self.raw))
            self.sizes.append(self.frames[k].count())
        rows = [(i + 1, a, self.sizes[i], self.sizes[i + 1]) for i, a in enumerate(self.actions)]
        return spark.createDataFrame(rows, "step_no int, action string, rows_before long, rows_after long")


class Workspace:
    """Loads a table once per content and starts a fresh recipe whenever the content changed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.signature, self.target, self.recipe = spark, None, None, None

    def load(self, path: str, fmt: str = "csv") -> Recipe:
        from evenkeel.sources.tables import content_fingerprint, read_table

        signature = content_fingerprint(self.spark, path, fmt).first()[0]
        if signature != self.signature:
            self.recipe, self.target = Recipe(read_table(self.spark, path, fmt)), None
            self.signature = signature
        return self.recipe

"""Counts, sums and products of all pairs of columns on their complete rows, as mergeable matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PARTIAL = "i int, n array<double>, s array<double>, q array<double>, p array<double>"


class CoMoments:
    """For columns i and j, over the rows that have both: n rows, s sum of i, q sum of squares of i, p sum of products."""

    def __init__(self, width: int):
        self.n, self.s, self.q, self.p = (np.zeros((width, width)) for _ in range(4))

    def add(self, rows: np.ndarray) -> None:
        """rows x columns, NaN where a value is missing."""
        there = ~np.isnan(rows)
        mask, x = there.astype(float), np.where(there, rows, 0.0)
        self.n += mask.T @ mask
        self.s += x.T @ mask
        self.q += (x * x).T @ mask
        self.p += x.T @ x

    def batch(self) -> pa.RecordBatch:
        """One row a column: a few numbers a pair, whatever the number of rows."""
        columns = [pa.array(np.arange(len(self.n), dtype=np.int32))]
        columns += [pa.array(list(m), pa.list_(pa.float64())) for m in (self.n, self.s, self.q, self.p)]
        return pa.RecordBatch.from_arrays(columns, names=["i", "n", "s", "q", "p"])


def summed(partial: DataFrame, width: int) -> CoMoments:
    """The matrices of all tasks (rows of PARTIAL) added up in Spark; one row a pair reaches the driver."""
    cells = partial.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "c"))
    out = CoMoments(width)
    for r in cells.groupBy("i", "j").agg(*[F.sum(f"c.{m}").alias(m) for m in "nsqp"]).collect():
        for m in "nsqp":
            getattr(out, m)[r["i"], r["j"]] = r[m]
    return out


def co_moments(nums: DataFrame, shift: Sequence[float]) -> CoMoments:
    """All columns of nums (doubles, NULL for missing), each less its shift, in one pass and one small shuffle.

    Shifts near the means keep the sums small, so that columns far from 0 lose no digits.
    """
    away = np.array(shift, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = CoMoments(len(away))
        for batch in batches:
            if batch.num_rows:
                total.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - away)
        yield total.batch()

    return summed(nums.mapInArrow(run, PARTIAL), len(away))


def pearson(m: CoMoments, i: int, j: int) -> tuple[float | None, bool]:
    """The correlation, and whether its digits are sure: a variance far below its terms may be rounding alone."""
    n = m.n[i, j]
    if n < 2:
        return None, True
    a, b = m.q[i, j] - m.s[i, j] ** 2 / n, m.q[j, i] - m.s[j, i] ** 2 / n
    sure = a > 1e-9 * m.q[i, j] and b > 1e-9 * m.q[j, i]
    if m.q[i, j] == 0 or m.q[j, i] == 0:                       # all values equal the shift
        return None, True
    if a <= 0 or b <= 0:
        return None, False
    return float((m.p[i, j] - m.s[i, j] * m.s[j, i] / n) / (a * b) ** 0.5), bool(sure)

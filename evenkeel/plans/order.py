"""Global order without a one-task window: cut points, running totals, exact quantiles.

Rows are bucketed by explicit cut points, so each window holds a bounded slice however
skewed the groups are; per-bucket totals (a few numbers per group) carry the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from evenkeel.functions.scalars import as_column, to_number

BUCKET_ROWS = 200_000       # rows one window slice should hold
MAX_BUCKETS = 1 << 16
SKETCH = 10_000             # percentile_approx accuracy
BRACKET_ROWS = 200_000      # distinct values one bracket may hold before it is narrowed


def cut_points(df: DataFrame, order: str, bucket_rows: int = BUCKET_ROWS,
               max_buckets: int = MAX_BUCKETS) -> list:
    """Ascending cuts that split `order` into slices of about `bucket_rows` rows.

    Cuts only balance the work, so a hash sample of some 200 rows per slice is enough.
    """
    n = df.count()
    buckets = min(max_buckets, MAX_BUCKETS, math.ceil(n / bucket_rows))
    if buckets < 2:
        return []
    fraction = min(1.0, max(200 * buckets, 20_000) / n)
    sample = df.select(order).where(F.col(order).isNotNull())
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=1)
    if isinstance(df.schema[order].dataType, T.StringType):
        ranked = sample.groupBy(order).count().orderBy(order).collect()  # bounded by the sample
        step, seen, texts = sum(r["count"] for r in ranked) / buckets, 0, []
        for r in ranked:
            if seen >= step * (len(texts) + 1):
                texts.append(r[order])
            seen += r["count"]
        return texts
    probs = [(i + 1) / buckets for i in range(buckets - 1)]
    return rising(sample.agg(F.percentile_approx(order, probs, max(SKETCH, 10 * buckets))).first()[0] or [])


def rising(values: Sequence[float]) -> list[float]:
    """Quantiles as strictly rising cuts; a hot value, met twice, gets a slice of its own."""
    cuts: list[float] = []
    for v in map(float, values):
        if not cuts or v > cuts[-1]:
            cuts.append(v)
        elif v == cuts[-1]:
            cuts.append(float(np.nextafter(v, np.inf)))
    return cuts


def cuts_of_all(nums: DataFrame, n: int, bucket_rows: int, max_buckets: int = MAX_BUCKETS) -> dict[str, list[float]]:
    """cut_points of every (numeric) column of nums, in one pass; n is the number of rows."""
    buckets = min(max_buckets, MAX_BUCKETS, math.ceil(n / bucket_rows))
    if buckets < 2:
        return {c: [] for c in nums.columns}
    fraction = min(1.0, max(200 * buckets, 20_000) / n)
    sample = nums.sample(fraction, seed=1) if fraction < 1.0 else nums
    probs = [(i + 1) / buckets for i in range(buckets - 1)]
    got = sample.agg(*[F.percentile_approx(c, probs, max(SKETCH, 10 * buckets)).alias(c) for c in nums.columns]).first()
    return {c: rising(got[c] or []) for c in nums.columns}


def with_bucket(df: DataFrame, order: str, cuts: list, name: str = "_bucket") -> DataFrame:
    """Add the index of the slice [cut, next cut) that holds `order`."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    if isinstance(cuts[0], str):
        edges = np.array(cuts, dtype=object)

        @F.pandas_udf("int")
        def slot(s: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, s.fillna("").to_numpy(dtype=object), side="right"))

        return df.withColumn(name, slot(F.col(order)))
    raw = name + "_raw"
    splits = [-math.inf, *cuts, math.inf]
    sliced = Bucketizer(splits=splits, inputCol=raw, outputCol=raw + "_out", handleInvalid="keep").transform(
        df.withColumn(raw, F.col(order).cast("double")))
    return sliced.withColumn(name, F.col(raw + "_out").cast("int")).drop(raw, raw + "_out")


def prefix_sum(df: DataFrame, order: str, weight: str | Sequence[str], group: Sequence[str] = (), *,
               before: str | Sequence[str] = "before", total: str | Sequence[str] = "total",
               cuts: list | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Running total of each weight over rows strictly below, and its group total.

    Rows must be unique per (group, order): pre-aggregate first. Without `cuts`, `df` is read to plan
    them, so pass something cheap to read or the cuts of the source column.
    """
    weights, befores, totals = ([x] if isinstance(x, str) else list(x) for x in (weight, before, total))
    group = list(group)
    if cuts is None:
        cuts = cut_points(df, order, bucket_rows)
    part = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    if not cuts:
        below = part.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(w).over(below), F.lit(0)).alias(b) for w, b in zip(weights, befores)],
                         *[F.sum(w).over(part).alias(t) for w, t in zip(weights, totals)])
    sliced = with_bucket(df, order, cuts)
    sums = sliced.groupBy(*group, "_bucket").agg(*[F.sum(w).alias(f"_sum{i}") for i, w in enumerate(weights)])
    earlier = part.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_offset{i}") for i in range(len(weights))],
        *[F.sum(f"_sum{i}").over(part).alias(t) for i, t in enumerate(totals)])
    on = sliced["_bucket"] == offsets["_b"]
    for i, g in enumerate(group):
        on = on & sliced[g].eqNullSafe(offsets[f"_g{i}"])
    inside = W.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (sliced.join(offsets, on)
            .select("*", *[(F.col(f"_offset{i}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(b)
                           for i, (w, b) in enumerate(zip(weights, befores))])
            .drop("_bucket", "_b", *[f"_offset{i}" for i in range(len(weights))], *[f"_g{i}" for i in range(len(group))]))


def number_rows(df: DataFrame, order: str, name: str = "idx", group: Sequence[str] = (),
                bucket_rows: int = BUCKET_ROWS, cuts: list | None = None) -> DataFrame:
    """0-based position by `order` (unique per group) without a one-task window."""
    return (prefix_sum(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", group, before=name,
                       total="_total", bucket_rows=bucket_rows, cuts=cuts)
            .drop("_one", "_total"))


def rank_to_value(n: int, prob: float) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of a linear-interpolated quantile."""
    pos = prob * (n - 1)
    lo = math.floor(pos)
    return lo, min(lo + 1, n - 1), pos - lo


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], bracket_rows: int = BRACKET_ROWS,
                    sketch: int = SKETCH, moments: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of many columns, without shuffling the rows.

    `moments`, if given, is filled with count, min, max, mean and std per column from the same first pass.

    A mergeable sketch brackets each quantile, and only the distinct values inside the bracket are
    counted. A bracket that would still hold too many rows is narrowed by another sketch pass.
    """
    cols = list(wanted)
    nums = df.select(*[to_number(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    margin = 2.0 / sketch
    aggs = []
    for i, c in enumerate(cols):
        probs = sorted({min(1.0, max(0.0, p + s)) for p in wanted[c] for s in (-margin, margin)})
        aggs += [F.count(f"c{i}").alias(f"n{i}"),
                 F.percentile_approx(f"c{i}", probs, sketch).alias(f"q{i}"),
                 F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}")]
        if moments is not None:
            aggs += [F.avg(f"c{i}").alias(f"mean{i}"), F.stddev_samp(f"c{i}").alias(f"std{i}")]
    first = nums.agg(*aggs).first()
    if moments is not None:
        for i, c in enumerate(cols):
            moments[c] = {"count": first[f"n{i}"], "min": first[f"lo{i}"], "max": first[f"hi{i}"],
                          "mean": first[f"mean{i}"], "std": first[f"std{i}"]}
    brackets = []                                    # column index, probability, low, high
    for i, c in enumerate(cols):
        if not first[f"n{i}"]:
            continue
        probs = sorted({min(1.0, max(0.0, p + s)) for p in wanted[c] for s in (-margin, margin)})
        at = dict(zip(probs, first[f"q{i}"]))
        for p in wanted[c]:
            low = first[f"lo{i}"] if p - margin <= 0 else at[p - margin]
            high = first[f"hi{i}"] if p + margin >= 1 else at[p + margin]
            brackets.append((i, p, low, high))
    rows_inside = max([first[f"n{i}"] for i in range(len(cols))] or [0]) * 4 / sketch
    while rows_inside > bracket_rows:
        brackets = _narrow(nums, brackets, {i: first[f"n{i}"] for i in range(len(cols))}, sketch)
        rows_inside *= 4 / sketch
    found = _resolve(nums, brackets, {i: first[f"n{i}"] for i in range(len(cols))})
    return {c: [found.get((i, p)) for p in wanted[c]] for i, c in enumerate(cols)}


def _narrow(nums: DataFrame, brackets, n: dict[int, int], sketch: int):
    """Shrink each bracket around its rank by one more counting and sketching pass."""
    counted = nums.agg(*[x for j, (i, _, lo, hi) in enumerate(brackets) for x in (
        F.count_if(F.col(f"c{i}") < F.lit(lo)).alias(f"below{j}"),
        F.count_if(F.col(f"c{i}").between(lo, hi)).alias(f"in{j}"))]).first()
    aggs, asked = [], {}
    for j, (i, p, lo, hi) in enumerate(brackets):
        rank, up, _ = rank_to_value(n[i], p)
        inside = max(1, counted[f"in{j}"])
        near = [min(1.0, max(0.0, (r - counted[f"below{j}"]) / inside + s))
                for r, s in ((rank, -2.0 / sketch), (up + 1, 2.0 / sketch))]
        asked[j] = near
        aggs.append(F.percentile_approx(F.when(F.col(f"c{i}").between(lo, hi), F.col(f"c{i}")),
                                        near, sketch).alias(f"s{j}"))
    got = nums.agg(*aggs).first()
    out = []
    for j, (i, p, lo, hi) in enumerate(brackets):
        a, b = asked[j]
        v = got[f"s{j}"]
        out.append((i, p, lo if a <= 0 or not v else v[0], hi if b >= 1 or not v else v[1]))
    return out


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _resolve(nums: DataFrame, brackets, n: dict[int, int]) -> dict[tuple[int, float], float]:
    """Order statistics from one histogram: single values inside brackets, one group per gap between them."""
    if not brackets:
        return {}
    columns = sorted({b[0] for b in brackets})
    edges, wanted = [], {}
    for i in columns:
        spans = _merged([(float(lo), float(np.nextafter(hi, np.inf))) for j, _, lo, hi in brackets if j == i])
        edges.append([-math.inf, *[e for span in spans for e in span], math.inf])
        wanted[i] = sorted({r for j, p, _, _ in brackets if j == i for r in rank_to_value(n[i], p)[:2]})
    # odd stretches are the inside of a bracket; the search among the edges is binary
    stretch = Bucketizer(splitsArray=edges, inputCols=[f"c{i}" for i in columns],
                         outputCols=[f"g{i}" for i in columns], handleInvalid="keep").transform(nums)
    parts = [F.struct(F.lit(i).alias("i"), F.col(f"g{i}").alias("gap"),
                      F.when(F.col(f"g{i}") % 2 == 1, F.col(f"c{i}")).alias("v"), F.col(f"c{i}").alias("raw"))
             for i in columns]
    # groups are disjoint stretches of the value range, so their smallest values order them
    groups = (stretch.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("raw IS NOT NULL")
              .groupBy("i", "gap", "v").agg(F.count(F.lit(1)).alias("rows"), F.min("raw").alias("at")))
    upto = W.partitionBy("i").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ranks = F.array().cast("array<bigint>")
    for i, rs in wanted.items():
        ranks = F.when(F.col("i") == i, F.array(*[F.lit(r).cast("bigint") for r in rs])).otherwise(ranks)
    hits = (groups.withColumn("upto", F.sum("rows").over(upto))
            .where(F.exists(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("rows"))))
            .collect())                              # at most two groups per quantile
    found = {}
    for i, p, _, _ in brackets:
        low, high, frac = rank_to_value(n[i], p)
        at = {r: h["v"] for h in hits if h["i"] == i for r in (low, high) if h["upto"] - h["rows"] <= r < h["upto"]}
        if at.get(low) is None or at.get(high) is None:
            at = _by_histogram(nums, i, (low, high))     # the sketch missed its bound
        found[(i, p)] = at[low] + (at[high] - at[low]) * frac
    return found


def _by_histogram(nums: DataFrame, i: int, ranks: tuple[int, int]) -> dict[int, float]:
    hist = nums.where(F.col(f"c{i}").isNotNull()).groupBy(F.col(f"c{i}").alias("v")).agg(
        F.count(F.lit(1)).alias("rows"))
    run = prefix_sum(hist, "v", "rows")
    rows = run.where(" OR ".join(f"(before <= {r} AND before + rows > {r})" for r in ranks)).collect()
    return {r: x["v"] for r in ranks for x in rows if x["before"] <= r < x["before"] + x["rows"]}


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact quantiles per group; a hot group is spread over slices of its value range."""
    by = list(by)
    hist = (df.select(*by, as_column(value).cast("double").alias("_v")).where("_v IS NOT NULL")
            .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_rows")))
    cuts = cut_points(df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"),
                      "_v", bucket_rows)
    run = prefix_sum(hist, "_v", "_rows", by, before="_before", total="_n", cuts=cuts)

    def at(rank):
        return F.max(F.when((F.col("_before") <= rank) & (F.col("_before") + F.col("_rows") > rank), F.col("_v")))

    outs = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(pos)
        outs += [at(low).alias(f"_{name}_lo"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_{name}_hi"),
                 F.max(pos - low).alias(f"_{name}_f")]
    wide = run.groupBy(*by).agg(F.max("_n").alias("n"), *outs)
    return wide.select(*by, "n", *[
        (F.col(f"_{x}_lo") + (F.col(f"_{x}_hi") - F.col(f"_{x}_lo")) * F.col(f"_{x}_f")).alias(x) for x in names])


def skew_safe_lookup(facts: DataFrame, dim: DataFrame, key: Sequence[str], rows_col: str, total_rows: int,
                     hot_share: float = 1e-3) -> DataFrame:
    """Inner equi-join of facts with one row per key, safe when one key holds a third of the facts.

    At most 1/hot_share keys can each hold hot_share of all rows, so the hot part of the dimension has
    a proven bound and is broadcast; the cold part joins by shuffle, where no key is large.
    """
    key = list(key)
    floor_rows = max(2.0, total_rows * hot_share)
    hot = F.broadcast(dim.where(F.col(rows_col) >= floor_rows).drop(rows_col))
    cold = dim.where(F.col(rows_col) < floor_rows).drop(rows_col)
    on_hot = facts.join(hot, key)
    on_cold = facts.join(hot.select(*key), key, "left_anti").join(cold, key)
    return on_hot.unionByName(on_cold)

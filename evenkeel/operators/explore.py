"""The aggregates behind the exploratory charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.scalars import SEED, missing
from evenkeel.plans.order import grouped_quantiles, skew_safe_lookup
from evenkeel.plans.quota import sample_exact
from evenkeel.session import cut_lineage


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """Exact equal-width bins; empty bins are kept with zero rows."""
    if not 5 <= bins <= 100:
        raise ValueError("bins must lie in 5..100")
    v = F.col(f"`{x}`").cast("double")
    # NaN counts as missing and must not become the maximum
    v = F.when(~F.isnan(v), v)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n_rows long")
    width = (high - low) / bins or 1.0 / bins
    counts = (df.where(v.isNotNull())
              .groupBy(F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n_rows")))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # at most 100 rows on either side
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows")))


def _grouped(df: DataFrame, y: str, by: str | None) -> DataFrame:
    key: Column = F.col(f"`{by}`") if by else F.lit("all")
    v = F.col(f"`{y}`").cast("double")
    return df.select(key.alias("key"), F.when(~F.isnan(v), v).alias("y")).where("y IS NOT NULL")


def box_stats(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (extremes inside the 1.5 IQR fences) and outlier count per group."""
    rows = _grouped(df, y, by)
    fences = _fences(rows)
    # values are counted per group first, so a hot group is small before it meets its fences
    hist = rows.groupBy("key", "y").agg(F.count(F.lit(1)).alias("_rows"))
    met = _meet(hist, fences)
    inside = F.col("y").between(F.col("low_fence"), F.col("high_fence"))
    return (met.groupBy("key").agg(
        F.first("n").alias("n_rows"), F.first("q1").alias("q1"), F.first("med").alias("med"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("y"))).alias("whisker_low"), F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_rows"))), F.lit(0)).cast("bigint").alias("n_outliers")))


def box_outliers(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """The points beyond the fences with how often each occurs."""
    rows = _grouped(df, y, by)
    hist = rows.groupBy("key", "y").agg(F.count(F.lit(1)).alias("n_rows"))
    met = _meet(hist, _fences(rows))
    return met.where((F.col("y") < F.col("low_fence")) | (F.col("y") > F.col("high_fence"))).select("key", "y", "n_rows")


def _fences(rows: DataFrame) -> DataFrame:
    q = grouped_quantiles(rows, ["key"], "y", [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select("*", (F.col("q1") - reach).alias("low_fence"), (F.col("q3") + reach).alias("high_fence"))


def _meet(hist: DataFrame, fences: DataFrame) -> DataFrame:
    """Give each value its group's fences. Hot groups, of which there are at most a thousand, meet theirs by broadcast,
    the others by a shuffle; the group stands in a struct, so that the one without a name meets its fences too."""
    few = cut_lineage(fences.select(F.struct("key").alias("_key"), F.col("n").alias("_size"), *[c for c in fences.columns if c != "key"]))
    total = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return skew_safe_lookup(hist.withColumn("_key", F.struct("key")), few, ["_key"], "_size", total).drop("_key")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, n: int | None = None,
                   row_id: str | None = None, seed: int = SEED) -> DataFrame:
    """The x, y (and colour) pairs; with `n`, exactly n seeded points."""
    if x == y:
        raise ValueError("x and y must differ")
    keep = [F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")]
    if color:
        keep.append(F.col(f"`{color}`").alias("color"))
    if n is None:
        return df.select(*keep)
    return sample_exact(df.select(*keep, F.col(row_id).alias("_id")), n, "_id", seed).drop("_id")


def scatter_grid(df: DataFrame, x: str, y: str, cells: int = 50) -> DataFrame:
    """Point counts on an equal-width grid: the scatter plot of a table too large to draw."""
    pairs = df.select(*[F.when(~missing(df.schema[c]), F.col(f"`{c}`").cast("double")).alias(n) for c, n in ((x, "x"), (y, "y"))])
    lo_x, hi_x, lo_y, hi_y = pairs.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if lo_x is None or lo_y is None:
        return df.sparkSession.createDataFrame([], "cell_x int, cell_y int, n_rows long")

    def cell(c: str, lo, hi) -> Column:
        width = (float(hi) - float(lo)) / cells or 1.0
        return F.least(F.floor((F.col(c) - float(lo)) / width), F.lit(cells - 1)).cast("int")

    return (pairs.where("x IS NOT NULL AND y IS NOT NULL")
            .groupBy(cell("x", lo_x, hi_x).alias("cell_x"), cell("y", lo_y, hi_y).alias("cell_y"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """Rows per value as text, missing included, most frequent first."""
    shown = F.when(~missing(df.schema[x]), F.col(f"`{x}`").cast("string"))      # NaN and NULL are one missing entry
    key = F.coalesce(shown, F.lit("nan")).alias("key")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "key")


def group_aggregate(df: DataFrame, x: str, y: str, how: str = "mean") -> DataFrame:
    """mean, sum or median of y per value of x; the missing key stays a group and sorts last."""
    rows = df.select(F.col(f"`{x}`").alias("key"), F.col(f"`{y}`").cast("double").alias("y"))
    if how == "mean":
        out = rows.groupBy("key").agg(F.avg("y").alias("value"))
    elif how == "sum":
        out = rows.groupBy("key").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("value"))
    elif how == "median":
        mids = grouped_quantiles(rows, ["key"], "y", [0.5], ["value"]).withColumnRenamed("key", "_key")
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))     # keeps all-missing groups
        out = keys.join(mids, keys["key"].eqNullSafe(mids["_key"]), "left").select("key", "value")
    else:
        raise ValueError(f"unknown aggregate {how!r}")
    return out.orderBy(F.asc_nulls_last("key"))


def line_series(df: DataFrame, x: str, y: str, sort: bool = True) -> DataFrame:
    """x, y rows without missing values, by x (and y) when sorted."""
    rows = df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).dropna()
    return rows.orderBy("x", "y") if sort else rows

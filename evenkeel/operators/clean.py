"""Missing values and outliers: fit once over the whole table, then a narrow projection or filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.scalars import kind_of, missing
from evenkeel.plans.histogram import modes
from evenkeel.plans.order import exact_quantiles


def drop_missing_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def _present(df: DataFrame, c: str) -> Column:
    """The value as double, missing (NULL or NaN) left out of aggregates."""
    field = df.schema[c]
    return F.when(~missing(field), F.col(f"`{c}`").cast("double"))


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def imputation_values(df: DataFrame, cols: Sequence[str], method: str, value: str = "0") -> dict[str, object]:
    """The fill value per column; columns a method does not apply to are left out."""
    kinds = _kinds(df)
    numeric = [c for c in cols if kinds[c] in ("numeric", "boolean")]
    if method == "mean":
        row = df.agg(*[F.avg(_present(df, c)).alias(c) for c in numeric]).first() if numeric else {}
        return {c: row[c] for c in numeric if row[c] is not None}
    if method in ("median", "auto"):
        cast = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
        mids = {c: v[0] for c, v in exact_quantiles(cast, {c: [0.5] for c in numeric}).items()} if numeric else {}
        out = {c: v for c, v in mids.items() if v is not None}
        if method == "auto":
            out.update(modes(df, [c for c in cols if c not in numeric]))
        return out
    if method == "mode":
        return modes(df, cols)
    if method == "constant":
        out = {}
        for c in cols:
            try:
                out[c] = float(value) if c in numeric else value
            except ValueError:
                raise ValueError(f"{value!r} is no number, but column {c} is numeric") from None
        return out
    raise ValueError(f"unknown imputation {method!r}")


def skipped_columns(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """(column, reason): the columns that a fill leaves as they are, in the order asked for.

    Mean and median skip what is not numeric; every fit skips a column without any value; a constant skips none.
    """
    kinds = _kinds(df)
    fills = imputation_values(df, cols, method) if method != "constant" else dict.fromkeys(cols)
    rows = [(c, "not numeric" if method in ("mean", "median") and kinds[c] not in ("numeric", "boolean") else "no value")
            for c in cols if c not in fills]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")      # a row a column at most


def impute(df: DataFrame, cols: Sequence[str], method: str, value: str = "0",
           fit_on: DataFrame | None = None) -> DataFrame:
    """auto, mean, median, mode or constant fill; an all-missing column stays as it is."""
    fills = imputation_values(df if fit_on is None else fit_on, cols, method, value)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in fills:
            fill = F.lit(fills[f.name])
            kind = kind_of(f.dataType)
            if kind in ("numeric", "boolean") and isinstance(fills[f.name], float):
                # an integer or boolean column becomes double where the fill needs it
                c = F.when(~missing(f), c.cast("double")).otherwise(fill)
            else:
                c = F.when(~missing(f), c).otherwise(fill.cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float) -> dict[str, tuple[float, float]]:
    if not 1.0 <= k <= 3.0:
        raise ValueError("k must lie in 1.0..3.0")
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in cols})
    return {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in quartiles.items() if q1 is not None}


def _keep(tests: list[Column]) -> Column:
    cond = F.lit(True)
    for t in tests:
        cond = cond & t
    return cond


def filter_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, fit_on: DataFrame | None = None) -> DataFrame:
    """Rows inside the fences of every column; missing values pass."""
    bounds = iqr_bounds(df if fit_on is None else fit_on, cols, k)
    fields = {f.name: f for f in df.schema.fields}
    return df.where(_keep([missing(fields[c]) | F.col(f"`{c}`").between(lo, hi) for c, (lo, hi) in bounds.items()]))


def winsorize_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, fit_on: DataFrame | None = None) -> DataFrame:
    """Clip to the fences; missing stays missing."""
    bounds = iqr_bounds(df if fit_on is None else fit_on, cols, k)
    fields = {f.name: f for f in df.schema.fields}
    return df.withColumns({
        c: F.when(~missing(fields[c]), F.greatest(F.least(F.col(f"`{c}`").cast("double"), F.lit(hi)), F.lit(lo)))
        for c, (lo, hi) in bounds.items()})


def filter_zscore(df: DataFrame, cols: Sequence[str], t: float = 3.0, fit_on: DataFrame | None = None) -> DataFrame:
    """Rows with |z| <= t in every column (sample deviation); a constant column is skipped."""
    if not 2.0 <= t <= 5.0:
        raise ValueError("t must lie in 2.0..5.0")
    source = df if fit_on is None else fit_on
    row = source.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(_present(source, c)).alias(f"m{i}"), F.stddev_samp(_present(source, c)).alias(f"s{i}"))]).first()
    fields = {f.name: f for f in df.schema.fields}
    tests = []
    for i, c in enumerate(cols):
        if row[f"s{i}"]:
            z = F.abs((F.col(f"`{c}`") - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"]))
            tests.append(missing(fields[c]) | (z <= t))
    return df.where(_keep(tests))

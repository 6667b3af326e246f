"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.scalars import epoch_seconds, kind_of, missing
from evenkeel.operators.gates import columns_by_kind
from evenkeel.plans.histogram import column_histogram, value_text
from evenkeel.plans.order import exact_quantiles


def shape_summary(df: DataFrame) -> DataFrame:
    """rows, columns and missing cells in one pass."""
    holes = sum((F.count_if(missing(f)) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                  holes.alias("n_missing"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; missing equals missing."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_rows"))
    return groups.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing count and share, and distinct values per column.

    Exact distinct counts go through the (column, value) histogram: one shuffle for all columns.
    """
    fields = df.schema.fields
    counts = [F.count(F.lit(1)).alias("_n")] + [F.count_if(missing(f)).alias(f"m{i}") for i, f in enumerate(fields)]
    if approximate:
        counts += [F.approx_count_distinct(f"`{f.name}`").alias(f"u{i}") for i, f in enumerate(fields)]
    row = df.agg(*counts)
    per_column = row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"m{i}").alias("missing"),
                 F.bround(F.col(f"m{i}") * 100.0 / F.nullif("_n", F.lit(0)), 2).alias("missing_pct"),
                 *([F.col(f"u{i}").alias("distinct_values")] if approximate else []))
        for i, f in enumerate(fields)])).alias("c")).select("c.*")
    if approximate:
        return per_column
    distinct = column_histogram(df).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    # both sides have one row per column
    return (per_column.join(F.broadcast(distinct), "column", "left")
            .select("position", "column", "dtype", "missing", "missing_pct",
                    F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values")))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values; no distinct counts, so no shuffle of the rows."""
    return column_info(df, approximate=True).drop("distinct_values").where("missing > 0")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top (the smallest on a tie) and freq per column."""
    cols = list(cols) if cols is not None else columns_by_kind(df)[1]
    hist = column_histogram(df, cols)
    order = F.struct(-F.col("rows"), "int_value", "num_value", "text_value")
    flags = [f.name for f in df.schema.fields if f.name in cols and kind_of(f.dataType) == "boolean"]
    top = F.when(F.col("column").isin(flags), F.initcap(F.col("int_value").cast("boolean").cast("string"))
                 ).otherwise(value_text()) if flags else value_text()
    return (hist.withColumn("_text", top).groupBy("column")
            .agg(F.sum("rows").alias("count"), F.count(F.lit(1)).alias("unique"),
                 F.min_by("_text", order).alias("top"), F.max("rows").alias("freq")))


NUMERIC_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def numeric_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """The fitted numbers behind describe, profiles, outlier bounds and imputation."""
    if not cols:
        return {}
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    as_numbers = df.select(*[(epoch_seconds(df.schema[c]) if kinds[c] == "time" else F.col(f"`{c}`").cast("double")).alias(c)
                             for c in cols])
    out: dict[str, dict[str, float | None]] = {}
    quartiles = exact_quantiles(as_numbers, {c: [0.25, 0.5, 0.75] for c in cols}, moments=out)
    for c in cols:
        out[c].update(zip(("p25", "p50", "p75"), quartiles[c]))
    return out


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric or time column; times are epoch seconds and have no std."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    cols = list(cols) if cols is not None else [c for c, k in kinds.items() if k in ("numeric", "time")]
    stats = numeric_stats(df, cols)
    rows = [(c, int(s["count"]), *[None if (k == "std" and kinds[c] == "time") or s[k] is None else float(s[k])
                                   for k in NUMERIC_STATS[1:]]) for c, s in stats.items()]
    schema = "column string, count long, " + ", ".join(f"{k} double" for k in NUMERIC_STATS[1:])
    return df.sparkSession.createDataFrame(rows, schema)     # one row per column


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric, time and categorical columns in one table; fields that do not apply are NULL."""
    numeric = describe_numeric(df)
    text = describe_categorical(df)
    none = F.lit(None)
    wide = numeric.select("column", "count", none.cast("bigint").alias("unique"), none.cast("string").alias("top"),
                          none.cast("bigint").alias("freq"), *NUMERIC_STATS[1:])
    return wide.unionByName(text.select("*", *[none.cast("double").alias(k) for k in NUMERIC_STATS[1:]]))



"""The (column, value) histogram behind distinct counts, modes and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions.scalars import kind_of, missing


def _lanes(field: T.StructField) -> tuple[Column, Column, Column]:
    """The value in its integer, floating or text lane, so no precision is lost."""
    c = F.col(f"`{field.name}`")
    none = [F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")]
    t = field.dataType
    if isinstance(t, (T.BooleanType, T.IntegralType)):
        none[0] = c.cast("bigint")
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        none[1] = F.when(~missing(field), c.cast("double"))
    else:
        none[2] = c.cast("string")
    return tuple(none)


def column_histogram(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value), missing values left out: one scan, combined before the shuffle."""
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    parts = []
    for f in fields:
        i, d, s = _lanes(f)
        parts.append(F.struct(F.lit(f.name).alias("column"), i.alias("int_value"),
                              d.alias("num_value"), s.alias("text_value")))
    return (df.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
            .where("int_value IS NOT NULL OR num_value IS NOT NULL OR text_value IS NOT NULL")
            .groupBy("column", "int_value", "num_value", "text_value")
            .agg(F.count(F.lit(1)).alias("rows")))


def value_text(name: str = "top") -> Column:
    return F.coalesce(F.col("int_value").cast("string"), F.col("num_value").cast("string"),
                      F.col("text_value")).alias(name)


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie."""
    if not cols:
        return {}
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    exact = F.when(F.col("column").isin(decimals), F.col("text_value").try_cast("decimal(38,18)"))   # 9.00 before 10.00
    order = F.struct(-F.col("rows"), "int_value", "num_value", exact, "text_value")
    best = (column_histogram(df, cols).groupBy("column")
            .agg(F.min_by(F.struct("int_value", "num_value", "text_value"), order).alias("v")).collect())
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for r in best:                                   # one row per column
        v = next(x for x in r["v"] if x is not None)
        out[r["column"]] = bool(v) if kind_of(types[r["column"]]) == "boolean" else v
    return out


def small_domains(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list | None]:
    """Sorted distinct values of each column that has at most `limit` of them, else None.

    A sketch first rules out wide columns, so the exact sets that follow are small.
    """
    if not cols:
        return {}
    quoted = {c: F.col(f"`{c}`") for c in cols}
    gate = df.agg(*[F.approx_count_distinct(q, 0.05).alias(f"a{i}") for i, q in enumerate(quoted.values())]).first()
    narrow = [c for i, c in enumerate(cols) if gate[f"a{i}"] <= 2 * limit + 8]
    if not narrow:
        return {c: None for c in cols}
    fields = {f.name: f for f in df.schema.fields}
    sets = df.agg(*[F.array_sort(F.collect_set(F.when(~missing(fields[c]), quoted[c]))).alias(f"s{i}")
                    for i, c in enumerate(narrow)]).first()
    out: dict[str, list | None] = {c: None for c in cols}
    for i, c in enumerate(narrow):
        if len(sets[f"s{i}"]) <= limit:
            out[c] = list(sets[f"s{i}"])
    return out

"""Categorical encodings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.scalars import kind_of
from evenkeel.plans.histogram import small_domains
from evenkeel.plans.order import number_rows, skew_safe_lookup
from evenkeel.session import cut_lineage

MAX_DUMMIES = 1_000
MAX_LITERAL_CODES = 1_000


def _text(df: DataFrame, c: str):
    q = F.col(f"`{c}`")
    kind = kind_of(df.schema[c].dataType)
    return F.initcap(q.cast("string")) if kind == "boolean" else q.cast("string")


def categories(df: DataFrame, cols: Sequence[str], cap: int) -> dict[str, list[str] | None]:
    texts = df.select(*[_text(df, c).alias(c) for c in cols])
    return small_domains(texts, cols, cap)


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
            fit_on: DataFrame | None = None, cap: int = MAX_DUMMIES) -> DataFrame:
    """0/1 columns `col_category` in sorted order after the remaining columns; missing gives all zeros.

    Every category becomes a column, so more than `cap` of them is an error.
    """
    found = categories(df if fit_on is None else fit_on, cols, cap)
    wide = [c for c in cols if found[c] is None]
    if wide:
        raise ValueError(f"more than {cap} categories in {wide}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    dummies = [F.coalesce(_text(df, c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}_{v}")
               for c in cols for v in found[c][1 if drop_first else 0:]]
    return df.select(*rest, *dummies)


def ordinal_map(df: DataFrame, c: str) -> DataFrame:
    """(category, code, rows): codes 0..n-1 by sorted text, numbered without a one-task window."""
    counts = cut_lineage(df.select(_text(df, c).alias("category")).where("category IS NOT NULL")
                         .groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")))        # read twice, to slice and to number
    return number_rows(counts, "category", "code").select("category", "code", "n_rows")


def encoding_maps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, category, code) of all columns."""
    out = None
    for c in cols:
        part = ordinal_map(df, c).select(F.lit(c).alias("column"), "category", F.col("code").cast("int").alias("code"))
        out = part if out is None else out.unionByName(part)
    return out


def ordinal_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   cap: int = MAX_LITERAL_CODES) -> DataFrame:
    """Codes of the sorted categories as nullable double; missing or unseen values are missing.

    Few categories become a map literal, so encoding is a narrow projection; many are joined, with
    the hot ones split off.
    """
    source = df if fit_on is None else fit_on
    found = categories(source, cols, cap)
    out = df
    for c in cols:
        if found[c] is not None:
            if not found[c]:
                out = out.withColumn(c, F.lit(None).cast("double"))
                continue
            codes = F.create_map(*chain.from_iterable((F.lit(v), F.lit(float(i))) for i, v in enumerate(found[c])))
            out = out.withColumn(c, F.try_element_at(codes, _text(df, c)))
        else:
            out = _joined_codes(out, source, c)
    return out


def _joined_codes(df: DataFrame, source: DataFrame, c: str) -> DataFrame:
    codes = cut_lineage(ordinal_map(source, c).withColumnRenamed("category", "_category"))     # counted and numbered once
    total = codes.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    texts = df.withColumn("_category", _text(df, c))
    known = skew_safe_lookup(texts.where("_category IS NOT NULL"), codes, ["_category"], "n_rows", total)
    none = texts.where("_category IS NULL").withColumn("code", F.lit(None).cast("bigint"))
    parts = known.unionByName(none)
    if source is not df:
        unseen = (texts.where("_category IS NOT NULL").join(codes.select("_category"), "_category", "left_anti")
                  .withColumn("code", F.lit(None).cast("bigint")))
        parts = parts.unionByName(unseen)
    return parts.withColumn(c, F.col("code").cast("double")).select(*df.columns)

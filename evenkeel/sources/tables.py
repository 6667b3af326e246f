"""Scans, sinks and fingerprints."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel.sources.records import csv_records

# The texts a CSV reader counts as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CSV = {"quote": '"', "escape": '"'}          # a quote inside quotes is doubled


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def keep_range(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Rows whose columns lie in closed ranges (None leaves an end open); a missing value, NaN included, lies in none.

    On a scan the comparisons reach the Parquet reader, which a filter behind `nan_to_null` does not."""
    for c, (low, high) in ranges.items():
        q = F.col(f"`{c}`")
        df = df.where(q.isNotNull() if low is None else q >= F.lit(low))
        if high is not None:
            df = df.where(q <= F.lit(high))
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            df = df.where(~F.isnan(q))                    # NaN compares above every number
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", row_id: str | None = None,
               ranges: Mapping[str, tuple] | None = None) -> DataFrame:
    """Parquet or header CSV; `ranges` keeps the rows of `keep_range`, as part of the scan for Parquet. `row_id` adds the file's path below `path` and the row's position in it: stable under
    any partitioning, the same wherever the table is mounted, and different for files of one name in two folders."""
    if fmt == "csv":
        return keep_range(_read_csv(spark, path), ranges or {})
    df = keep_range(spark.read.format(fmt).load(path), ranges or {})
    if row_id is None:
        return nan_to_null(df)
    if fmt != "parquet":
        raise ValueError("row positions are known for parquet only; use add_row_id elsewhere")
    named = df.select("*", F.concat_ws("#", _below(path), F.col("_metadata.row_index").cast("string")).alias(row_id))
    return nan_to_null(named)


def _below(path: str) -> Column:
    """A file's path below the table's; the whole path where the table is named by a pattern, the name of a single file."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    at = F.locate(root + "/", F.col("_metadata.file_path"))
    inside = F.expr("_metadata.file_path").substr(at + F.lit(len(root) + 1), F.length("_metadata.file_path"))
    whole = F.endswith("_metadata.file_path", F.lit(root))
    return F.when(whole, F.col("_metadata.file_name")).when(at > 0, inside).otherwise(F.col("_metadata.file_path"))


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may go on in the next line: some line holds an odd number of quotes or a lone one inside a value."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lone = F.col("value").rlike('[^,"]"(?:"")*+[^,"]')
    return not spark.read.text(path).where((quotes % 2 == 1) | lone).limit(1).isEmpty()


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. Files are split, those with line breaks inside quotes by `csv_records`; the rows are the same.

    Only carriage returns inside lines beside such quotes leave a file to one task."""
    reader = spark.read.options(**CSV).option("header", True)
    if not has_open_quotes(spark, path):
        return reader.csv(path)
    names = reader.option("multiLine", True).csv(path).columns
    if not spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike("(?s)\r.")).limit(1).isEmpty():
        return reader.csv(path)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return csv_records(spark, path).select(F.from_csv("value", schema, CSV).alias("r")).select("r.*")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan as text, null the missing tokens, then cast each column to the narrowest type all values fit."""
    text = _csv_text(spark, path)
    quoted = [F.col(f"`{c}`") for c in text.columns]
    text = text.select(*[F.when(~q.isin(MISSING_TOKENS), q).alias(c) for q, c in zip(quoted, text.columns)])
    votes = []
    for i, q in enumerate(quoted):
        trimmed = F.trim(q)
        votes += [F.count(q).alias(f"n{i}"),
                  F.count_if(q.isNotNull() & trimmed.rlike(r"^[+-]?\d+$") & trimmed.try_cast("bigint").isNotNull())
                   .alias(f"i{i}"),
                  F.count_if(q.isNotNull() & trimmed.try_cast("double").isNotNull()
                             & ~trimmed.rlike("[dDfF]$")).alias(f"d{i}"),
                  F.count_if(q.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    vote = text.agg(*votes).first()
    cols = []
    for i, (q, c) in enumerate(zip(quoted, text.columns)):
        n = vote[f"n{i}"]
        kind = "string"
        if n == 0 or vote[f"d{i}"] == n:
            kind = "double"
            if n and vote[f"i{i}"] == n:
                kind = "bigint"
        elif vote[f"b{i}"] == n:
            kind = "boolean"
        cols.append((F.trim(q).try_cast(kind) if kind != "string" else q).alias(c))
    return nan_to_null(text.select(*cols))


def content_fingerprint(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: a mark of the table's rows and schema by one rule for any size, read in splits.

    Equal content gives an equal mark wherever it lies and however it is cut into files; any changed value changes it."""
    from evenkeel.operators.synth import dataset_signature

    rows = spark.read.text(path) if fmt == "csv" else spark.read.format(fmt).load(path)      # of a text file its lines
    return dataset_signature(rows).withColumnRenamed("signature", "fingerprint")


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, one file per task; quotes are doubled, blanks kept, no byte-order mark."""
    (df.write.mode("errorifexists").options(**CSV).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def preview(df: DataFrame, n: int = 20, order: str | None = None) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("a preview shows 1 to 100 rows")
    return (df.orderBy(order) if order else df).limit(n)


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def minority_rows(df: DataFrame, label: str, minority) -> DataFrame:
    """Rows of the rarer class without the target column."""
    return df.where(F.col(label) == F.lit(minority)).drop(label)

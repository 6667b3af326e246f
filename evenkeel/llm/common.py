"""What the operators share: registration, table access, batch mapping over Arrow, hashing of word arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, work: Callable[[list, list], list[tuple]], schema: str) -> DataFrame:
    """Arrow batches in, rows out: work gets the columns of a batch as Python lists."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = work(*[c.to_pylist() for c in batch.columns])
            if rows:
                yield to_batch(rows, arrow)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def local_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Dense ids in order of first appearance, and the distinct words."""
    index = dict.fromkeys(words)
    distinct = list(index)
    for i, w in enumerate(distinct):
        index[w] = i
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words)), distinct


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised: multiply and shift until every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def packed_schema(df: DataFrame, extra: str):
    """The schema (row struct<all input columns>, extra columns...), for Spark and for Arrow."""
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    full = StructType([StructField("row", df.schema), *StructType.fromDDL(extra).fields])
    return full, to_arrow_schema(full)


def packed_batch(batch: pa.RecordBatch, extra: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """The batch's columns packed into `row`, beside one value per row and extra column."""
    kind = arrow.field("row").type
    if kind.num_fields:
        row = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kind)], fields=list(kind))
    else:
        row = pa.array([{}] * batch.num_rows, kind)
    columns = zip(*extra) if extra else [[] for _ in range(len(arrow) - 1)]
    return pa.RecordBatch.from_arrays(
        [row, *[pa.array(list(c), f.type) for c, f in zip(columns, list(arrow)[1:])]], schema=arrow)


def append_columns(df: DataFrame, column: str, work: Callable[[list], list[tuple]], extra: str) -> DataFrame:
    """(row, extra...): work gets one column of each batch as a list and gives a tuple per row.

    The input travels as the struct `row`, so no name of its columns can clash with the new ones.
    """
    full, arrow = packed_schema(df, extra)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed_batch(batch, work(batch.column(at).to_pylist()), arrow)

    return df.mapInArrow(run, full)

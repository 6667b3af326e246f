"""Stable row identity: nothing random may depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

COPY_CHUNK = 100_000


def expand_copies(df: DataFrame, copies: str, number: str, chunk: int = COPY_CHUNK) -> DataFrame:
    """Emit each row `copies` times, numbered from 0.

    A row with very many copies is first cut into chunks that are spread over the tasks, so a group
    of copies holding a third of the table does not come out of one task.
    """
    few = (df.where(F.col(copies).between(1, chunk))
           .withColumn(number, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1))))
    many = (df.where(F.col(copies) > chunk)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.floor((F.col(copies) - 1) / chunk))))
            .repartition(F.col("_chunk"), F.col(copies))
            .withColumn(number, F.explode(F.sequence(
                F.col("_chunk") * chunk, F.least((F.col("_chunk") + 1) * chunk, F.col(copies)) - 1)))
            .drop("_chunk"))
    return few.unionByName(many)


def add_row_id(df: DataFrame, keys: Sequence[str] | None = None, name: str = "row_id",
               chunk: int = COPY_CHUNK) -> DataFrame:
    """Row identity from unique source keys, else from the row's content and a copy number.

    Copies are interchangeable, so they are counted first (combined before the shuffle) and
    re-expanded; no window ever holds all copies of a row.
    """
    if keys and len(keys) == 1:
        return df.withColumn(name, F.col(keys[0]).cast("string"))
    if keys:
        # each part with its length, so that neither NULL nor a separator inside a key makes two rows alike
        texts = [F.col(k).cast("string") for k in keys]
        return df.withColumn(name, F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    each = expand_copies(counted, "_copies", "_copy", chunk)
    content = F.md5(F.to_json(F.struct(*cols)))
    return each.select(*cols, F.concat_ws("-", content, F.col("_copy").cast("string")).alias(name))

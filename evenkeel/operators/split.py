"""Exact seeded splits, samples and class counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.scalars import SEED, draw
from evenkeel.plans.order import number_rows
from evenkeel.plans.quota import assign_parts, sample_exact
from evenkeel.session import cut_lineage

MAX_STRATA = 1_000

__all__ = ["split", "stratum_quotas", "quota_table", "split_sizes", "sample_exact", "shuffle", "class_counts"]


def stratum_quotas(counts: dict[object, int], n: int) -> dict[object, int]:
    """Share n among strata in proportion to their counts; the largest remainders get the rest.

    Equal remainders go to the smaller stratum value.
    """
    total = sum(counts.values())
    if not 0 <= n <= total:
        raise ValueError(f"cannot take {n} of {total} rows")
    exact = {s: n * c / total for s, c in counts.items()} if total else {}
    out = {s: math.floor(x) for s, x in exact.items()}
    rest = n - sum(out.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), str(s)))[:rest]:
        out[s] += 1
    return out


def quota_table(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, n_rows): `stratum_quotas` as a Spark job, for any number of strata, in whole numbers.

    Strata are counted once; the rest is dealt by remainder through `number_rows`, so that no task ranks them all."""
    counts = cut_lineage(df.groupBy(F.col(f"`{stratum}`").alias("stratum")).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if not 0 <= n <= total:
        raise ValueError(f"cannot take {n} of {total} rows")
    share = F.col("_rows").cast("decimal(38,0)") * F.lit(n)            # beyond a bigint for large tables
    shared = (counts.withColumn("_share", share.cast("decimal(38,0)"))
              .withColumn("_whole", F.expr(f"_share div {total or 1}"))
              .withColumn("_left", F.expr(f"cast(_share % {total or 1} AS bigint)")))
    rest = n - (shared.agg(F.sum("_whole")).first()[0] or 0)
    order = F.concat(F.lpad((F.lit(total) - F.col("_left")).cast("string"), 20, "0"),
                     F.coalesce(F.col("stratum").cast("string"), F.lit("None")))
    ranked = number_rows(shared.withColumn("_order", order), "_order", "_place")
    return ranked.select("stratum", (F.col("_whole") + F.when(F.col("_place") < rest, 1).otherwise(0)).cast("bigint").alias("n_rows"))


def split_sizes(counts: dict[object, int], val: float = 0.2, test: float = 0.2) -> dict[object, list[int]]:
    """[train, validation, test] rows per stratum: hold out val+test first, then divide it."""
    for ratio in (val, test):
        if not 0.05 <= ratio <= 0.40:
            raise ValueError("validation and test ratios must lie in 0.05..0.40")
    if 1.0 - val - test <= 0:
        raise ValueError("no rows are left to train on")
    n = sum(counts.values())
    held = math.ceil((val + test) * n)
    n_test = math.ceil(test / (val + test) * held)
    train = stratum_quotas(counts, n - held)
    left = {s: c - train[s] for s, c in counts.items()}
    validation = stratum_quotas(left, held - n_test)
    sizes = {s: [train[s], validation[s], left[s] - validation[s]] for s in counts}
    if any(min(parts) < 1 for parts in sizes.values()):
        raise ValueError("a class has too few rows for this split")
    return sizes


def split(df: DataFrame, label: str, row_id: str, val: float = 0.2, test: float = 0.2,
          stratify: bool = True, seed: int = SEED, max_strata: int = MAX_STRATA) -> DataFrame:
    """Add `split` (train, validation, test) with exact sizes; a narrow projection once fitted.

    A label of more than max_strata classes is an error: each class adds a border to the projection."""
    if stratify:
        found = df.groupBy(label).count().limit(max_strata + 1).collect()
        if len(found) > max_strata:
            raise ValueError(f"{label} has more than {max_strata} classes; raise max_strata or split without strata")
        counts = {r[0]: r[1] for r in found}
        stratum = F.col(label)
    else:
        counts, stratum = {"all": df.count()}, F.lit("all")
    return assign_parts(df, row_id, stratum, ["train", "validation", "test"], split_sizes(counts, val, test), seed)


def shuffle(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """Seeded permutation of whole rows: a range-partitioned sort by the row's hash."""
    return df.orderBy(draw(seed, row_id), F.col(row_id))


def class_counts(df: DataFrame, label: str, by: str = "split") -> DataFrame:
    return df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(by, label)

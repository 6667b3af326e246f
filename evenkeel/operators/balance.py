"""Class distribution, rebalancing plan and the union with synthetic rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from evenkeel.operators.split import shuffle


def class_distribution(df: DataFrame, label: str, stage: str) -> DataFrame:
    """(stage, class, n_rows, pct) with the class as text and the share in percent."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class"))
              .agg(F.count(F.lit(1)).alias("n_rows")))
    total = F.sum("n_rows").over(W.partitionBy("stage"))          # one row per class
    return counts.withColumn("stage", F.lit(stage)).select(
        "stage", "class", "n_rows", F.bround(F.col("n_rows") * 100.0 / total, 2).alias("pct"))


def balance_report(before: DataFrame, after: DataFrame, label: str,
                   stages: tuple[str, str] = ("before", "after")) -> DataFrame:
    return class_distribution(before, label, stages[0]).unionByName(class_distribution(after, label, stages[1]))


def pair_matching_status(df: DataFrame, label: str) -> DataFrame:
    """One row: is the target binary, and are its classes exactly 1:1?"""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg((F.count(F.lit(1)) == 2).alias("is_binary"),
                     F.coalesce(F.min("n"), F.lit(0)).cast("bigint").alias("minority"),
                     F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("majority"))
    binary = F.col("is_binary")
    return row.select("is_binary", (binary & (F.col("minority") == F.col("majority"))).alias("is_matched"),
                      "minority", "majority",
                      F.when(binary, F.try_divide(F.col("minority").cast("double"), F.col("majority"))).alias("ratio"),
                      F.when(binary, F.col("majority") - F.col("minority")).alias("difference"))


@dataclass(frozen=True)
class Plan:
    minority_label: object
    majority_label: object
    minority: int
    majority: int
    current_ratio: float
    target_ratio: float
    needed: int


def default_manual_ratio(current_ratio: float) -> float:
    return min(1.0, max(0.5, round(current_ratio, 2)))


def rebalance_plan(df: DataFrame, label: str, target_ratio: float = 1.0) -> DataFrame:
    """One row: the class sizes and how many minority rows are missing for the target ratio.

    Equal classes: the smaller label is the minority.
    """
    if not 0.10 <= target_ratio <= 1.00:
        raise ValueError("the target ratio must lie in 0.10..1.00")
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min_by("label", F.struct("n", "label")).alias("minority_label"),
                     F.max_by("label", F.struct("n", "label")).alias("majority_label"),
                     F.min("n").alias("minority"), F.max("n").alias("majority"))
    target = F.ceil(F.col("majority") * F.lit(float(target_ratio)))
    return row.select("*", (F.col("minority") / F.col("majority")).alias("current_ratio"),
                      F.lit(float(target_ratio)).alias("target_ratio"),
                      F.greatest(F.lit(0), target - F.col("minority")).cast("bigint").alias("needed"))


def require_plan(df: DataFrame, label: str, target_ratio: float = 1.0, least_minority: int = 1) -> Plan:
    """The plan as plain values; an error where rebalancing makes no sense."""
    r = rebalance_plan(df, label, target_ratio).first()
    plan = Plan(**r.asDict())
    if plan.minority < least_minority:
        raise ValueError(f"the minority class needs at least {least_minority} rows")
    if plan.target_ratio <= plan.current_ratio:
        raise ValueError(f"the target ratio must exceed the current one ({plan.current_ratio:.3f})")
    return plan


def ratio_report(df: DataFrame, label: str, ratios: Sequence[float]) -> DataFrame:
    """(target_ratio, current_ratio, needed, problem) for each ratio asked for, from one count of the classes.

    `problem` is NULL where `require_plan` would accept the ratio; `needed` is then the number of missing rows."""
    wanted = df.sparkSession.createDataFrame([(float(r),) for r in ratios], "target_ratio double")
    plan = rebalance_plan(df, label).select("minority", "majority", "current_ratio")       # one row
    ratio = F.col("target_ratio")
    problem = (F.when(~ratio.between(0.10, 1.00), F.lit("the target ratio must lie in 0.10..1.00"))
               .when(F.coalesce("minority", F.lit(0)) < 1, F.lit("the minority class needs at least 1 rows"))
               .when(ratio <= F.col("current_ratio"), F.lit("the target ratio must exceed the current one")))
    needed = F.when(problem.isNull(), F.ceil(F.col("majority") * ratio) - F.col("minority")).cast("bigint")
    return (wanted.withColumn("_one", F.lit(1)).join(F.broadcast(plan.withColumn("_one", F.lit(1))), "_one")
            .select("target_ratio", "current_ratio", needed.alias("needed"), problem.alias("problem")))


def append_synthetic(train: DataFrame, synthetic: DataFrame, label: str, minority_label, method: str,
                     row_id: str | None = None, shuffled: bool = False) -> DataFrame:
    """Train rows plus synthetic rows labelled with the minority class, marked and tagged with the method.

    Training needs no shuffle; ask for one only where row order matters, with a row id on both sides.
    """
    tagged = synthetic.withColumn(label, F.lit(minority_label).cast(train.schema[label].dataType))
    both = (train.withColumn("is_synthetic", F.lit(False))
            .unionByName(tagged.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True)
            .withColumn("method", F.lit(method)))
    return shuffle(both, row_id) if shuffled else both

"""Classification metrics, ROC and report tables over a predictions table.

Predictions: model, split, y (0/1), prob, pred (0/1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from evenkeel.plans.order import BUCKET_ROWS, cut_points, prefix_sum, with_bucket
from evenkeel.session import cut_lineage

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
KEYS = ["model", "split"]


def score_histogram(predictions: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Positives and negatives per distinct score: all a ROC needs, combined before the shuffle."""
    return predictions.groupBy(*by, "prob").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg"))


def _area(counts: DataFrame, by: list[str], bucket_rows: int) -> DataFrame:
    """The area from written counts per score (a score may come twice): one shuffle of the scores, into slices of their range.

    Negatives below a positive lie in its own slice or in slices before it; a few numbers per slice carry the latter.
    """
    cuts = cut_points(counts, "prob", bucket_rows)
    slices = [*by, "_slice"]
    scores = (with_bucket(counts.select(*by, "prob", "pos", "neg"), "prob", cuts, "_slice").repartition(*slices)
              .groupBy(*slices, "prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*slices).orderBy("prob").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = (scores.withColumn("_below", below).groupBy(*slices)
              .agg(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = inside.withColumn("u", F.col("u") + F.col("p") * earlier).groupBy(*by).agg(
        F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, (F.col("u") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("roc_auc"))


def roc_auc(predictions: DataFrame, by: Sequence[str] = KEYS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact area with ties counted half; NULL where a class is absent."""
    return _area(cut_lineage(score_histogram(predictions, by)), list(by), bucket_rows)


def metrics(predictions: DataFrame, by: Sequence[str] = KEYS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and ROC-AUC per model and split.

    Everything follows from the counts per score; these are written once, so the models score once.
    """
    by = list(by)
    called = cut_lineage(predictions.groupBy(*by, "prob", "pred").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg")))
    yes = F.col("pred") == 1
    counts = called.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(yes, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(yes, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~yes, F.col("pos"))), F.lit(0)).alias("fn"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rates = counts.select(
        *by, ratio(F.col("n") - fp - fn, F.col("n").cast("double")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    area = _area(called, by, bucket_rows).select(*[F.col(k).alias(f"_{k}") for k in by], "roc_auc")
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rates.join(area, on, "left").drop(*[f"_{k}" for k in by])


def roc_curve(predictions: DataFrame, split: str | None = "test", by: Sequence[str] = ("model",),
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fpr, tpr, threshold) from the highest score down.

    It starts at (0, 0) with an infinite threshold; points in the middle of a straight run are left out.
    """
    by = list(by)
    rows = predictions if split is None else predictions.where(F.col("split") == split)
    hist = cut_lineage(score_histogram(rows, by)).select("*", (-F.col("prob")).alias("_down"), F.lit(1).cast("bigint").alias("_one"))
    run = prefix_sum(hist, "_down", ["pos", "neg", "_one"], by, before=["_tp", "_fp", "_at"], total=["_p", "_n", "_points"],
                     bucket_rows=bucket_rows)
    # a point stays where the direction of the curve changes: compare its step with the next one
    steps = _with_next_step(run, by, bucket_rows)
    turn = F.col("_next_pos").isNull() | (F.col("pos") * F.col("_next_neg") != F.col("neg") * F.col("_next_pos"))
    points = steps.where(turn).select(
        *by, ((F.col("_fp") + F.col("neg")) / F.nullif(F.col("_n").cast("double"), F.lit(0.0))).alias("fpr"),
        ((F.col("_tp") + F.col("pos")) / F.nullif(F.col("_p").cast("double"), F.lit(0.0))).alias("tpr"),
        F.col("prob").alias("threshold"))
    start = hist.select(*by).distinct().select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                               F.lit(float("inf")).alias("threshold"))
    return start.unionByName(points)


def _with_next_step(run: DataFrame, by: list[str], bucket_rows: int) -> DataFrame:
    """Each distinct score with the class counts of the next lower one.

    Blocks of consecutive positions, each with one extra row from its neighbour, replace a window over
    all scores of a model.
    """
    block = F.floor(F.col("_at") / bucket_rows)
    homes = F.when((F.col("_at") % bucket_rows == 0) & (F.col("_at") > 0), F.array(block - 1, block)).otherwise(F.array(block))
    spread = run.withColumn("_block", F.explode(homes))
    w = W.partitionBy(*by, "_block").orderBy("_at")
    return (spread.withColumn("_next_pos", F.lead("pos").over(w)).withColumn("_next_neg", F.lead("neg").over(w))
            .where(F.col("_block") == block).drop("_block", "_at"))


def random_baseline(df: DataFrame) -> DataFrame:
    """The diagonal every ROC chart is compared with."""
    ends = F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")),
                   F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))
    models = df.select("model").distinct()
    return models.select(F.lit("Random baseline").alias("model"), F.explode(ends).alias("e")).distinct().select("model", "e.*")


def comparison(scores: DataFrame, split: str = "test") -> DataFrame:
    """One row per model: its sampling and five metrics, rounded half-even to 4 places."""
    keep = [c for c in ("model", "sampling") if c in scores.columns]
    return (scores.where(F.col("split") == split)
            .select(*keep, *[F.bround(m, 4).alias(m) for m in METRICS]))


def melt_metrics(scores: DataFrame, split: str = "test") -> DataFrame:
    """(model, metric, score) rows."""
    return scores.where(F.col("split") == split).unpivot(["model"], METRICS, "metric", "score")


def model_detail(scores: DataFrame, model: str, split: str = "test") -> DataFrame:
    return scores.where((F.col("split") == split) & (F.col("model") == model)).select("model", *METRICS)

"""Mutual information between numeric features and a class label, and top-k selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from evenkeel.functions.scalars import digamma
from evenkeel.operators.gates import columns_with_nulls, non_numeric_columns, select_features
from evenkeel.plans.order import BUCKET_ROWS, cut_points, exact_quantiles, number_rows, skew_safe_lookup, with_bucket
from evenkeel.session import cut_lineage

NEIGHBOURS = 3
LITERAL_CLASSES = 1_000    # classes that travel as a literal map
SLICE_ROWS = 50_000        # rows of all features per slice of values


def factorize(df: DataFrame, target: str, name: str = "code") -> DataFrame:
    """Codes 0..n-1 of the sorted target values. Few travel as a literal map; many are numbered and joined, the hot ones
    split off."""
    counts = df.select(F.col(f"`{target}`").alias("_v")).dropna().groupBy("_v").agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.select("_v").limit(LITERAL_CLASSES + 1).collect()
    if len(found) <= LITERAL_CLASSES:
        if not found:
            return df.withColumn(name, F.lit(None).cast("int"))
        pairs = [F.lit(x) for i, v in enumerate(sorted(r[0] for r in found)) for x in (v, i)]
        return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(f"`{target}`")))
    codes = number_rows(counts, "_v", "_code").select("_v", "_code", "_rows")
    keyed = df.withColumn("_v", F.col(f"`{target}`"))
    known = skew_safe_lookup(keyed.where("_v IS NOT NULL"), codes, ["_v"], "_rows", df.count())
    return (known.select(*df.columns, F.col("_code").cast("int").alias(name))
            .unionByName(keyed.where("_v IS NULL").select(*df.columns, F.lit(None).cast("int").alias(name))))


def mutual_info(df: DataFrame, feats: Sequence[str], target: str, method: str = "knn",
                bins: int = 10, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(feature, score): nearest-neighbour estimate, or the plug-in one over quantile bins."""
    bad = [c for c in non_numeric_columns(df.select(*feats, target), target)]
    if bad:
        raise ValueError(f"encode these columns first: {bad}")
    holes = columns_with_nulls(df.select(*feats, target)).collect()            # at most one row per column
    if holes:
        raise ValueError(f"treat missing values first: {[r['column'] for r in holes]}")
    coded = factorize(df.select(*feats, target), target, "_class")
    if method == "binned":
        return _binned(coded, feats, bins)
    if method == "knn":
        return _nearest(coded, feats, bucket_rows)
    raise ValueError(f"unknown method {method!r}")


def _unpivoted(df: DataFrame, feats: Sequence[str], value) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("f"), value(c).alias("x")) for i, c in enumerate(feats)]
    return df.select("_class", F.explode(F.array(*parts)).alias("v")).select("v.f", "v.x", "_class")


def _names(scores: DataFrame, feats: Sequence[str]) -> DataFrame:
    labels = F.array(*[F.lit(c) for c in feats])
    return scores.select(F.element_at(labels, F.col("f") + 1).alias("feature"), "score")


def _binned(df: DataFrame, feats: Sequence[str], bins: int) -> DataFrame:
    """Quantile bins; all features share one small contingency table."""
    probs = [(i + 1) / bins for i in range(bins - 1)]
    cuts = exact_quantiles(df, {c: probs for c in feats})

    def slot(c: str):
        edges = sorted(set(cuts[c]))
        return sum(((F.col(f"`{c}`") > F.lit(e)).cast("int") for e in edges), F.lit(0))

    table = _unpivoted(df, feats, slot).groupBy("f", "x", "_class").agg(F.count(F.lit(1)).alias("n"))
    # at most features x bins x classes rows from here on
    total = F.sum("n").over(W.partitionBy("f"))
    by_bin = F.sum("n").over(W.partitionBy("f", "x"))
    by_class = F.sum("n").over(W.partitionBy("f", "_class"))
    parts = table.select("f", (F.col("n") / total * F.log(F.col("n") * total.cast("double") / (by_bin * by_class.cast("double"))))
                         .alias("term"))
    return _names(parts.groupBy("f").agg(F.greatest(F.lit(0.0), F.sum("term")).alias("score")), feats)


def _nearest(df: DataFrame, feats: Sequence[str], bucket_rows: int) -> DataFrame:
    """Ross' estimator in one dimension, on distinct values with multiplicities.

    For each value the distance to its third neighbour of the same class, then the number of rows of
    any class strictly closer. A value with more copies than that counts its copies instead.

    The values of a feature lie in slices. A slice borrows the nearest values of each class from the slices around it,
    which settles every distance; rows whose reach ends in another slice ask that slice.
    """
    hist = (_unpivoted(df, feats, lambda c: F.col(f"`{c}`").cast("double"))
            .groupBy("f", "x", "_class").agg(F.count(F.lit(1)).alias("n")))
    values = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in feats])).alias("x"))
    cuts = cut_points(values, "x", min(max(2, bucket_rows // len(feats)), SLICE_ROWS))     # the features share the cuts
    hist = cut_lineage(with_bucket(hist, "x", cuts, "_slice"))                # read by every step below
    sizes = W.partitionBy("f")
    classes = (hist.groupBy("f", "_class").agg(F.sum("n").alias("n_class"))
               .where("n_class > 1"))                            # a class of one has no neighbour
    classes = classes.withColumn("n_all", F.sum("n_class").over(sizes))
    small = F.broadcast(classes)                                 # features x classes rows, classes <= 1,000
    hist = hist.join(small, ["f", "_class"])
    solved = cut_lineage(_solved(hist, _borrowed(hist), cuts))
    counted = solved.where("m IS NOT NULL").unionByName(_asked(hist, solved.where("m IS NULL"), cuts))
    score = (digamma(F.max("n_all")) + F.sum((digamma(F.col("k")) - digamma(F.col("n_class")) - digamma(F.col("m")))
                                             * F.col("n")) / F.sum("n"))
    return _names(counted.groupBy("f").agg(F.greatest(F.lit(0.0), score).alias("score")), feats)


_POINT = "f int, _slice int, _class int, x double, n long"


def _borrowed(hist: DataFrame) -> DataFrame:
    """What each slice borrows: for each of its classes the three nearest values before and after it."""
    k = NEIGHBOURS

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_class", "x"])
        mine = pdf.groupby("_class")
        return pdf[(mine.cumcount() < k) | (mine.cumcount(ascending=False) < k)]

    def lend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")                              # at most six values of a slice
        home = pdf["_slice"].to_numpy()
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        last = np.r_[first[1:], len(home)]
        at = np.concatenate([first[:, None] - 1 - np.arange(k), last[:, None] + np.arange(k)], axis=1)
        row, col = np.nonzero((at >= 0) & (at < len(home)))
        return pdf.iloc[at[row, col]].assign(_slice=home[first[row]])

    points = hist.select("f", "_slice", "_class", "x", "n")
    return (points.groupBy("f", "_slice").applyInPandas(ends, _POINT)
            .groupBy("f", "_class").applyInPandas(lend, _POINT))


def _solved(hist: DataFrame, borrowed: DataFrame, cuts: list) -> DataFrame:
    """Adds k, the reach of each value and m (rows of any class within reach), where both ends lie in its slice.

    The reach stays a hair below the distance, so that rows exactly as far away are left out whatever the last bit says.
    """
    k, edges = NEIGHBOURS, np.array([-np.inf, *cuts, np.inf])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_class", "x"])
        x, n, label = pdf["x"].to_numpy(), pdf["n"].to_numpy(), pdf["_class"].to_numpy()
        far, copies = np.full((len(x), 2 * k), np.inf), np.zeros((len(x), 2 * k), dtype=np.int64)
        for step in range(1, min(k, len(x) - 1) + 1):
            same = label[step:] == label[:-step]
            gap = np.where(same, x[step:] - x[:-step], np.inf)
            far[step:, step - 1], copies[step:, step - 1] = gap, np.where(same, n[:-step], 0)
            far[:-step, k + step - 1], copies[:-step, k + step - 1] = gap, np.where(same, n[step:], 0)
        own = ~np.isnan(pdf["n_class"].to_numpy(dtype=float))
        pdf, x, n, far, copies = pdf[own], x[own], n[own], far[own], copies[own]
        n_class = pdf["n_class"].to_numpy(dtype=np.int64)
        wanted = np.minimum(k, n_class - 1)
        order = np.argsort(far, axis=1, kind="stable")
        reached = n[:, None] - 1 + np.cumsum(np.take_along_axis(copies, order, axis=1), axis=1) >= wanted[:, None]
        r = np.take_along_axis(np.take_along_axis(far, order, axis=1), reached.argmax(axis=1)[:, None], axis=1)[:, 0]
        tie = n - 1 >= wanted
        r = np.where(tie, 0.0, r)
        reach = np.maximum(r - r * 1e-9 - np.abs(x) * 1e-14, r / 2)
        low, high = x - reach, x + reach
        rising = np.argsort(x, kind="stable")
        m = _below(x[rising], n[rising], high, tie) - _below(x[rising], n[rising], low, ~tie)
        home = int(pdf["_slice"].iloc[0])
        inside = (low >= edges[home]) & (high < edges[home + 1])
        return pd.DataFrame({"f": pdf["f"], "_class": pdf["_class"], "x": x, "n": n, "n_class": n_class, "n_all": pdf["n_all"].astype("int64"),
                             "k": np.where(tie, n, wanted), "tie": tie, "low": low, "high": high,
                             "m": pd.Series(m, index=pdf.index, dtype="Int64").where(inside)})

    names = ["f", "_slice", "_class", "x", "n", "n_class", "n_all"]
    own = hist.select(*names)
    lent = borrowed.select(*names[:5], F.lit(None).cast("bigint").alias("n_class"), F.lit(None).cast("bigint").alias("n_all"))
    return own.unionByName(lent).groupBy("f", "_slice").applyInPandas(
        solve, "f int, _class int, x double, n long, n_class long, n_all long, k long, tie boolean, low double, high double, m long")


def _below(x: np.ndarray, n: np.ndarray, pos: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Rows of the rising x before each position, those at it included where upto says so."""
    run = np.r_[0, np.cumsum(n)]
    return np.where(upto, run[np.searchsorted(x, pos, side="right")], run[np.searchsorted(x, pos, side="left")])


def _asked(hist: DataFrame, rows: DataFrame, cuts: list) -> DataFrame:
    """Adds m to the rows whose reach ends in another slice: the slices of both ends count the rows below them."""
    ends = F.array(F.struct(F.col("low").alias("pos"), (~F.col("tie")).alias("upto"), F.lit(-1).alias("side")),
                   F.struct(F.col("high").alias("pos"), F.col("tie").alias("upto"), F.lit(1).alias("side")))
    asks = with_bucket(rows.select("f", "x", "_class", F.explode(ends).alias("a")).select("f", "x", "_class", "a.*"), "pos", cuts, "_slice")

    def count(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("x")
        cum = _below(points["x"].to_numpy(), points["n"].to_numpy(dtype=np.int64), asked["pos"].to_numpy(), asked["upto"].to_numpy(dtype=bool))
        return asked[["f", "_slice", "x", "_class", "side"]].assign(cum=cum)

    inner = (hist.select("f", "_slice", "x", "n").groupBy("f", "_slice")
             .cogroup(asks.groupBy("f", "_slice")).applyInPandas(count, "f int, _slice int, x double, _class int, side int, cum long"))
    # a few numbers per slice carry the rows of all slices before it
    earlier = W.partitionBy("f").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (hist.select("f", "_slice", "n").unionByName(asks.select("f", "_slice", F.lit(0).cast("bigint").alias("n")))
               .groupBy("f", "_slice").agg(F.sum("n").alias("n"))
               .select("f", "_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")))
    answers = (inner.join(offsets, ["f", "_slice"]).groupBy("f", "x", "_class")
               .agg(F.sum((F.col("cum") + F.col("_offset")) * F.col("side")).alias("m")))
    return rows.drop("m").join(answers, ["f", "x", "_class"])


def select_k_best(df: DataFrame, feats: Sequence[str], target: str, k: int | None = None,
                  method: str = "knn", fit_on: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(reduced frame in the original feature order, score table with a `selected` flag).

    Scores come from all rows, or from those of `fit_on` (the train rows)."""
    k = min(10, len(feats)) if k is None else k
    if not 1 <= k <= len(feats):
        raise ValueError(f"k must lie in 1..{len(feats)}")
    scores = mutual_info(df if fit_on is None else fit_on, feats, target, method, **options)
    best = {r["feature"] for r in scores.orderBy(F.desc("score"), "feature").limit(k).collect()}
    kept = [c for c in feats if c in best]
    table = scores.withColumn("selected", F.col("feature").isin(kept)).orderBy(F.desc("score"), "feature")
    return select_features(df, kept, target), table


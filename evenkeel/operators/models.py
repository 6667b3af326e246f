"""Classifiers under identical data: fit on train (or balanced train), score validation and test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.scalars import SEED
from evenkeel.operators.network import Network, fit_dnn, fit_mlp
from evenkeel.operators.trees import Tree, grow_tree
from evenkeel.session import on_all_cores

DEEPEST = 30        # Spark's limit for forests; stands in for "unlimited"
DEEPEST_TREE = 50
THRESHOLD = 0.5


def fit_scaler(train: DataFrame, feats: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the train rows; a constant column is only centred."""
    row = train.agg(*[x for i, c in enumerate(feats) for x in (
        F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"),
        F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(feats)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def _vectors(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol="_features").transform(df)


@dataclass
class Fitted:
    """A fitted classifier with the columns and scaling it expects."""
    name: str
    model: object
    feats: list[str]
    scaler: dict[str, tuple[float, float]] | None = None
    history: DataFrame | None = None


def fit_logistic(train: DataFrame, feats: Sequence[str], label: str, C: float = 1.0,
                 scaler: dict | None = None) -> Fitted:
    """L2 logistic regression on scaled features; the penalty 1/(C n) matches the summed-loss form."""
    if not 0.001 <= C <= 1000:
        raise ValueError("C must lie in 0.001..1000")
    scaler = scaler or fit_scaler(train, feats)
    n = train.count()
    model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=3000, tol=1e-8, regParam=1.0 / (C * n),
                               elasticNetParam=0.0, standardization=False).fit(_vectors(apply_scaler(train, scaler), feats))
    return Fitted("Logistic Regression", model, list(feats), scaler)


def _depth(depth: int) -> int:
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must lie in 0..{DEEPEST}; 0 is the deepest")
    return depth or DEEPEST


def fit_forest(train: DataFrame, feats: Sequence[str], label: str, trees: int = 300, depth: int = 0,
               seed: int = SEED, max_bins: int = 32) -> Fitted:
    """Random forest on unscaled features without class weights; depth 0 means as deep as Spark allows.

    Cuts are tried between max_bins quantiles of a feature, all of its values where it has no more. Each row keeps the node it
    has reached in every tree, so that a level costs one step a row and tree, not a walk from the root; the trees are the same."""
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=_depth(depth), maxBins=max_bins,
                                   featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024, cacheNodeIds=True
                                   ).fit(_vectors(train, feats))
    return Fitted("Random Forest", model, list(feats))


def fit_tree(train: DataFrame, feats: Sequence[str], label: str, depth: int = 5, min_split: int = 2, max_bins: int = 32) -> Fitted:
    """Decision tree that cuts a node of at least min_split rows; depth 0 sets no limit. Cuts as in the forest."""
    if not 2 <= min_split <= 50:
        raise ValueError("min_split must lie in 2..50")
    if not 0 <= depth <= DEEPEST_TREE:
        raise ValueError(f"depth must lie in 0..{DEEPEST_TREE}; 0 sets no limit")
    return Fitted("Decision Tree", grow_tree(train, feats, label, depth or None, min_split, max_bins), list(feats))


def score(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Adds prob (of class 1) and pred (prob >= 0.5)."""
    if isinstance(fitted.model, Network):
        scaled = df.withColumns({f"_z{i}": (F.col(f"`{c}`").cast("double") - F.lit(fitted.scaler[c][0])) / F.lit(fitted.scaler[c][1])
                                 for i, c in enumerate(fitted.feats)})
        zs = [f"_z{i}" for i in range(len(fitted.feats))]
        out = scaled.withColumn("prob", fitted.model.probability(*zs)).drop(*zs)
    elif isinstance(fitted.model, Tree):
        out = df.withColumn("prob", fitted.model.probability(*[F.col(f"`{c}`").cast("double") for c in fitted.feats]))
    else:
        z = [(F.col(f"`{c}`").cast("double") if not fitted.scaler else
              (F.col(f"`{c}`") - F.lit(fitted.scaler[c][0])) / F.lit(fitted.scaler[c][1])).alias(c) for c in fitted.feats]
        # features go into a struct of their own, so the original columns pass through unscaled
        keep = df.select("*", *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        vectors = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(z))], outputCol="_features").transform(keep)
        out = (fitted.model.transform(vectors).withColumn("prob", vector_to_array("probability")[1])
               .select(*df.columns, "prob"))
    return out.withColumn("pred", (F.col("prob") >= THRESHOLD).cast("int"))


DEFAULT_MODELS = ["Logistic Regression", "Random Forest", "Decision Tree"]


def train_all(splits: DataFrame, feats: Sequence[str], label: str, row_id: str,
              models: Sequence[str] = DEFAULT_MODELS, params: dict[str, dict] | None = None,
              balanced: DataFrame | None = None) -> tuple[DataFrame, dict[str, Fitted]]:
    """(predictions, fitted models): every model sees the same rows; validation and test stay as split.

    `balanced` replaces the train rows; its `method` column names the sampling.
    """
    params = params or {}
    numeric = [F.col(f"`{c}`").cast("double").alias(c) for c in feats]
    source = splits.where("split = 'train'") if balanced is None else balanced
    sampling = "No oversampling" if balanced is None else balanced.select("method").first()[0]
    extra = [F.col(row_id)] if row_id in source.columns else [F.lit(None).cast("string").alias(row_id)]
    train = source.select(*numeric, F.col(label).cast("int").alias(label), *extra)
    held = splits.where("split != 'train'").select("split", row_id, F.col(label).cast("int").alias(label), *numeric)
    first = train.persist(StorageLevel.MEMORY_AND_DISK)        # every fit passes over it several times
    train = on_all_cores(first, first.count()).persist(StorageLevel.MEMORY_AND_DISK)
    scaler = fit_scaler(train, feats)
    fits = {
        "Logistic Regression": lambda p: fit_logistic(train, feats, label, scaler=scaler, **p),
        "Random Forest": lambda p: fit_forest(train, feats, label, **p),
        "Decision Tree": lambda p: fit_tree(train, feats, label, **p),
        "Multilayer Perceptron": lambda p: _network("Multilayer Perceptron", fit_mlp(
            apply_scaler(train, scaler), feats, label, row_id, **p), feats, scaler),
        "DNN": lambda p: _network("DNN", fit_dnn(
            apply_scaler(train, scaler), apply_scaler(held.where("split = 'validation'"), scaler), feats, label, row_id, **p),
            feats, scaler),
    }
    predictions, fitted = None, {}
    for name in models:
        fitted[name] = fits[name](params.get(name, {}))
        part = score(fitted[name], held).select(
            F.lit(name).alias("model"), F.lit(sampling).alias("sampling"), "split", row_id,
            F.col(label).alias("y"), "prob", "pred")
        predictions = part if predictions is None else predictions.unionByName(part)
    for kept in (train, first):
        kept.unpersist()
    return predictions, fitted


def _network(name: str, trained: tuple[Network, DataFrame], feats: Sequence[str], scaler: dict) -> Fitted:
    return Fitted(name, trained[0], list(feats), scaler, trained[1])

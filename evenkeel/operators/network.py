"""Feed-forward networks trained by Spark, the same for any size of table and any partitioning.

Equal train rows are folded into one weighted row and dealt into a fixed number of buckets; a bucket is a
mini-batch. In each step every task sends one vector, the gradient of its rows of the bucket; the vectors are
added up in Spark and the driver takes an Adam step. Dropout is drawn from the row's hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.scalars import SEED
from evenkeel.operators.split import stratum_quotas
from evenkeel.plans.keys import add_row_id
from evenkeel.plans.quota import assign_parts

BUCKETS = 4                       # mini-batches of an epoch
TASK_ROWS = 2_000                 # folded rows of one task of a step at least
HISTORY = "epoch int, loss double, val_loss double, accuracy double, val_accuracy double"
SUMS = "g array<double>, loss double, right double, n double"


@dataclass(frozen=True)
class Spec:
    """Hidden layers, how many of them have dropout behind them, and the optimiser's settings."""
    hidden: tuple[int, ...]
    dropout: float = 0.0
    dropout_layers: int = 0
    lr: float = 1e-3
    epochs: int = 200
    patience: int = 12
    margin: float = 1e-6
    watch: str = "loss"               # what early stopping looks at: loss or accuracy
    l2: float = 0.0
    init: str = "fan_in"              # fan_in or glorot


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        w = flat[at:at + a * b].reshape(a, b)
        layers.append((w, flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def initial(sizes: Sequence[int], init: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = (6.0 / (a + b)) ** 0.5 if init == "glorot" else a ** -0.5
        parts.append(rng.uniform(-bound, bound, a * b + b))
    return np.concatenate(parts)


def logits(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> np.ndarray:
    layers = unpack(flat, sizes)
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    return (x @ layers[-1][0] + layers[-1][1])[:, 0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross-entropy from the logit, safe for large values."""
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, l2: float = 0.0,
             masks: Sequence[np.ndarray] = (), weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the mean loss, logits). masks[i] multiplies hidden layer i; weight counts each row's copies."""
    weight = np.ones(len(y)) if weight is None else weight
    layers = unpack(flat, sizes)
    seen = [x]
    for i, (w, b) in enumerate(layers[:-1]):
        x = np.maximum(x @ w + b, 0.0)
        if i < len(masks):
            x = x * masks[i]
        seen.append(x)
    z = (x @ layers[-1][0] + layers[-1][1])[:, 0]
    back = ((sigmoid(z) - y) * weight / weight.sum())[:, None]
    parts: list[np.ndarray] = []
    for i in reversed(range(len(layers))):
        w, _ = layers[i]
        parts = [(seen[i].T @ back + l2 * w / weight.sum()).ravel(), back.sum(0), *parts]
        if i:
            back = (back @ w.T) * (seen[i] > 0)
            if i - 1 < len(masks):
                back = back * masks[i - 1]
    return np.concatenate(parts), z


@dataclass
class Network:
    sizes: tuple[int, ...]
    flat: np.ndarray

    def probability(self, *cols: str):
        flat, sizes = self.flat, self.sizes

        @F.pandas_udf("double")
        def prob(*xs: pd.Series) -> pd.Series:
            return pd.Series(sigmoid(logits(flat, sizes, np.column_stack([x.to_numpy(dtype=float) for x in xs]))))

        return prob(*cols)


def _coins(rows: np.ndarray, epoch: int, layer: int, width: int) -> np.ndarray:
    """A uniform number for each row and unit, from the row's hash alone."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.uint64(epoch * 64 + layer) * np.uint64(0xD1B54A32D192ED03)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def _sums(spec: Spec | None, sizes, flat: np.ndarray, epoch: int, feats, label
          ) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row from each task: the summed gradient (none without a spec), loss, right answers and weight of its rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, loss, right, n = np.zeros(len(flat) if spec else 1), 0.0, 0.0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, w = (pdf[c].to_numpy(dtype=float) for c in (feats, label, "_w"))
            if spec:
                masks = [(_coins(pdf["_h"].to_numpy(), epoch, i, sizes[i + 1]) >= spec.dropout) / (1.0 - spec.dropout)
                         for i in range(spec.dropout_layers)] if spec.dropout > 0 else ()
                part, z = gradient(flat, sizes, x, y, 0.0, masks, w)
                g = g + part * w.sum()
            else:
                z = logits(flat, sizes, x)
            loss, right, n = loss + float((log_loss(z, y) * w).sum()), right + float((((z >= 0) == (y == 1)) * w).sum()), n + w.sum()
        if n:
            yield pd.DataFrame({"g": [g], "loss": loss, "right": right, "n": n})

    return run


def _weighted(df: DataFrame, feats: Sequence[str], label: str, buckets: int, seed: int) -> DataFrame:
    """Equal rows folded, their number dealt evenly over the buckets: however hot a group of copies, it is at most one
    row of each bucket."""
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in feats] + [F.col(label).cast("double").alias(label)]
    folded = df.select(*cols).groupBy(*feats, label).agg(F.count(F.lit(1)).alias("_n"))
    folded = folded.withColumn("_h", F.xxhash64(F.lit(seed), *feats, label))
    each = folded.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least("_n", F.lit(buckets)).cast("int") - 1)))
    return each.select(*feats, label, "_h", F.pmod(F.col("_h") + F.col("_k"), F.lit(buckets)).cast("int").alias("_bucket"),
                       (F.floor(F.col("_n") / buckets) + (F.col("_k") < F.col("_n") % buckets).cast("int")).cast("double").alias("_w"))


def _dealt(folded: DataFrame) -> DataFrame:
    """Kept in as many partitions as there are cores, fewer for a few rows: each step starts a task for every one of them, so
    their number must not grow with the table."""
    first = folded.persist(StorageLevel.MEMORY_AND_DISK)
    parts = min(folded.sparkSession.sparkContext.defaultParallelism, math.ceil(first.count() / TASK_ROWS))
    rows = first.repartition(max(1, parts)).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    first.unpersist()
    return rows


def fit_network(train: DataFrame, val: DataFrame, feats: Sequence[str], label: str, spec: Spec, seed: int = SEED,
                buckets: int = BUCKETS) -> tuple[Network, DataFrame]:
    """(network with the best watched weights, history). Rows must be scaled and complete.

    A step is one job; the first step of an epoch also checks the weights that the epoch before ended with. The
    driver holds the weights and one sum of gradients.
    """
    feats = list(feats)
    sizes = (len(feats), *spec.hidden, 1)
    rows, held = _dealt(_weighted(train, feats, label, buckets, seed)), _dealt(_weighted(val, feats, label, 1, seed))
    total = {r["_bucket"]: r["n"] for r in rows.groupBy("_bucket").agg(F.sum("_w").alias("n")).collect()}
    flat = initial(sizes, spec.init, seed)
    m, v, step = np.zeros(len(flat)), np.zeros(len(flat)), 0
    best, best_flat, stale, history = None, flat, 0, []

    def added(df: DataFrame, worker) -> tuple[np.ndarray, float, float, float]:
        sums = df.mapInPandas(worker, SUMS).agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("loss").alias("loss"),
                                                F.sum("right").alias("right"), F.sum("n").alias("n")).first()
        return (sums["g"].toArray() if sums["g"] is not None else np.zeros(0)), sums["loss"] or 0.0, sums["right"] or 0.0, sums["n"] or 0.0

    try:
        for epoch in range(spec.epochs + 1):
            if epoch:
                _, loss, right, n = added(held, _sums(None, sizes, flat, epoch, feats, label))
                val_loss, val_acc = (loss / n, right / n) if n else (math.nan, math.nan)
                history[-1][2], history[-1][4] = val_loss, val_acc
                got = -val_loss if spec.watch == "loss" else val_acc
                if best is None or got > best + spec.margin:
                    best, best_flat, stale = got, flat, 0
                else:
                    stale += 1
                    if stale >= spec.patience:
                        break
            if epoch == spec.epochs:
                break
            seen = [0.0, 0.0, 0.0]
            for bucket in sorted(total):
                g, *sums = added(rows.where(F.col("_bucket") == bucket), _sums(spec, sizes, flat, epoch, feats, label))
                seen = [a + b for a, b in zip(seen, sums)]
                g = (g + spec.l2 * _weights_only(flat, sizes)) / sums[2]
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                flat = flat - spec.lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            history.append([epoch + 1, seen[0] / seen[2], None, seen[1] / seen[2], None])
    finally:
        rows.unpersist()
        held.unpersist()
    return Network(sizes, best_flat), train.sparkSession.createDataFrame([tuple(h) for h in history if h[2] is not None], HISTORY)


def _weights_only(flat: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """The weights with zeros for the offsets, which carry no penalty."""
    return np.concatenate([x for w, b in unpack(flat, sizes) for x in (w.ravel(), np.zeros(len(b)))])


def fit_dnn(train: DataFrame, val: DataFrame, feats: Sequence[str], label: str, row_id: str | None = None, epochs: int = 200,
            lr: float = 1e-3, dropout: float = 0.2, seed: int = SEED, **options) -> tuple[Network, DataFrame]:
    """d-128-64-32-1 with dropout behind the first two layers; stops on validation loss."""
    if not 0.0 <= dropout <= 0.7:
        raise ValueError("dropout must lie in 0.0..0.7")
    spec = Spec((128, 64, 32), dropout, 2, lr, epochs, patience=12, margin=1e-6, watch="loss")
    return fit_network(train, val, feats, label, spec, seed, **options)


def inner_tenth(train: DataFrame, feats: Sequence[str], label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, exactly a tenth of the rows, rounded up, in proportion to the classes)."""
    numbered = add_row_id(train.select(*feats, label), None, "_id")
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}          # two classes
    sizes = stratum_quotas(counts, math.ceil(sum(counts.values()) / 10))
    parts = assign_parts(numbered, "_id", F.col(label), ["held"], {s: [n] for s, n in sizes.items()}, seed, "_part")
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    return parts.where("_part IS NULL").drop("_id", "_part"), parts.where("_part = 'held'").drop("_id", "_part")


def fit_mlp(train: DataFrame, feats: Sequence[str], label: str, row_id: str | None = None, layers: Sequence[int] = (128, 64),
            lr: float = 1e-3, max_iter: int = 500, seed: int = SEED, **options) -> tuple[Network, DataFrame]:
    """ReLU network that stops on the accuracy of an inner tenth of the train rows, exact and stratified."""
    spec = Spec(tuple(layers), 0.0, 0, lr, max_iter, patience=15, margin=1e-4, watch="accuracy", l2=1e-4, init="glorot")
    learn, held = inner_tenth(train, feats, label, seed + 1)
    return fit_network(learn, held, feats, label, spec, seed, **options)

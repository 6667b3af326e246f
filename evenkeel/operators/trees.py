"""Decision trees grown level by level: Spark sums a histogram of (node, feature, bin) and picks each node's best cut.

A node is cut while it holds at least `min_split` rows of both classes and lies above the depth limit; a child may hold any
number of rows from one on. Cuts minimise the weighted Gini impurity; ties go to the first feature, then the lowest cut. A
feature of at most `max_bins` values is cut half way between two neighbouring values of the node, any other one at exact
quantiles. A level is one pass over the binned rows, which are written once; the driver holds only the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenkeel.plans.order import exact_quantiles
from evenkeel.session import cut_lineage

LEAF = -1


@dataclass(frozen=True)
class Bins:
    """A feature's bins: its values, or (few is False) the upper ends of all bins but the last."""
    ends: np.ndarray
    few: bool

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, x, side="left")

    def cut(self, at: int, following: int) -> float:
        """The cut above bin `at`; `following` is the node's next bin that holds rows."""
        if not self.few:
            return float(self.ends[at])
        low, high = self.ends[at], self.ends[following]
        middle = low / 2 + high / 2 if np.isinf(low + high) else (low + high) / 2
        return float(low if middle >= high else middle)


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first: the feature cut (LEAF for none), the cut, both children and the share of class 1."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray                 # (nodes, 2)
    prob: np.ndarray
    rows: np.ndarray

    def probability(self, *cols: str) -> Column:
        feature, cut, child, prob = self.feature, self.cut, self.child, self.prob

        @F.pandas_udf("double")
        def leaf_share(*xs: pd.Series) -> pd.Series:
            x = np.column_stack([s.to_numpy(dtype=float) for s in xs])
            return pd.Series(prob[descend(feature, cut, child, x)])

        return leaf_share(*cols)


def descend(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node each row ends in: up to the cut it goes left, above it (and without a value) right."""
    node = np.zeros(len(x), dtype=np.int64)
    going = np.flatnonzero(feature[node] != LEAF)
    while len(going):
        at = node[going]
        right = ~(x[going, feature[at]] <= cut[at])
        node[going] = child[at, right.astype(int)]
        going = going[feature[node[going]] != LEAF]
    return node


def find_bins(train: DataFrame, feats: Sequence[str], max_bins: int) -> list[Bins]:
    """The bins of each feature. A task reports at most max_bins + 1 values of a feature, enough to tell that it has more."""
    def few_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.zeros(0)] * len(feats)
        for pdf in batches:
            for i, c in enumerate(feats):
                if len(seen[i]) <= max_bins:
                    seen[i] = np.unique(np.concatenate([seen[i], np.unique(pdf[c].to_numpy(dtype=float))]))[:max_bins + 1]
        for i, values in enumerate(seen):
            yield pd.DataFrame({"i": np.full(len(values), i, dtype=np.int32), "value": values})

    met = (train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in feats]).mapInPandas(few_values, "i int, value double")
           .distinct().groupBy("i").agg(F.slice(F.array_sort(F.collect_list("value")), 1, max_bins + 1).alias("values")).collect())
    values = {r["i"]: np.array(r["values"]) for r in met}
    wide = [c for i, c in enumerate(feats) if len(values.get(i, ())) > max_bins]
    ends = exact_quantiles(train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wide]),
                           {c: [k / max_bins for k in range(1, max_bins)] for c in wide}) if wide else {}
    return [Bins(np.unique(ends[c]), False) if c in ends else Bins(values.get(i, np.zeros(0)), True) for i, c in enumerate(feats)]


def _level(binned: DataFrame, width: int, feature, cut_bin, child, open_nodes: np.ndarray) -> DataFrame:
    """(node, f, b, n, p) of the rows that lie in open nodes: rows and rows of class 1 of each bin."""
    is_open = np.zeros(len(feature), dtype=bool)
    is_open[open_nodes] = True
    names = [f"b{i}" for i in range(width)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy()
            node = descend(feature, cut_bin, child, x)
            mine = is_open[node]
            node, x, y = node[mine], x[mine], pdf["y"].to_numpy()[mine]
            for f in range(width):
                key, at = np.unique(node << 32 | x[:, f], return_inverse=True)
                yield pd.DataFrame({"node": key >> 32, "f": np.full(len(key), f, dtype=np.int32), "b": (key & 0xFFFFFFFF).astype(np.int32),
                                    "n": np.bincount(at, minlength=len(key)), "p": np.bincount(at, y, len(key)).astype(np.int64)})

    return (binned.mapInPandas(count, "node long, f int, b int, n long, p long")
            .groupBy("node", "f", "b").agg(F.sum("n").cast("double").alias("n"), F.sum("p").cast("double").alias("p")))


def best_cuts(histogram: DataFrame) -> DataFrame:
    """(node, f, b, following, nl, pl): each node's cut of least impurity; none for a node whose rows are all alike."""
    whole = W.partitionBy("node", "f")                     # at most max_bins rows
    rising = whole.orderBy("b")
    sums = histogram.select("node", "f", "b", F.lead("b").over(rising).alias("following"),
                            F.sum("n").over(rising).alias("nl"), F.sum("p").over(rising).alias("pl"),
                            F.sum("n").over(whole).alias("alln"), F.sum("p").over(whole).alias("allp")).where("following IS NOT NULL")
    impurity = F.expr("""nl - pl * pl / nl - (nl - pl) * (nl - pl) / nl + (alln - nl) - (allp - pl) * (allp - pl) / (alln - nl)
        - (alln - nl - allp + pl) * (alln - nl - allp + pl) / (alln - nl)""")
    return (sums.groupBy("node").agg(F.min_by(F.struct("f", "b", "following", "nl", "pl"), F.struct(impurity, "f", "b")).alias("best"))
            .select("node", "best.*"))


def grow_tree(train: DataFrame, feats: Sequence[str], label: str, depth: int | None = None, min_split: int = 2,
              max_bins: int = 32) -> Tree:
    """A tree on complete rows with labels 0 and 1; depth None grows until nothing is left to cut. No rows or a missing value
    are errors."""
    feats = list(feats)
    y = F.col(f"`{label}`")
    missing = [F.count_if(c.isNull() | F.isnan(c.cast("double"))) for c in [*[F.col(f"`{f}`") for f in feats], y]]
    n, p, *gaps = train.agg(F.count(F.lit(1)), F.sum(y.cast("long")), *missing).first()
    if not n:
        raise ValueError("a tree needs rows")
    if any(gaps):
        raise ValueError("a tree needs complete rows: " + ", ".join(c for c, g in zip([*feats, label], gaps) if g))
    bins = find_bins(train, feats, max_bins)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({**{f"b{i}": bins[i].of(pdf[f"x{i}"].to_numpy()) for i in range(len(feats))}, "y": pdf["y"]})

    numbers = train.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(feats)], y.cast("int").alias("y"))
    binned = cut_lineage(numbers.mapInPandas(place, ", ".join(f"b{i} int" for i in range(len(feats))) + ", y int"))
    feature, cut_bin, cut, child, rows, ones = [LEAF], [0], [0.0], [[0, 0]], [n], [p]
    level, here = 0, [0]
    while depth is None or level < depth:
        here = [i for i in here if rows[i] >= min_split and 0 < ones[i] < rows[i]]
        if not here:
            break
        found = best_cuts(_level(binned, len(feats), np.array(feature), np.array(cut_bin), np.array(child), np.array(here))).collect()
        here = []
        for best in sorted(found, key=lambda r: r["node"]):
            i, nl, pl = best["node"], int(best["nl"]), int(best["pl"])
            feature[i], cut_bin[i], cut[i] = best["f"], best["b"], bins[best["f"]].cut(best["b"], best["following"])
            child[i] = [len(feature), len(feature) + 1]
            here += child[i]
            feature += [LEAF, LEAF]
            cut_bin += [0, 0]
            cut += [0.0, 0.0]
            child += [[0, 0], [0, 0]]
            rows += [nl, rows[i] - nl]
            ones += [pl, ones[i] - pl]
        level += 1
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(ones) / np.array(rows), np.array(rows))

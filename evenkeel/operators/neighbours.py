"""Exact k-nearest-neighbour join of a point set with itself, without a cross join.

Points are cut into cells by a tree whose nodes have a bounded number of children: the cuts are learned on bounded samples,
for the first level by the driver and for each deeper level in one task a node, so the number of cells grows with the points.
A point's own cell bounds its search radius. Where that radius reaches no other cell's box, the point is finished in the task
of its cell and only its result is written. The others go down the tree to the nearest other cells first, and what they find
there shrinks the radius before they ask further; only the last round visits every cell that the radius still reaches. Copies
are folded into one weighted point beforehand, so a hot group of copies is a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenkeel.session import cut_lineage

CELL_POINTS = 2_000          # points one cell should hold
OVERFULL = 2                 # a cell of more than this many times CELL_POINTS is cut again
FAN = 16_384                 # cells that one node of the tree is cut into at most
BOXED = 16                   # the boxes of all cells go to every task if there are at most this many times FAN
SAMPLE_PER_CELL = 24
LEAF_SAMPLE = 36             # a cell holds at most this many of the sample
NEAREST_FIRST = (4,)         # cells a point visits in each round before the last one
VISIT_CHUNK = 50_000         # visiting points compared with a cell in one group
BLOCK = 256                  # rows of a distance matrix held at once
SORTED_BLOCK = 128           # the same, where rows are taken along the widest coordinate
SORTED_FROM = 512            # points from which on only those near along the widest coordinate are compared
ASKING = 1_024               # points that go down the tree of boxes at once


@dataclass(frozen=True)
class Splits:
    """A binary tree of coordinate cuts; a negative child is the cell -(child + 1)."""
    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray        # (nodes, 2)

    def cell(self, v: np.ndarray) -> np.ndarray:
        if not len(self.dim):
            return np.zeros(len(v), dtype=np.int64)
        node = np.zeros(len(v), dtype=np.int64)
        while (node >= 0).any():
            go = node >= 0
            at = node[go]
            right = v[np.flatnonzero(go), self.dim[at]] >= self.cut[at]
            node[go] = self.child[at, right.astype(int)]
        return -node - 1


def _cut(values: np.ndarray) -> float | None:
    """Where to cut: the widest gap of the middle half, so that clusters stay whole; else any place that leaves two parts."""
    v = np.sort(values)
    quarter = len(v) // 4
    gaps = np.diff(v[quarter:len(v) - quarter])
    if len(gaps) and gaps.max() > 0:
        return v[quarter + int(gaps.argmax()) + 1]
    above = v[v > v[0]]
    return above[0] if len(above) else None


def learn_splits(sample: np.ndarray, leaf: int) -> Splits:
    """Cut the sample along the widest coordinate until a part holds at most `leaf` of it."""
    dim, cut, child = [], [], []
    cells = 0
    work = [(np.arange(len(sample)), None, 0)]
    while work:
        rows, parent, side = work.pop()
        part = sample[rows]
        best = None
        if len(rows) > leaf:
            for d in np.argsort(-(part.max(0) - part.min(0)), kind="stable"):
                at = _cut(part[:, d])
                if at is None:
                    break                             # the widest coordinate is constant: all points are alike
                right = part[:, d] >= at
                share = min(right.mean(), 1 - right.mean())
                if best is None or share > best[0]:
                    best = (share, d, at, right)
                if share >= 0.2:
                    break
        if best is None:
            place, cells = -(cells + 1), cells + 1
        else:
            place = len(dim)
            dim.append(best[1])
            cut.append(best[2])
            child.append([0, 0])
            work += [(rows[best[3]], place, 1), (rows[~best[3]], place, 0)]
        if parent is not None:
            child[parent][side] = place
    return Splits(np.array(dim, dtype=int), np.array(cut), np.array(child, dtype=int).reshape(-1, 2))


SLACK = 1 + 1e-9             # a radius is widened by this much against rounding


def _squares(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    gap = np.zeros((len(block), len(points)))
    for d in range(points.shape[1]):
        gap += (block[:, d, None] - points[None, :, d]) ** 2
    return gap


def _smallest(gap: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the m smallest of each row, in order; ties go to the lower column."""
    near = np.sort(np.argpartition(gap, m - 1, axis=1)[:, :m], axis=1)
    dist = np.take_along_axis(gap, near, axis=1)
    edge = dist.max(axis=1)
    for i in np.flatnonzero((gap <= edge[:, None]).sum(axis=1) > m):      # a tie at the edge
        tied = np.flatnonzero(gap[i] <= edge[i])
        near[i] = np.sort(tied[np.argsort(gap[i, tied], kind="stable")[:m]])
        dist[i] = gap[i, near[i]]
    rank = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(near, rank, axis=1), np.take_along_axis(dist, rank, axis=1)


def closest(asking: np.ndarray, points: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of the m <= len(points) nearest points of each asking one; ties go to the lower position.

    Blocks of asking points are taken along the widest coordinate: the nearest of a few there bound the stretch of it that the
    block has to look at. A point without some coordinate has no distances and is left to the plain comparison.
    """
    near, dist = np.empty((len(asking), m), dtype=np.int64), np.empty((len(asking), m))
    sound = np.flatnonzero(np.isfinite(points).all(axis=1))
    plain = np.arange(len(asking))
    if len(points) > SORTED_FROM and len(sound) > m:
        part = points[sound]
        wide = np.argsort(part.min(axis=0) - part.max(axis=0), kind="stable")[:2][::-1]      # the widest decides, the next one ties
        order = np.lexsort(part[:, wide].T)
        x, held = part[order, wide[-1]], sound[order]
        whole = np.isfinite(asking).all(axis=1)
        plain, rows = np.flatnonzero(~whole), np.flatnonzero(whole)
        rows = rows[np.lexsort(asking[np.ix_(rows, wide)].T)]
        for start in range(0, len(rows), SORTED_BLOCK):
            mine = rows[start:start + SORTED_BLOCK]
            block = asking[mine]
            low, high = block[0, wide[-1]], block[-1, wide[-1]]
            middle = (np.searchsorted(x, low) + np.searchsorted(x, high, "right")) // 2
            half = len(mine) // 2 + m
            begin = max(0, min(middle - half, len(x) - m))
            bound = np.partition(_squares(block, points[held[begin:max(begin + m, middle + half)]]), m - 1, axis=1)[:, m - 1]
            reach = np.sqrt(bound.max()) * SLACK
            begin, end = np.searchsorted(x, low - reach), np.searchsorted(x, high + reach, "right")
            there = np.sort(held[begin:end])                      # positions keep their order, so ties go as they should
            at, dist[mine] = _smallest(_squares(block, points[there]), m)
            near[mine] = there[at]
    for start in range(0, len(plain), BLOCK):
        mine = plain[start:start + BLOCK]
        near[mine], dist[mine] = _smallest(_squares(asking[mine], points), m)
    return near, dist


def nearest_in(asking: np.ndarray, ask_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, weights: np.ndarray,
               k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position of the point, squared distance), in order: for each asking point its nearest others up to total weight k,
    ties by id; none beyond its squared `reach`."""
    order = np.argsort(ids)                       # positions follow the ids, so a tie goes to the lower position
    if not len(asking) or not len(order):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    near, dist = closest(asking, points[order], min(k + 1, len(order)))       # one more, as a point may meet itself
    near = order[near]
    weight = np.where(ids[near] == ask_ids[:, None], 0, weights[near])        # a point is no neighbour of itself
    keep = (weight > 0) & (np.cumsum(weight, axis=1) - weight < k)
    if reach is not None:
        keep &= dist <= reach[:, None] * SLACK
    i, j = np.nonzero(keep)
    return i, near[i, j], dist[i, j]


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix; a missing coordinate is NaN."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(whole), -1) if len(whole) else np.zeros((0, 1))


def lists(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a column of lists; NULL where `missing`."""
    values = pa.array(rows.ravel(), pa.float64(), mask=None if missing is None else missing.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), values)


def _matrix(pdf: pd.DataFrame, column: str = "v") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _sampled(points: DataFrame, share, mark: Column) -> DataFrame:
    """A repeatable sample by the hash of a point's `mark`; `share` may be a column."""
    return points.where(F.pmod(F.xxhash64(F.lit("sample"), mark), F.lit(1 << 20)) < F.ceil(share * F.lit(float(1 << 20))))


def _parted(left: DataFrame, right: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with `part`: a key with many rows on the left is cut into parts, its rows on the right are repeated."""
    load = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_parts"))
    cut = left.join(load, key).withColumn("part", F.pmod(F.xxhash64("pid"), F.col("_parts").cast("bigint")).cast("int"))
    repeated = right.join(load, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return cut.drop("_parts"), repeated.drop("_parts")


def _first_level(points: DataFrame, n: int, cell_points: int, fan: int, mark: Column) -> DataFrame:
    cells = min(fan, -(-n // cell_points))
    want = cells * SAMPLE_PER_CELL
    picked = _sampled(points.where("head"), F.lit(min(1.0, 1.2 * want / n)), mark).select("v").limit(2 * want).toArrow()   # bounded; only places cuts
    splits = learn_splits(vectors(picked.column("v")), LEAF_SAMPLE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = splits.cell(vectors(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f"{c:06d}" for c in cell.tolist()], pa.string())], names=[*batch.schema.names, "c1"])

    return points.mapInArrow(place, f"{_typed(points)}, c1 string")


def _typed(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _next_level(celled: DataFrame, level: int, cell_points: int, fan: int, chunk: int, overfull: int, mark: Column) -> DataFrame:
    """Cut the cells of a level that hold too much again; the others go on as their own only child."""
    above, below = f"c{level}", f"c{level + 1}"
    wanted = F.least(F.lit(fan), F.ceil(F.col("_n") / F.lit(cell_points)))
    big = (celled.where("head").groupBy(above).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > overfull * cell_points)
           .withColumn("_share", F.least(F.lit(1.0), 1.2 * wanted * SAMPLE_PER_CELL / F.col("_n"))).drop("_n"))
    sample = _sampled(celled.where("head").join(big, above), F.col("_share"), mark).select(above, "v")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = learn_splits(_matrix(pdf), LEAF_SAMPLE)
        return pd.DataFrame({above: pdf[above].iloc[:1].to_numpy(), "dim": [tree.dim], "cut": [tree.cut], "child": [tree.child.ravel()]})

    trees = cut_lineage(sample.groupBy(above).applyInPandas(
        learn, f"{above} string, dim array<long>, cut array<double>, child array<long>"))

    def place(pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*pdf.columns.drop("part"), below])
        splits = Splits(np.array(tree["dim"].iloc[0], dtype=int), np.array(tree["cut"].iloc[0]),
                        np.array(tree["child"].iloc[0], dtype=int).reshape(-1, 2))
        return pdf.drop(columns="part").assign(**{below: [f"{a}.{c:06d}" for a, c in zip(pdf[above], splits.cell(_matrix(pdf)))]})

    names = celled.columns
    inside, repeated = _parted(celled.join(trees.select(above), above, "left_semi").select(*names), trees, above, chunk)
    cut = inside.select(*names, "part").groupBy(above, "part").cogroup(repeated.groupBy(above, "part")).applyInPandas(
        place, f"{_typed(celled)}, {below} string")
    whole = celled.join(trees.select(above), above, "left_anti").select(*names, F.concat(above, F.lit(".")).alias(below))
    return cut.unionByName(whole)


def _boxes(celled: DataFrame, level: int, width: int) -> DataFrame:
    """(above, node, n, lo, hi): the number of points and their box for each cell of a level."""
    above = F.col(f"c{level - 1}") if level > 1 else F.lit("")
    ends = [f(F.col("v")[d]).alias(f"{name}{d}") for d in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
    return (celled.where("head").groupBy(above.alias("above"), F.col(f"c{level}").alias("node")).agg(F.count(F.lit(1)).alias("n"), *ends)
            .select("above", "node", "n", F.array(*[f"lo{d}" for d in range(width)]).alias("lo"),
                    F.array(*[f"hi{d}" for d in range(width)]).alias("hi")))


ASKED = "v array<double>, r2 double, home string, above string, gap double"


@dataclass(frozen=True)
class BoxTree:
    """Boxes in a binary tree: a node's box holds those of its two children, so a point looks at few of them."""
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray        # (nodes, 2)
    box: np.ndarray          # the box of a leaf, else -1

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray) -> "BoxTree":
        middle = low / 2 + high / 2
        lows, highs, child, box = [], [], [], []
        work = [(np.arange(len(low)), None, 0)]
        while work:
            rows, parent, side = work.pop()
            here = len(box)
            if parent is not None:
                child[parent][side] = here
            lows.append(np.fmin.reduce(low[rows]))
            highs.append(np.fmax.reduce(high[rows]))
            child.append([0, 0])
            box.append(int(rows[0]) if len(rows) == 1 else -1)
            if len(rows) > 1:
                part = middle[rows]
                widest = int(np.argmax(np.fmax.reduce(part) - np.fmin.reduce(part)))
                halves = rows[np.argsort(part[:, widest], kind="stable")]
                work += [(halves[len(rows) // 2:], here, 1), (halves[:len(rows) // 2], here, 0)]
        return BoxTree(np.array(lows), np.array(highs), np.array(child), np.array(box))

    def met(self, v: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, box, squared gap) of the pairs where a row's radius reaches a box."""
        row, node, found = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), []
        while len(row):
            gap = np.zeros(len(row))
            for d in range(v.shape[1]):
                x = v[row, d]
                gap += np.maximum(0.0, np.maximum(self.low[node, d] - x, x - self.high[node, d])) ** 2
            go = gap <= r2[row] * SLACK
            row, node, gap = row[go], node[go], gap[go]
            leaf = self.box[node] >= 0
            found.append((row[leaf], self.box[node[leaf]], gap[leaf]))
            row, node = np.repeat(row[~leaf], 2), self.child[node[~leaf]].ravel()
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (row, row, np.zeros(0))


def _reached(asking: pd.DataFrame, nodes: np.ndarray, boxes: BoxTree, first: int | None) -> Iterator[pd.DataFrame]:
    """Each asking point with the nodes whose box its radius reaches, the `first` nearest if given; never its own cell."""
    for start in range(0, len(asking), ASKING):
        part = asking.iloc[start:start + ASKING]
        i, c, gap = boxes.met(_matrix(part), part["r2"].to_numpy())
        other = nodes[c] != part["home"].to_numpy()[i]
        i, c, gap = i[other], c[other], gap[other]
        if first is not None and len(i):
            order = np.lexsort((c, gap, i))
            i, c, gap = i[order], c[order], gap[order]
            begins = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            place = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
            i, c, gap = i[place < first], c[place < first], gap[place < first]
        yield part[["pid", "v", "r2", "home"]].iloc[i].assign(above=nodes[c], gap=gap)


def _further(first: int | None):
    def worker(pdf: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(nodes):
            return pd.DataFrame(columns=["pid", "v", "r2", "home", "above", "gap"])
        return pd.concat(list(_reached(pdf, nodes["node"].to_numpy(), BoxTree.of(_matrix(nodes, "lo"), _matrix(nodes, "hi")), first)))

    return worker


def _descend(asking: DataFrame, top: tuple[np.ndarray, BoxTree], lower: list[DataFrame], first: int | None,
             chunk: int) -> DataFrame:
    """(pid, v, r2, cell): the cells each point still has to ask, level by level; a point keeps its `first` nearest nodes of
    a level, and one more above the last level, where its own cell's node is among them."""
    keep = first if first is None or not lower else first + 1

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _reached(pdf, *top, keep)

    asked_type = f"pid {asking.schema['pid'].dataType.simpleString()}, {ASKED}"
    front = asking.mapInPandas(start, asked_type)
    for depth, boxes in enumerate(lower):
        keep = first if first is None or depth == len(lower) - 1 else first + 1

        asked, repeated = _parted(cut_lineage(front), boxes, "above", chunk)
        front = asked.groupBy("above", "part").cogroup(repeated.groupBy("above", "part")).applyInPandas(_further(keep), asked_type)
        if first is not None:
            nearest = W.partitionBy("pid").orderBy("gap", "above")
            front = front.withColumn("_no", F.row_number().over(nearest)).where(F.col("_no") <= keep).drop("_no")
    return front.select("pid", "v", "r2", F.col("above").alias("cell"))


def nearest_neighbours(points: DataFrame, k: int, cell_points: int = CELL_POINTS, visit_chunk: int = VISIT_CHUNK,
                       fan: int = FAN) -> DataFrame:
    """(pid, nid, d2, w, nv, place) for distinct weighted points (pid, w long, v array<double>).

    Per pid the nearest other points in order of (squared distance, nid), as many as total weight k needs.
    """
    return search_cells(points, k, cell_points, visit_chunk, fan)[0]


def search_cells(points: DataFrame, k: int, cell_points: int = CELL_POINTS, visit_chunk: int = VISIT_CHUNK,
                 fan: int = FAN) -> tuple[DataFrame, DataFrame | None, int]:
    """(neighbours as above, (pid, cell) of every visit beyond the own cell, number of cells)."""
    kind = points.schema["pid"].dataType.simpleString()

    def listed(own: Rows, i: np.ndarray, near: "Near") -> pa.RecordBatch:
        place = np.arange(len(i)) - np.searchsorted(i, i) + 1
        return pa.RecordBatch.from_arrays([pa.array(own.pid[i]), pa.array(near.nid), pa.array(near.d2), pa.array(near.w), lists(near.v),
                                           pa.array(place, pa.int32())], names=["pid", "nid", "d2", "w", "nv", "place"])

    asking = points.select("pid", "w", "v", F.lit(True).alias("head"), F.lit(True).alias("asks"), F.lit(None).cast("array<bigint>").alias("load"))
    return search(asking, k, listed, f"pid {kind}, nid {kind}, d2 double, w long, nv array<double>, place int", cell_points, visit_chunk, fan)


@dataclass(frozen=True)
class Rows:
    """Some rows of points: ids, weights, vectors (missing coordinates NaN), and what they carry."""
    pid: np.ndarray
    w: np.ndarray
    v: np.ndarray
    load: pa.Array

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> "Rows":
        load = table.column("load")
        return Rows(table.column("pid").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("pid").to_numpy(),
                    table.column("w").to_numpy(), vectors(table.column("v")), load.combine_chunks() if isinstance(load, pa.ChunkedArray) else load)

    def take(self, at: np.ndarray) -> "Rows":
        return Rows(self.pid[at], self.w[at], self.v[at], self.load.take(pa.array(at)))


@dataclass(frozen=True)
class Near:
    """Neighbours, one an entry: id, squared distance, weight and vector."""
    nid: np.ndarray
    d2: np.ndarray
    w: np.ndarray
    v: np.ndarray


DONE, FOUND, OPEN = range(3)       # a row of the first round: a result, a neighbour of an open point, or an open point


def search(points: DataFrame, k: int, finish: Callable[[Rows, np.ndarray, Near], pa.RecordBatch], out: str, cell_points: int = CELL_POINTS,
           visit_chunk: int = VISIT_CHUNK, fan: int = FAN, overfull: int = OVERFULL, mark: Column | None = None,
           ) -> tuple[DataFrame, DataFrame | None, int]:
    """(results, (pid, cell) of every visit beyond the own cell, number of cells) for rows (pid, w, v, head, asks, load).

    A point is one row or several, of which one is its `head`; rows that `ask` get their neighbours. `finish` makes rows of schema
    `out` from some rows, and for each of their neighbours, in order, the row's number and the neighbour. It runs where a row's
    neighbours become known: mostly in the task of its cell, so that neighbour lists are neither written nor moved.
    """
    n = points.where("head").count()
    kind = points.schema["pid"].dataType.simpleString()
    mark = F.col("pid") if mark is None else mark
    found_type = f"pid {kind}, nid {kind}, d2 double, w long, nv array<double>"
    if n <= cell_points:
        celled, level, cells, top, lower = points.withColumn("c1", F.lit("")), 1, 1, None, []
    else:
        width = len(points.select("v").first()["v"])
        celled, level, largest, boxes = _first_level(points, n, cell_points, fan, mark), 1, n, []
        while True:
            boxes.append(cut_lineage(_boxes(celled, level, width)))
            now, cells = boxes[-1].agg(F.max("n"), F.count(F.lit(1))).first()
            if now <= overfull * cell_points or now == largest:         # small enough, or no cut helps
                break
            largest = now
            celled, level = cut_lineage(_next_level(celled, level, cell_points, fan, visit_chunk, overfull, mark)), level + 1
        known = len(boxes) - 1 if cells <= BOXED * fan else 0            # the boxes that every task has
        roots, lower = boxes[known].select("node", "lo", "hi").toArrow(), boxes[known + 1:]
        top = (np.array(roots.column("node").to_pylist(), dtype=object), BoxTree.of(vectors(roots.column("lo")), vectors(roots.column("hi"))))
    cell = f"c{level}"
    inner = bool(lower)                          # a box that is known holds more cells than the own one
    rest = [("pid", kind), ("nid", kind), ("d2", "double"), ("nw", "long"), ("nv", "array<double>"), ("w", "long"), ("v", "array<double>"),
            ("load", points.schema["load"].dataType.simpleString()), ("head", "boolean"), ("r2", "double"), ("home", "string")]
    names = ["kind", *[f"o_{c.split(' ')[0]}" for c in out.split(", ")], *[f"s_{c}" for c, _ in rest]]
    types = ["int", *[c.split(" ")[1] for c in out.split(", ")], *[t for _, t in rest]]
    arrow = pa.schema([(c, _ARROW[t]) for c, t in zip(names, types)])

    def table(what: int, rows: int, **columns) -> pa.Table:
        return pa.table([pa.array(np.full(rows, what), pa.int32()) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(rows, f.type)
                         for f in arrow], schema=arrow)

    def inside(group: pa.Table) -> pa.Table:
        hosts, home = Rows.of(group.filter(group.column("head"))), group.column(cell)[0].as_py()
        ask = group.filter(group.column("asks")).sort_by([("pid", "ascending"), ("head", "descending")])
        own = Rows.of(ask)
        i, at, d2 = nearest_in(own.v, own.pid, hosts.v, hosts.pid, hosts.w, k)
        r2 = np.full(len(own.pid), np.inf)
        total = np.bincount(i, hosts.w[at], minlength=len(r2))
        last = np.flatnonzero(np.append(i[1:] != i[:-1], True)) if len(i) else i
        r2[i[last]] = d2[last]
        r2[total < k] = np.inf                  # the radius is final only when weight k is found
        still = np.full(len(r2), inner)
        for start in range(0, 0 if inner or top is None else len(r2), ASKING):
            row, box, _ = top[1].met(own.v[start:start + ASKING], r2[start:start + ASKING])
            still[start + row[top[0][box] != home]] = True
        parts = []
        for these in (~still, still):
            number = np.cumsum(these) - 1
            of = these[i]
            near = Near(hosts.pid[at[of]], d2[of], hosts.w[at[of]], hosts.v[at[of]])
            some, j = own.take(np.flatnonzero(these)), number[i[of]]
            if these is not still:
                made = finish(some, j, near)
                parts.append(table(DONE, made.num_rows, **{f"o_{c}": x for c, x in zip(made.schema.names, made.columns)}))
            elif len(some.pid):
                there = np.flatnonzero(these)
                head = ask.column("head").combine_chunks().take(pa.array(there))
                # of a point of several rows the head asks
                asked = head.to_numpy(zero_copy_only=False)[j]
                parts.append(table(FOUND, int(asked.sum()), s_pid=pa.array(some.pid[j[asked]]), s_nid=pa.array(near.nid[asked]), s_d2=pa.array(near.d2[asked]),
                                   s_nw=pa.array(near.w[asked]), s_nv=lists(near.v[asked])))
                parts.append(table(OPEN, len(there), s_pid=pa.array(some.pid), s_w=pa.array(some.w), s_v=ask.column("v").combine_chunks().take(pa.array(there)),
                                   s_load=some.load, s_head=head, s_r2=pa.array(r2[there]), s_home=pa.array([home] * len(there), pa.string())))
        return pa.concat_tables(parts)

    own = celled.select("pid", "w", "v", "head", "asks", "load", cell).where("head OR asks").groupBy(cell).applyInArrow(
        inside, ", ".join(f"{c} {t}" for c, t in zip(names, types)))
    result = [F.col(f"o_{c.split(' ')[0]}").alias(c.split(" ")[0]) for c in out.split(", ")]
    if top is None:
        return own.where(F.col("kind") == DONE).select(*result), None, 1
    own = cut_lineage(own)
    done = own.where(F.col("kind") == DONE).select(*result)
    opened = own.where(F.col("kind") == OPEN).select(*[F.col(f"s_{c}").alias(c) for c in ("pid", "w", "v", "load", "head", "r2", "home")])
    none = opened.select("pid", F.col("home").alias("cell")).limit(0)
    if opened.isEmpty():
        return done, none, cells
    found = own.where(F.col("kind") == FOUND).select(*[F.col(f"s_{c}").alias(a) for c, a in zip(("pid", "nid", "d2", "nw", "nv"), ("pid", "nid", "d2", "w", "nv"))])
    homes = celled.where("head").select("pid", "w", "v", F.col(cell).alias("cell"))

    def across(guests: pa.Table, home: pa.Table) -> pa.Table:
        v, ids, host, w = vectors(home.column("v")), home.column("pid").to_numpy(), guests.column("pid").to_numpy(), home.column("w").to_numpy()
        i, at, d2 = nearest_in(vectors(guests.column("v")), host, v, ids, w, k, guests.column("r2").to_numpy())
        near = v[at] if len(at) else np.zeros((0, 1))
        return pa.table([pa.array(host[i]), pa.array(ids[at]), pa.array(d2), pa.array(w[at]), lists(near)], names=["pid", "nid", "d2", "w", "nv"]).cast(
            pa.schema([("pid", _ARROW[kind]), ("nid", _ARROW[kind]), ("d2", pa.float64()), ("w", pa.int64()), ("nv", pa.list_(pa.float64()))]))

    heads = opened.where("head")
    asking, visited = heads.select("pid", "v", "r2", "home"), None
    for first in (*NEAREST_FIRST, None):
        if visited is not None:
            reach = found.groupBy("pid").agg(F.sum("w").alias("_w"), F.max("d2").alias("_d"))
            asking = heads.join(reach, "pid", "left").select(
                "pid", "v", F.when(F.col("_w") >= k, F.col("_d")).otherwise(F.lit(float("inf"))).alias("r2"), "home")
        visits = _descend(asking, top, lower, first, visit_chunk)
        if visited is not None:
            visits = visits.join(visited, ["pid", "cell"], "left_anti")
        visits = cut_lineage(visits)
        asked, hosts = _parted(visits, homes, "cell", visit_chunk)
        more = asked.groupBy("cell", "part").cogroup(hosts.groupBy("cell", "part")).applyInArrow(across, found_type)
        found = cut_lineage(_ranked(found.unionByName(more), k).drop("place")) if first else _ranked(found.unionByName(more), k)
        seen = visits.select("pid", "cell")
        visited = seen if visited is None else visited.unionByName(seen)
    near = found.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("place", "nid", "d2", "w", "nv"))).alias("near"))  # <= k entries

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("near")
            flat, rows = held.flatten(), Rows.of(batch)
            sizes = np.diff(held.offsets.to_numpy()) if len(held) else np.zeros(0, dtype=np.int64)
            nid, d2, w, v = (flat.field(c) for c in ("nid", "d2", "w", "nv"))
            yield finish(rows, np.repeat(np.arange(len(held)), sizes), Near(nid.to_numpy(zero_copy_only=False), d2.to_numpy(zero_copy_only=False),
                                                                           w.to_numpy(zero_copy_only=False), vectors(v)))

    nothing = F.array().cast(f"array<struct<place:int,nid:{kind},d2:double,w:bigint,nv:array<double>>>")
    rest = opened.join(near, "pid", "left").select("pid", "w", "v", "load", F.coalesce("near", nothing).alias("near"))
    return done.unionByName(rest.mapInArrow(late, out)), visited, cells


_ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Keep each point's nearest, at most k rows per visited cell, up to total weight k."""
    order = W.partitionBy("pid").orderBy("d2", "nid")
    return (found.withColumn("_before", F.coalesce(
        F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("place", F.row_number().over(order)).where(F.col("_before") < k).drop("_before"))

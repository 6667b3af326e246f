"""Pearson, Spearman and Kendall matrices with pairwise deletion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.scalars import to_number
from evenkeel.operators.gates import columns_by_kind
from evenkeel.plans.comoments import co_moments, pearson
from evenkeel.plans.order import cut_points, cuts_of_all, with_bucket
from evenkeel.plans.ranks import rank_moments, sliced
from evenkeel.session import cut_lineage, on_all_cores

SCHEMA = "column_a string, column_b string, corr double"
GROUP_POINTS = 2_000_000     # points one task counts
SHORT_BITS = 5               # rows of a block whose pairs are compared one by one, as a power of two
SLICE_ROWS = 50_000          # rows of a slice at least, if the table is small
MOST_SLICES = 1 << 20        # slices of all rankings together, whose counts the driver holds


def correlation(df: DataFrame, method: str = "pearson", cols: Sequence[str] | None = None,
                group_points: int = GROUP_POINTS) -> DataFrame:
    """One row per ordered pair of numeric columns; NULL where a column does not vary."""
    cols = list(cols) if cols is not None else columns_by_kind(df)[0]
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    # adding 0.0 makes one value of the two zeros, which slices tell apart
    nums = df.select(*[(to_number(F.col(f"`{c}`")) + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = list(combinations(range(len(cols)), 2))
    seen = nums.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in nums.columns for f in (F.avg, F.min, F.max, F.count)]).first()
    if method == "pearson":
        half = _pearson(nums, pairs, [seen[f"avg_{c}"] or 0.0 for c in nums.columns])
    elif method == "spearman":
        half = _spearman(nums, pairs, seen["n"], [seen[f"count_{c}"] for c in nums.columns], max(1, group_points // 4))
    elif method == "kendall":
        half = _kendall(nums, pairs, group_points)
    else:
        raise ValueError(f"unknown method {method!r}")
    # a column correlates fully with itself if it varies at all
    rows = [(c, c, 1.0 if seen[f"min_c{i}"] is not None and seen[f"min_c{i}"] < seen[f"max_c{i}"] else None) for i, c in enumerate(cols)]
    for p, (i, j) in enumerate(pairs):
        rows += [(cols[i], cols[j], half.get(p)), (cols[j], cols[i], half.get(p))]
    return df.sparkSession.createDataFrame(rows, SCHEMA)      # one row per pair of columns


def _corr(a: Column, b: Column) -> Column:
    """corr() raises on a constant column under ANSI, so divide by a NULL-able product instead."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _pearson(nums: DataFrame, pairs: list[tuple[int, int]], means: Sequence[float]) -> dict[int, float | None]:
    """All pairs from one pass of matrix products; the few whose variance may be rounding alone are taken again one by one."""
    m = co_moments(nums, means)
    found = {p: pearson(m, i, j) for p, (i, j) in enumerate(pairs)}
    out = {p: r for p, (r, sure) in found.items() if sure}
    unsure = [p for p in found if p not in out]
    if unsure:
        row = nums.agg(*[_corr(F.col(f"c{pairs[p][0]}"), F.col(f"c{pairs[p][1]}")).alias(f"r{p}") for p in unsure]).first()
        out.update((p, row[f"r{p}"]) for p in unsure)
    return out


def rankings(present: np.ndarray) -> tuple[list[tuple[int, int | None]], dict[tuple[int, int], int]]:
    """Which columns are to be ranked on which rows, from the numbers of rows that have both of two columns.

    ((column, other) or (column, None), number of the ranking for each (column, partner)): a column is ranked on the rows
    that have its partner too. If all its rows do, that is the ranking of the whole column; partners that are
    missing in the same rows share one.
    """
    d, asked, which = len(present), [], {}
    for i in range(d):
        known: dict[int | None, int] = {}
        for j in range(d):
            if i == j:
                continue
            if present[i, j] == present[i, i]:
                other = None
            else:                                    # the first column that is missing exactly where j is
                other = next(k for k in range(d) if present[k, k] == present[j, j] == present[k, j])
            if other not in known:
                known[other] = len(asked)
                asked.append((i, other))
            which[i, j] = known[other]
    return asked, which


def _present(rows: DataFrame, n: int, there: Sequence[int]) -> np.ndarray:
    """The number of rows that have both of two columns; only columns with missing values are looked at."""
    out = np.array([[b if a == n else a for b in there] for a in there])
    holes = [i for i, a in enumerate(there) if a < n]
    if len(holes) > 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(holes), len(holes)))
            for batch in batches:
                mask = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                total += mask.T @ mask
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "n"])

        both = rows.select(*[f"c{i}" for i in holes]).mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
        for r in both.collect():                             # one row a pair of columns
            out[holes[r["i"]], holes[r["j"]]] = int(r["n"])
    return out


def _spearman(nums: DataFrame, pairs: list[tuple[int, int]], n: int, there: Sequence[int], slice_rows: int) -> dict[int, float | None]:
    """Pearson of average ranks, each pair ranked on its own complete rows; n rows, of which columns have `there` values.

    Columns are cut into slices of values, which counts put in place; ranks are worked out within slices, and only of values
    whose slice holds others too: two shuffles of packed values, whatever the number of columns or rankings.
    """
    # the row numbers are written, so that a lost executor cannot deal them out anew, and in order, so that blocks lie together
    rows = cut_lineage(on_all_cores(nums, n).withColumn("id", F.monotonically_increasing_id())).select("id", *nums.columns)
    asked, which = rankings(_present(rows, n, there))
    # a small table has slices enough for its tasks
    size = min(slice_rows, max(SLICE_ROWS, n // 64))
    cuts = cuts_of_all(rows.select(*nums.columns), n, size, max(2, MOST_SLICES // len(asked)))
    m = rank_moments(rows, sliced(rows, asked, [cuts[c] for c in nums.columns]))
    # ranks are multiples of a half about their mean: a variance is either 0 or at least a quarter
    return {p: pearson(m, which[i, j], which[j, i])[0] for p, (i, j) in enumerate(pairs)}


def ordered_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Total weight of point pairs that rise, and that fall, from smaller to strictly larger x.

    The points, in x order, are split by the bits of their y rank from the top. At each bit, within
    points that agree on all higher bits, a one above a zero of smaller x rises and the reverse falls.
    """
    order = np.lexsort((y, x))
    xs, ws = x[order], w[order].astype(float)
    ranks = np.unique(y[order], return_inverse=True)[1].astype(np.int32)
    at = np.arange(len(xs), dtype=np.int64)
    head_start = np.zeros(len(xs), dtype=np.int64)
    rising = falling = 0.0
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        one = ((ranks >> bit) & 1).astype(bool)
        new_run = (at == head_start) | np.concatenate(([True], xs[1:] != xs[:-1]))
        run_start = np.maximum.accumulate(np.where(new_run, at, 0))
        zeros = np.concatenate(([0.0], np.cumsum(np.where(one, 0.0, ws))))
        ones = np.concatenate(([0.0], np.cumsum(np.where(one, ws, 0.0))))
        rising += float(np.dot(np.where(one, ws, 0.0), zeros[run_start] - zeros[head_start]))
        falling += float(np.dot(np.where(one, 0.0, ws), ones[run_start] - ones[head_start]))
        # zeros to the front of their group, ones behind them, both in x order
        low_before = np.concatenate(([0], np.cumsum(~one)))
        group_end = np.append(np.flatnonzero(at == head_start)[1:], len(xs))
        ends = np.repeat(group_end, np.diff(np.append(np.flatnonzero(at == head_start), len(xs))))
        lows = low_before[:-1] - low_before[head_start]
        middle = head_start + low_before[ends] - low_before[head_start]
        to = np.where(one, middle + (at - head_start - lows), head_start + lows)
        start = np.where(one, middle, head_start)
        moved = np.empty_like(order)
        moved[to] = at
        xs, ws, ranks, head_start = xs[moved], ws[moved], ranks[moved], start[moved]
    return rising, falling


def inversions(ranks: np.ndarray) -> int:
    """Pairs whose first rank is larger than the second: counted pair by pair in short blocks, then, as blocks are sorted
    together two by two, from the places that the first block's rows take."""
    n, bits = len(ranks), max(SHORT_BITS, int(len(ranks) - 1).bit_length())
    key = np.full(1 << bits, int(ranks.max(initial=0)) + 1, dtype=np.int64)      # filled up with rows that exceed all others
    key[:n] = ranks
    rows = np.ascontiguousarray(key.reshape(-1, 1 << SHORT_BITS).T).astype(np.int32)
    found = sum(int(np.count_nonzero(rows[:-s] > rows[s:])) for s in range(1, 1 << SHORT_BITS))
    key = (key << bits) | np.arange(1 << bits)                   # of equal ranks the first stays first
    for bit in range(SHORT_BITS, bits):
        block = key.reshape(-1, 2 << bit)
        block.sort(axis=1)
        # rows that a first-block row has before it, less those of its own block
        of_first = ((block >> bit) & 1 == 0).sum(axis=0)
        found += int(of_first @ np.arange(2 << bit)) - len(block) * ((1 << bit) * ((1 << bit) - 1) // 2)
    return found


def unit_pairs(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """`ordered_pairs` of points of weight 1, whose coordinates are whole numbers from 0, such as ranks."""
    bits = int(y.max(initial=0)).bit_length()
    both = np.sort((x.astype(np.int64) << bits) | y)             # within one x no pair falls
    falling = inversions(both & ((1 << bits) - 1))
    rising = len(both) * (len(both) - 1) // 2 - falling - _ties(both >> bits) - _ties(np.sort(y)) + _ties(both)
    return float(rising), float(falling)


def _ties(ordered: np.ndarray) -> int:
    """Pairs of equal values."""
    sizes = np.diff(np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)])))
    return int((sizes * (sizes - 1) // 2).sum())


def _count_group(pdf: pd.DataFrame) -> pd.DataFrame:
    up, down = ordered_pairs(*(pdf[c].to_numpy() for c in ("x", "y", "w")))
    return pd.DataFrame({"pair": [int(pdf["pair"].iloc[0])], "up": [up], "down": [down]})


COUNTED = "pair int, up double, down double"


def pair_totals(points: DataFrame, group_points: int = GROUP_POINTS) -> dict[int, tuple[float, float]]:
    """(concordant, discordant) weight of all pairs of weighted points (pair, x, y, w), per `pair`.

    Beyond one task's share, both axes are cut into slices. A pair of points lies within one x slice,
    or within one y slice across x slices, or in different slices on both axes. The first two are
    counted inside slices, the last one on the much smaller grid of slice totals, in the same way.
    """
    found: dict[int, list[float]] = {}

    def add(counted: DataFrame) -> None:
        for r in counted.groupBy("pair").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).collect():
            total = found.setdefault(r["pair"], [0.0, 0.0])
            total[0], total[1] = total[0] + r["up"], total[1] + r["down"]

    while True:
        sizes = [r["count"] for r in points.groupBy("pair").count().collect()]     # one row per pair of columns
        if max(sizes, default=0) <= group_points:
            add(points.groupBy("pair").applyInPandas(_count_group, COUNTED))
            return {p: (up, down) for p, (up, down) in found.items()}
        # at most half as many slices as points in a slice, so the grid shrinks at every turn
        cuts = {c: cut_points(points, c, group_points, max(2, group_points // 2)) for c in ("x", "y")}
        sliced = with_bucket(with_bucket(points, "x", cuts["x"], "bx"), "y", cuts["y"], "by")
        merged = (sliced.groupBy("pair", "by", "bx", "y").agg(F.sum("w").alias("w"))
                  .select("pair", "by", F.col("bx").cast("double").alias("x"), "y", "w"))
        for part, axis, slot in ((sliced, "x", "bx"), (merged, "y", "by")):
            # ties never form a counted pair, so slices made of one hot value need no pass
            mixed = part.groupBy("pair", slot).agg(F.min(axis).alias("a"), F.max(axis).alias("b")).where("a < b")
            kept = part.join(F.broadcast(mixed.select("pair", slot)), ["pair", slot], "left_semi")  # <= MAX_BUCKETS per pair
            add(kept.groupBy("pair", slot).applyInPandas(_count_group, COUNTED))
        points = (sliced.groupBy("pair", "bx", "by").agg(F.sum("w").alias("w"))
                  .select("pair", F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "w"))


def _kendall(nums: DataFrame, pairs: list[tuple[int, int]], group_points: int) -> dict[int, float | None]:
    """tau-b with ties, all pairs of columns together.

    Every column is cut into slices. A row goes once to each of its slices with all its values, so d columns take d
    copies of a row, not one for each pair. Of two rows, either both lie in one slice of x, which counts them
    there; or in one slice of y, which counts them there by the slices of x; or they differ in both slices, and then
    only the grid of slice totals is needed. A task holds the rows of one slice and counts its pairs one after another.
    """
    d = len(nums.columns)
    n = nums.count()
    # a small table has slices enough for its tasks, a large one slices that fit a task
    slice_rows = min(group_points, max(SLICE_ROWS, n // 64))
    cuts = cuts_of_all(nums, n, slice_rows, max(2, group_points // 2))
    sliced = on_all_cores(nums, n)
    for i in range(d):
        sliced = with_bucket(sliced, f"c{i}", cuts[f"c{i}"], f"s{i}")
    sliced = cut_lineage(sliced.select(*[f"c{i}" for i in range(d)], *[F.when(F.col(f"c{i}").isNotNull(), F.col(f"s{i}")).alias(f"s{i}") for i in range(d)]))
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"s{i}").alias("slice"), F.col(f"c{i}").alias("v")) for i in range(d)]))
    # rows of a slice with one value only tie with each other: their number is enough
    mixed = (sliced.select(own.alias("o")).select("o.*").where("slice IS NOT NULL").groupBy("k", "slice")
             .agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("rows")))
    mixed = cut_lineage(mixed.where("a < b").select("k", "slice"))       # at most MAX_BUCKETS rows a column
    long = sliced.select("*", own.alias("o")).select("*", "o.k", "o.slice").drop("o").join(F.broadcast(mixed), ["k", "slice"], "left_semi")

    def first(i: int, j: int) -> int:
        """Which column of a pair is x: each is so for about half of its pairs, so that their slices take alike long."""
        return min(i, j) if (i + j) % 2 else max(i, j)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        c, s = ([rows.column(f"{x}{i}").to_numpy() for i in range(d)] for x in "cs")
        there, rank, out = [~np.isnan(x.astype(float)) for x in c], [], []
        for m in range(d):                                         # a column is sorted once, its pairs then are whole numbers
            rank.append(np.zeros(len(c[m]), dtype=np.int64))
            rank[m][there[m]] = np.unique(c[m][there[m]], return_inverse=True)[1]
        for m in range(d):
            if m == k:
                continue
            both = there[m]
            v = rank[k][both]
            out.append((k, m, float(_ties(np.sort(v))), 0.0, 0.0))
            if first(k, m) == k:                               # both rows in one slice of x
                up, down = unit_pairs(v, rank[m][both])
            else:                                              # both in one slice of y, by the slices of x
                x = s[m][both].astype(np.int64)
                up, down = unit_pairs(x, v) if len(x) and x.min() < x.max() else (0.0, 0.0)
            out.append((min(k, m), max(k, m), 0.0, up, down))
        return pa.table(list(map(pa.array, zip(*out))), names=["k", "m", "ties", "up", "down"]).cast(_COUNTED)

    counted = long.groupBy("k", "slice").applyInArrow(count, "k int, m int, ties double, up double, down double")
    inside = {(r["k"], r["m"]): r for r in counted.groupBy("k", "m").agg(*[F.sum(x).alias(x) for x in ("ties", "up", "down")]).collect()}
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"s{i}").cast("double").alias("x"), F.col(f"s{j}").cast("double").alias("y"))
                                for p, (i, j) in enumerate(pairs)]))
    grid = cut_lineage(sliced.select(cells.alias("o")).select("o.*").where("x IS NOT NULL AND y IS NOT NULL")
                       .groupBy("pair", "x", "y").agg(F.count("*").alias("w")))     # summed before the shuffle
    between = pair_totals(grid, group_points)
    rows = {r["pair"]: float(r["w"]) for r in grid.groupBy("pair").agg(F.sum("w").alias("w")).collect()}
    single: dict[tuple[int, int], float] = {}
    names = F.create_map(*[F.lit(v) for p, (i, j) in enumerate(pairs) for v in (2 * p, i, 2 * p + 1, j)])
    for axis, side in (("x", 0), ("y", 1)):
        sums = grid.groupBy("pair", F.col(axis).cast("int").alias("slice")).agg(F.sum("w").cast("double").alias("w"))
        alone = sums.withColumn("k", names[F.col("pair") * 2 + side]).join(F.broadcast(mixed), ["k", "slice"], "left_anti")
        for r in alone.groupBy("pair").agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("t")).collect():
            single[r["pair"], side] = r["t"]
    out = {}
    for p, (i, j) in enumerate(pairs):
        size = rows.get(p, 0.0)
        tied = [single.get((p, side), 0.0) + (inside[k, m]["ties"] if (k, m) in inside else 0.0) for side, (k, m) in enumerate(((i, j), (j, i)))]
        up, down = between.get(p, (0.0, 0.0))
        if (i, j) in inside:
            up, down = up + inside[i, j]["up"], down + inside[i, j]["down"]
        every = size * (size - 1) / 2
        den = ((every - tied[0]) * (every - tied[1])) ** 0.5
        out[p] = (up - down) / den if den else None
    return out


_COUNTED = pa.schema([("k", pa.int32()), ("m", pa.int32()), ("ties", pa.float64()), ("up", pa.float64()), ("down", pa.float64())])

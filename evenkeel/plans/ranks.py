"""Average ranks of many columns at once: one sort of a long table by ranges, one carry a range."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenkeel.plans.comoments import PARTIAL, CoMoments, summed
from evenkeel.session import cut_lineage

LOCAL = ("part int, open int, id long, g int, below long, ties long, "
         "first_g int, first_v double, first_n long, first_rows long, last_g int, last_v double, last_n long, last_below long, last_rows long")
INSIDE, FIRST, LAST, COUNT, LONG, DONE = range(6)
HELD_ROWS = 100_000          # rows of an open run that a task holds; the others wait in the written table for the run's size


class _Ranker:
    """The sorted rows of one range: ranks that begin anew, but for runs that may go on in another range.

    A run is held until its size is known. Of a long run the rows leave earlier, as LONG with the number of the run in place
    of `below`; a row DONE with this number as its id, and the kind of run as first_n, follows at its end."""

    def __init__(self, part: int, held_rows: int = HELD_ROWS):
        self.part, self.first, self.run, self.held, self.n, self.below = part, None, None, [], 0, 0
        self.held_rows, self.long, self.n_long = held_rows, None, 0

    def add(self, g: np.ndarray, v: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]) | (v[1:] != v[:-1])) + 1, [len(g)]))
        begin = 0
        if self.run == (int(g[0]), float(v[0])):                # goes on from the last batch
            begin = int(change[1])
            self.held.append(ids[:begin])
            self.n += begin
            if sum(map(len, self.held)) > self.held_rows:
                if self.long is None:
                    self.long, self.n_long = self.n_long, self.n_long + 1
                yield self._waiting()
        if begin == len(g):
            return
        if self.run is not None:
            yield from self._close()
        starts = change[np.searchsorted(change, begin):-1]
        sizes = np.diff(np.append(starts, len(g)))
        # all runs but the last one are closed here; positions begin anew with each g
        run_g = g[starts]
        before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        new_g = np.concatenate(([True], run_g[1:] != run_g[:-1]))
        at_start = before[np.maximum.accumulate(np.where(new_g, np.arange(len(starts)), 0))]
        below = before - at_start
        if self.run is not None and run_g[0] == self.run[0]:
            below = below + np.where(run_g == run_g[0], self.below + self.n, 0)
        whole = len(starts) - 1
        skip = 0
        if self.first is None:                                   # the range's first run is open
            if not whole:
                self._open(g, v, ids, starts[0], below[0])
                return
            self.run, self.held, self.n, self.below = (int(g[starts[0]]), float(v[starts[0]])), [ids[starts[0]:starts[1]]], int(sizes[0]), int(below[0])
            yield from self._close()
            skip = 1
        if whole > skip:
            lo, hi = starts[skip], starts[whole]
            yield self._rows(INSIDE, ids[lo:hi], g[lo:hi], np.repeat(below[skip:whole], sizes[skip:whole]), np.repeat(sizes[skip:whole], sizes[skip:whole]))
        self._open(g, v, ids, starts[whole], below[whole])

    def _open(self, g, v, ids, at, below) -> None:
        self.run, self.held, self.n, self.below = (int(g[at]), float(v[at])), [ids[at:]], len(ids) - int(at), int(below)

    def _rows(self, kind: int, ids, g, below, ties) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array(np.full(n, self.part, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(ids), pa.array(g.astype(np.int32)),
                   pa.array(np.asarray(below, np.int64)), pa.array(np.asarray(ties, np.int64))]
        return _local(columns, n)

    def _waiting(self) -> pa.RecordBatch:
        ids, self.held = np.concatenate(self.held), []
        return self._rows(LONG, ids, np.full(len(ids), self.run[0]), np.full(len(ids), self.long), np.zeros(len(ids)))

    def _close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        kind = INSIDE
        if self.first is None:
            self.first, kind = (*self.run, self.n), FIRST
        elif last:
            kind = LAST
        if self.long is None:
            ids = np.concatenate(self.held)
            yield self._rows(kind, ids, np.full(len(ids), self.run[0]), np.full(len(ids), self.below), np.full(len(ids), self.n))
            return
        if self.held:
            yield self._waiting()
        yield _marked({"part": self.part, "open": DONE, "id": self.long, "g": self.run[0], "below": self.below, "ties": self.n, "first_n": kind})
        self.long = None

    def finish(self, rows_of: dict[int, int]) -> Iterator[pa.RecordBatch]:
        if self.run is None:
            return
        yield from self._close(last=True)
        inner = {g: n for g, n in rows_of.items() if g not in (self.first[0], self.run[0])}
        if inner:                                                # columns that lie in this range as a whole
            k = len(inner)
            yield _local([pa.array(np.full(k, self.part, np.int32)), pa.array(np.full(k, COUNT, np.int32)), pa.nulls(k, pa.int64()),
                          pa.array(list(inner), pa.int32()), pa.nulls(k, pa.int64()), pa.array(list(inner.values()), pa.int64())], k)
        mark = {"part": self.part, "open": None, "first_g": self.first[0], "first_v": self.first[1], "first_n": self.first[2],
                "first_rows": rows_of[self.first[0]], "last_g": self.run[0], "last_v": self.run[1], "last_n": self.n,
                "last_below": self.below, "last_rows": rows_of[self.run[0]]}
        yield _marked(mark)


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split(" ") for c in LOCAL.split(", "))])


def _local(columns: list[pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, f.type) for f in list(_SCHEMA)[len(columns):]]], schema=_SCHEMA)


def _marked(mark: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([mark.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)


def average_ranks(long: DataFrame, held_rows: int = HELD_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """((id, g, rank), rows of each g) from rows (id long, g int, v double), v never NULL; ties share their mean position, from 1.

    The rows are dealt into ranges of (g, v, id), so neither a column nor a value that a third of the rows hold is
    one task's work. Each task ranks its own range and reports its first and its last run; the driver composes these
    reports (one a range, and one for each run of more than held_rows rows) and sends back, for each range, what stands before
    it and how large the cut runs are in all.
    """
    spark = long.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, rows_of = _Ranker(TaskContext.get().partitionId(), held_rows), {}
        for batch in batches:
            if batch.num_rows:
                ids, g, v = (batch.column(k).to_numpy() for k in range(3))
                for which, n in zip(*np.unique(g, return_counts=True)):
                    rows_of[int(which)] = rows_of.get(int(which), 0) + int(n)
                yield from ranker.add(g, v, ids)
        yield from ranker.finish(rows_of)

    ranged = long.select("id", "g", F.expr("v + 0.0D AS v")).repartitionByRange(parts, "g", "v", "id").sortWithinPartitions("g", "v", "id")
    local = cut_lineage(ranged.mapInArrow(run, LOCAL))
    marks = local.where("open IS NULL").orderBy("part").collect()                # one row a range
    rows_of: dict[int, int] = {r["g"]: r["ties"] for r in local.where(F.col("open") == COUNT).collect()}
    offsets, firsts, lasts = [], [], []
    spans: list[list[int]] = []                                   # [below, ties] of each cut run, shared by its ranges
    g_now, run_now = None, None
    for m in marks:
        offset = rows_of.get(m["first_g"], 0) if m["first_g"] == g_now else 0
        if run_now is None or (m["first_g"], m["first_v"]) != run_now:
            spans.append([offset, 0])
        spans[-1][1] += m["first_n"]
        firsts.append(len(spans) - 1)
        only = (m["last_g"], m["last_v"]) == (m["first_g"], m["first_v"])
        if not only:
            spans.append([m["last_below"] + (offset if m["last_g"] == m["first_g"] else 0), m["last_n"]])
        lasts.append(len(spans) - 1)
        offsets.append(offset)
        rows_of[m["first_g"]] = rows_of.get(m["first_g"], 0) + m["first_rows"]
        if m["last_g"] != m["first_g"]:
            rows_of[m["last_g"]] = m["last_rows"]
        g_now, run_now = m["last_g"], (m["last_g"], m["last_v"])
    carried = [(m["part"], m["first_g"], o, *spans[f], *spans[x]) for m, o, f, x in zip(marks, offsets, firsts, lasts)]
    carry = F.broadcast(spark.createDataFrame(carried, "p int, p_g int, moved long, f_below long, f_ties long, l_below long, l_ties long"))
    met = local.where(F.col("open") < COUNT).join(carry, F.col("part") == F.col("p"))
    below = F.when(F.col("open") == FIRST, F.col("f_below")).when(F.col("open") == LAST, F.col("l_below")).otherwise(
        F.col("below") + F.when(F.col("g") == F.col("p_g"), F.col("moved")).otherwise(0))
    ties = F.when(F.col("open") == FIRST, F.col("f_ties")).when(F.col("open") == LAST, F.col("l_ties")).otherwise(F.col("ties"))
    ranks = met.select("id", "g", (below + (ties + 1) / 2).alias("rank"))
    done = local.where(F.col("open") == DONE).collect()          # one row a long run, each of more than held_rows rows
    if done:
        at = {m["part"]: (m["first_g"], o, spans[f], spans[x]) for m, o, f, x in zip(marks, offsets, firsts, lasts)}
        sizes = []
        for r in done:
            p_g, moved, first, last = at[r["part"]]
            inside = (r["below"] + (moved if r["g"] == p_g else 0), r["ties"])
            sizes.append((r["part"], r["id"], *{FIRST: first, LAST: last}.get(r["first_n"], inside)))
        known = F.broadcast(spark.createDataFrame(sizes, "p int, run long, r_below long, r_ties long"))
        late = local.where(F.col("open") == LONG).join(known, (F.col("part") == F.col("p")) & (F.col("below") == F.col("run")))
        ranks = ranks.unionByName(late.select("id", "g", (F.col("r_below") + (F.col("r_ties") + 1) / 2).alias("rank")))
    return ranks, rows_of


ROW_BITS = 16                # rows of one block, which a slice sends and gets ranks for together, as a power of two
HOME = -1                    # the key of a block's own row, among those of its values in slices
SENT = "key int, block long, at binary, data array<binary>"
_SENT = pa.schema([("key", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("data", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class Slices:
    """The columns cut into slices of values, and for each ranking (column, other or None) what lies below a slice and in it."""
    asked: list[tuple[int, int | None]]
    cuts: list[np.ndarray]
    below: list[np.ndarray]      # of a ranking, by slice
    rows: list[np.ndarray]
    mixed: list[np.ndarray]      # of a column, by slice: whether it holds more than one value

    def of(self, column: int) -> list[int]:
        return [g for g, (i, _) in enumerate(self.asked) if i == column]

    def column(self, key: int) -> tuple[int, int]:
        """(column, slice) of a key: slices are numbered column by column."""
        begins = np.cumsum([0, *map(len, self.mixed)])
        column = int(np.searchsorted(begins, key, "right")) - 1
        return column, key - int(begins[column])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(block, rows in it, columns) from batches (id, columns...), whose ids rise; a block may come in several pieces."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []

    def piece() -> tuple[int, np.ndarray, list[np.ndarray]]:
        ids = np.concatenate([i for i, _ in held])
        return int(ids[0] >> ROW_BITS), ids & ((1 << ROW_BITS) - 1), [np.concatenate(c) for c in zip(*(c for _, c in held))]

    for batch in batches:
        ids, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        columns = [c.astype(float, copy=False) for c in columns]
        blocks = ids >> ROW_BITS
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if held and held[0][0][0] >> ROW_BITS != blocks[lo]:
                yield piece()
                held.clear()
            held.append((ids[lo:hi], [c[lo:hi] for c in columns]))
    if held:
        yield piece()


def _in_order(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the values by size, without the missing ones; where each slice begins among them, and the end; the values)."""
    there = np.flatnonzero(~np.isnan(values))
    order = there[np.argsort(values[there])]
    v = values[order]
    return order, np.concatenate(([0], np.searchsorted(v, cuts), [len(v)])), v


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: sorted values shrink well this way."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rising(values: np.ndarray) -> bytes:
    """Whole numbers that never fall: the first one, then the steps in as few bytes as the largest needs."""
    steps = np.diff(values)
    return int(values[0]).to_bytes(8, "little") + _planes(steps.astype(np.min_scalar_type(int(steps.max(initial=0)))))


def _from_rising(data: bytes, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    out[0] = int.from_bytes(data[:8], "little")
    if n > 1:
        out[1:] = _from_planes(data[8:], np.dtype(f"u{(len(data) - 8) // (n - 1)}"))
    return np.cumsum(out)


def sliced(rows: DataFrame, asked: list[tuple[int, int | None]], cuts: Sequence[Sequence[float]]) -> Slices:
    """Counts the rows of each slice and ranking, in one pass over rows (id, columns...); a slice takes [cut, next cut)."""
    edges = [np.array(c, dtype=float) for c in cuts]
    groups = [[(g, other) for g, (i, other) in enumerate(asked) if i == c] for c in range(len(edges))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(edges[i]) + 1, dtype=np.int64) for i, _ in asked]
        low, high = ([np.full(len(e) + 1, end) for e in edges] for end in (np.inf, -np.inf))
        for _, _, columns in _blocks(batches):
            for c, values in enumerate(columns):
                order, begins, v = _in_order(values, edges[c])
                full = np.flatnonzero(np.diff(begins))
                low[c][full] = np.minimum(low[c][full], v[begins[full]])
                high[c][full] = np.maximum(high[c][full], v[begins[full + 1] - 1])
                for g, other in groups[c]:
                    upto = begins if other is None else np.concatenate(([0], np.cumsum(~np.isnan(columns[other][order]))))[begins]
                    n[g] += np.diff(upto)
        for g, (i, _) in enumerate(asked):
            full = np.flatnonzero(n[g])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), g), pa.int32()), pa.array(full, pa.int32()), pa.array(n[g][full]),
                                              pa.array(low[i][full]), pa.array(high[i][full])], names=["g", "slice", "n", "low", "high"])

    found = (rows.mapInArrow(run, "g int, slice int, n long, low double, high double").groupBy("g", "slice")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow())    # rankings x slices
    g, at, n, low, high = (found.column(c).to_numpy() for c in ("g", "slice", "n", "low", "high"))
    counts = [np.zeros(len(edges[i]) + 1, dtype=np.int64) for i, _ in asked]
    mixed = [np.zeros(len(e) + 1, dtype=bool) for e in edges]
    for k, (i, _) in enumerate(asked):
        mine = g == k
        counts[k][at[mine]] = n[mine]
        mixed[i][at[mine]] |= low[mine] < high[mine]
    return Slices(list(asked), edges, [np.concatenate(([0], np.cumsum(c)[:-1])) for c in counts], counts, mixed)


def rank_moments(rows: DataFrame, s: Slices) -> CoMoments:
    """The co-moments of all rankings (average ranks less their mean) of rows (id, columns...), which must be written.

    A value whose slice holds no other value has the rank that the counts give. The others go to their slice, where they are
    ranked: a block of rows sends each slice one row with all its values there and gets one row with their ranks back, so
    that Spark moves few large rows. The ranks meet what the block knows itself, and are multiplied there.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, d = len(s.asked), len(s.cuts)
    first_key = np.cumsum([0, *map(len, s.mixed)])
    groups = [s.of(c) for c in range(d)]
    code = np.int16 if max(map(len, s.mixed)) < 1 << 15 else np.int32

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, columns in _blocks(batches):
            codes = [np.where(np.isnan(v), -1, np.searchsorted(s.cuts[c], v, "right")).astype(code) for c, v in enumerate(columns)]
            yield batch([(HOME, block, _planes(at.astype(np.uint16)), [_planes(x) for x in codes])])

    def to_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, columns in _blocks(batches):
            out = []
            for c, values in enumerate(columns):
                if not s.mixed[c].any():
                    continue
                order, begins, v = _in_order(values, s.cuts[c])
                there = at[order].astype(np.uint16)
                held = [~np.isnan(columns[s.asked[g][1]][order]) for g in groups[c] if s.asked[g][1] is not None]
                for k in np.flatnonzero(s.mixed[c] & (np.diff(begins) > 0)).tolist():
                    lo, hi = begins[k], begins[k + 1]
                    out.append((int(first_key[c]) + k, block, there[lo:hi].tobytes(), [_planes(v[lo:hi]), *[np.packbits(h[lo:hi]).tobytes() for h in held]]))
            if out:
                yield batch(out)

    def rank(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        c, _ = s.column(key)
        data = group.column("data").to_pylist()
        sizes = np.array([len(x[0]) // 8 for x in data])
        v = np.concatenate([_from_planes(x[0], np.float64) for x in data])
        order = np.argsort(v, kind="stable")                     # of sorted pieces
        ends, x, ranks, bits = np.cumsum(sizes), v[order], [], 0
        for g in groups[c]:
            if s.asked[g][1] is None:
                counted = np.ones(len(v), dtype=bool)
            else:
                bits += 1
                counted = np.concatenate([np.unpackbits(np.frombuffer(p[bits], np.uint8), count=n) for p, n in zip(data, sizes)]).astype(bool)
            upto = np.concatenate(([0], np.cumsum(counted[order])))
            begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            run_ends = np.append(begins[1:], len(x))
            twice = upto[begins] + upto[run_ends] + 1            # twice the mean of the positions begin + 1 .. end
            ranked = np.empty(len(v), dtype=np.int64)
            ranked[order] = np.repeat(twice, run_ends - begins)
            ranks.append(ranked)
        out = [[_rising(r[lo:hi]) for r in ranks] for lo, hi in zip((ends - sizes).tolist(), ends.tolist())]
        return pa.table([group.column("key"), group.column("block"), group.column("at"), pa.array(out, pa.list_(pa.binary()))], schema=_SENT)

    known = [np.where(s.mixed[i], np.nan, s.below[g] + (s.rows[g] + 1) / 2) for g, (i, _) in enumerate(s.asked)]
    middle = np.array([(n.sum() + 1) / 2 for n in s.rows])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, table, there = CoMoments(width), None, None, None

        def close() -> None:
            for g, (i, other) in enumerate(s.asked):
                table[~(there[:, i] if other is None else there[:, i] & there[:, other]), g] = np.nan
            total.add(table - middle)

        for b in batches:
            for key, block, at, data in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if now is not None:
                        close()
                    now, table, there = block, np.full((1 << ROW_BITS, width), np.nan), np.zeros((1 << ROW_BITS, d), dtype=bool)
                at = _from_planes(at, np.uint16) if key == HOME else np.frombuffer(at, np.uint16)
                if key == HOME:
                    for c, x in enumerate(data):
                        codes = _from_planes(x, code)
                        there[at, c] = codes >= 0
                        for g in groups[c]:
                            here = known[g][codes]
                            sure = (codes >= 0) & ~np.isnan(here)
                            table[at[sure], g] = here[sure]
                else:
                    c, k = s.column(key)
                    for g, x in zip(groups[c], data):
                        table[at, g] = s.below[g][k] + _from_rising(x, len(at)) / 2
        if now is not None:
            close()
        yield total.batch()

    ranked = rows.mapInArrow(to_slices, SENT).groupBy("key").applyInArrow(rank, SENT)
    dealt = rows.mapInArrow(homes, SENT).unionByName(ranked).repartition(parts, "block").sortWithinPartitions("block")
    return summed(dealt.mapInArrow(multiply, PARTIAL), width)

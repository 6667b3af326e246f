"""Running products of a monoid along keys of any size: local runs first, then one carry for each range of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.session import cut_lineage

PRIME = (1 << 31) - 1            # products of two residues fit a long


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents % modulus, by squaring."""
    out, square, left = np.ones(len(exponents), np.int64), base % modulus, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % modulus, out)
        square, left = square * square % modulus, left >> 1
    return out


def running_products(rows: DataFrame, key: str, order: Sequence[str], elements: Sequence[str], bases: Sequence[int],
                     modulus: int | None = PRIME, leave: Sequence[str] = ()) -> DataFrame:
    """Adds `pos` (1, 2, ... in order within the key) and, for each element column e, `e_upto` and `e_before`.

    The monoid holds pairs (length, value); (m, a) * (n, b) = (m + n, a + base^m * b), so that a row with element e
    is (1, e), and the value of a run is its polynomial hash modulo `modulus`. With base 1 and no modulus it is a
    plain running sum. `e_upto` is the value of the key's rows up to this one, `e_before` that of those before it.
    Columns in `leave` are needed for the order or as elements only and are not kept.

    Rows are dealt into ranges of (key, order), so a key that holds a third of all rows is spread over many tasks.
    Each task writes its rows with products that begin anew, and one row that says what its last run came to; those
    (one a task) are composed in the driver and sent back for the first run of each range. `key` is a long without
    NULLs; rows alike in key and order may come in any order and should be alike in full, or be told apart in `order`.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    names = [f"{e}_{what}" for e in elements for what in ("upto", "before")]
    added = StructType.fromDDL("ek_part int, ek_mark boolean, ek_first long, pos long, " + ", ".join(f"{n} long" for n in names))
    held = [c for c in ranged.columns if c not in leave]
    full = StructType([*[f for f in ranged.schema.fields if f.name in held], *added.fields])
    for f in full.fields:
        f.nullable = True
    arrow = to_arrow_schema(full)
    keep = [ranged.columns.index(c) for c in held]
    at_key, at = ranged.columns.index(key), [ranged.columns.index(e) for e in elements]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, n, total = TaskContext.get().partitionId(), None, None, 0, [0] * len(elements)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at_key).to_numpy()
            first = int(keys[0]) if first is None else first
            begins = np.concatenate(([True], keys[1:] != keys[:-1]))
            start = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
            goes_on = keys == now if now is not None and keys[0] == now else np.zeros(len(keys), bool)
            goes_on &= start == 0
            pos = np.arange(len(keys)) - start + np.where(goes_on, n, 0)
            columns = []
            for k, base in enumerate(bases):
                e = batch.column(at[k]).to_numpy()
                term = e if base == 1 else e * powers(base, pos, modulus) % modulus
                sums = np.cumsum(term)
                upto = sums - (sums - term)[start] + np.where(goes_on, total[k], 0)
                before = upto - term
                if modulus:
                    upto, before = upto % modulus, before % modulus
                total[k] = int(upto[-1])
                columns += [upto, before]
            now, n = int(keys[-1]), int(pos[-1]) + 1
            fixed = [pa.array(np.full(len(keys), part, np.int32)), pa.array(np.zeros(len(keys), bool)), pa.nulls(len(keys), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*map(batch.column, keep), *fixed, pa.array(pos + 1), *map(pa.array, columns)], arrow)], schema=arrow)
        if first is not None:
            mark = {key: now, "ek_part": part, "ek_mark": True, "ek_first": first, "pos": n} | {f"{e}_upto": t for e, t in zip(elements, total)}
            yield pa.RecordBatch.from_pylist([mark], schema=arrow)

    local = cut_lineage(ranged.mapInArrow(run, full))
    marks = local.where("ek_mark").orderBy("ek_part").collect()            # one row a task
    carried, tail = [], None                                               # tail: key, length and values of the run so far
    for m in marks:
        values = [m[f"{e}_upto"] for e in elements]
        if tail is not None and tail[0] == m["ek_first"]:
            carried.append((m["ek_part"], tail[0], tail[1], *tail[2]))
            if m[key] == m["ek_first"]:                                    # the whole range is of this key
                values = [_composed(t, tail[1], v, b, modulus) for t, v, b in zip(tail[2], values, bases)]
                tail = (m[key], tail[1] + m["pos"], values)
                continue
        tail = (m[key], m["pos"], values)
    kept = local.where("NOT ek_mark")
    if not carried:
        return kept.select(*held, "pos", *names)
    shifted = [(p, k, n, *values, *[b if b == 1 else pow(b, n, modulus) for b in bases]) for p, k, n, *values in carried]
    schema = "ek_p int, ek_k long, ek_n long, " + ", ".join([*[f"ek_c{i} long" for i in range(len(bases))], *[f"ek_b{i} long" for i in range(len(bases))]])
    carry = F.broadcast(spark.createDataFrame(shifted, schema))            # at most one row a range
    met = kept.join(carry, (F.col("ek_part") == F.col("ek_p")) & (F.col(key) == F.col("ek_k")), "left")
    out = []
    for i, e in enumerate(elements):
        for what in ("upto", "before"):
            moved = F.col(f"ek_c{i}") + F.col(f"ek_b{i}") * F.col(f"{e}_{what}")
            out.append(F.coalesce(moved % modulus if modulus else moved, F.col(f"{e}_{what}")).alias(f"{e}_{what}"))
    return met.select(*held, (F.coalesce("ek_n", F.lit(0)) + F.col("pos")).alias("pos"), *out)


def _composed(left: int, length: int, right: int, base: int, modulus: int | None) -> int:
    return left + right if modulus is None else (left + pow(base, length, modulus) * right) % modulus

"""Exact seeded quotas: k rows per stratum chosen by hash, found without shuffling the rows.

Rows are ordered by a 60-bit seeded hash of their id. The k-th smallest hash is located by counting
hash prefixes (a bounded histogram) and ranking only the one prefix that holds the border; the choice
itself is then a plain comparison with a literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenkeel.functions.scalars import SEED, draw
from evenkeel.session import cut_lineage

BITS = 60
STEP = 12                 # prefix bits resolved per pass: 4,096 counters per stratum
BORDER_ROWS = 100_000     # rows of one border prefix that may be ranked


@dataclass(frozen=True)
class Border:
    """Rows of a stratum at or before (hash, row_id) are inside."""
    stratum: object
    quota: int
    hash: int | None
    row_id: str | None


def borders(df: DataFrame, u: str, row_id: str, stratum: Column, quotas: dict[object, list[int]],
            step: int = STEP, border_rows: int = BORDER_ROWS) -> dict[tuple[object, int], Border]:
    """Border of each (stratum, cumulative quota). `quotas` must lie in 0..rows of the stratum.

    The rows are hashed once: hash, id and stratum are written, and every pass reads that narrow table, the later
    ones only the row groups that can hold a border."""
    keyed = cut_lineage(df.select(F.col(u).alias("u"), F.col(row_id).cast("string").alias("id"), stratum.alias("s")))
    out: dict[tuple[object, int], Border] = {}
    open_cuts = []                                    # stratum, quota, still needed, prefix, bits known
    for s, ks in quotas.items():
        for k in ks:
            if k <= 0:
                out[(s, k)] = Border(s, k, None, None)
            else:
                open_cuts.append((s, k, k, 0, 0))
    while open_cuts:
        bits = open_cuts[0][4]
        width = min(step, BITS - bits)
        shift = BITS - bits - width
        rows_here = keyed
        if bits:                                      # one reference to the hash, so it is computed once per row
            rows_here = keyed.where(F.shiftright("u", BITS - bits).isin(sorted({c[3] for c in open_cuts})))
        hist = (rows_here.groupBy("s", F.shiftright("u", shift).alias("p"))
                .agg(F.count(F.lit(1)).alias("rows")))
        group = F.shiftright("p", width)
        run = W.partitionBy("s", group).orderBy("p")
        hist = hist.withColumn("upto", F.sum("rows").over(run.rowsBetween(W.unboundedPreceding, 0)))
        pick = F.lit(False)
        for s, _, need, prefix, _ in open_cuts:
            pick = pick | (F.col("s").eqNullSafe(F.lit(s)) & (group == F.lit(prefix))
                           & (F.col("upto") >= need) & (F.col("upto") - F.col("rows") < need))
        rows = hist.where(pick).collect()             # one row per open cut
        narrowed, small = [], []
        for s, k, need, prefix, _ in open_cuts:
            hit = next((r for r in rows if r["s"] == s and r["p"] >> width == prefix
                        and r["upto"] - r["rows"] < need <= r["upto"]), None)
            if hit is None:
                raise ValueError(f"stratum {s!r} holds fewer than {k} rows")
            cut = (s, k, need - (hit["upto"] - hit["rows"]), hit["p"], bits + width)
            (narrowed if hit["rows"] > border_rows and bits + width < BITS else small).append(cut)
        out.update(_rank(keyed, small))
        open_cuts = narrowed
    return out


def _rank(keyed: DataFrame, cuts) -> dict[tuple[object, int], Border]:
    if not cuts:
        return {}
    bits = cuts[0][4]
    prefix_of = F.shiftright("u", BITS - bits)
    pick = F.lit(False)
    for s, _, need, prefix, _ in cuts:
        pick = pick | (F.col("s").eqNullSafe(F.lit(s)) & (F.col("p") == F.lit(prefix)) & (F.col("rank") == need))
    order = W.partitionBy("s", "p").orderBy("u", "id")
    hits = (keyed.where(prefix_of.isin(sorted({c[3] for c in cuts}))).withColumn("p", prefix_of)
            .withColumn("rank", F.row_number().over(order)).where(pick).collect())
    out = {}
    for s, k, need, prefix, bits in cuts:
        r = next(h for h in hits if h["s"] == s and h["p"] == prefix and h["rank"] == need)
        out[(s, k)] = Border(s, k, r["u"], r["id"])
    return out


def within(border: Border, u: Column, row_id: Column) -> Column:
    if border.hash is None:
        return F.lit(False)
    return (u < F.lit(border.hash)) | ((u == F.lit(border.hash)) & (row_id.cast("string") <= F.lit(border.row_id)))


def assign_parts(df: DataFrame, row_id: str, stratum: Column, parts: list[str],
                 sizes: dict[object, list[int]], seed: int = SEED, name: str = "split", **limits) -> DataFrame:
    """Give every row the part whose exact per-stratum size it falls into, in the order of `parts`.

    Rows beyond the listed sizes get NULL.
    """
    hashed = df.withColumn("_u", draw(seed, row_id)).withColumn("_s", stratum)
    cumulative = {}
    for s, ns in sizes.items():
        acc, cumulative[s] = 0, []
        for n in ns:
            acc += n
            cumulative[s].append(acc)
    found = borders(hashed, "_u", row_id, F.col("_s"), cumulative, **limits)
    label = F.lit(None).cast("string")
    for s, ks in cumulative.items():
        choice = F.lit(None).cast("string")
        for part, k in reversed(list(zip(parts, ks))):
            choice = F.when(within(found[(s, k)], F.col("_u"), F.col(row_id)), F.lit(part)).otherwise(choice)
        label = F.when(F.col("_s").eqNullSafe(F.lit(s)), choice).otherwise(label)
    return hashed.withColumn(name, label).drop("_u", "_s")


def sample_exact(df: DataFrame, n: int, row_id: str, seed: int = SEED, **limits) -> DataFrame:
    """Exactly n rows without replacement, the same ones under any partitioning."""
    picked = assign_parts(df, row_id, F.lit("all"), ["in"], {"all": [n]}, seed, "_part", **limits)
    return picked.where("_part = 'in'").drop("_part")

"""Ordering, quota, key and histogram blocks against plain Python, in one slice and in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.scalars import digamma, draw, is_near_integer, nearest_of, to_number
from evenkeel.plans.histogram import modes, small_domains
from evenkeel.plans.keys import add_row_id
from evenkeel.plans.order import cut_points, exact_quantiles, grouped_quantiles, number_rows, prefix_sum, skew_safe_lookup
from evenkeel.plans.quota import assign_parts, sample_exact


@pytest.fixture(scope="module")
def skewed():
    """A third of the values is one number; the rest spreads over several magnitudes."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(3000) < 1 / 3, 7.0, np.round(np.exp(rng.normal(3, 3, 3000)), 2))
    return pd.DataFrame({"id": range(3000), "g": np.where(rng.random(3000) < 0.4, "hot", rng.choice(list("abcdef"), 3000)), "v": v})


def test_prefix_sum_slices_agree(spark, skewed):
    df = spark.createDataFrame(skewed).groupBy("g", "v").agg(F.count("*").alias("n"))
    keep = ["g", "v", "n", "before", "total"]
    whole = prefix_sum(df, "v", "n", ["g"]).select(keep).collect()
    sliced = prefix_sum(df, "v", "n", ["g"], bucket_rows=100).select(keep).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in sliced}
    hot = skewed[skewed.g == "hot"].v
    got = {r["v"]: r["before"] for r in sliced if r["g"] == "hot"}
    assert all(got[x] == (hot < x).sum() for x in hot.unique())


def test_hot_value_has_its_own_slice(spark, skewed):
    cuts = cut_points(spark.createDataFrame(skewed), "v", 300)
    assert 7.0 in cuts and np.nextafter(7.0, np.inf) in cuts
    assert cuts == sorted(set(cuts))


def test_number_rows_over_text(spark, skewed):
    words = spark.createDataFrame([(f"w{i * 7919 % 1000:04d}",) for i in range(1000)], "w string")
    rows = number_rows(words, "w", bucket_rows=60).collect()
    assert [r["idx"] for r in sorted(rows, key=lambda r: r["w"])] == list(range(1000))


@pytest.mark.parametrize("limits", [{}, {"bracket_rows": 20, "sketch": 50}])
def test_exact_quantiles(spark, skewed, limits):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(skewed).repartition(5), {"v": probs, "id": [0.5]}, **limits)
    assert np.allclose(got["v"], skewed.v.quantile(probs))
    assert got["id"] == [1499.5]


def test_exact_quantiles_with_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [2.0], "b": [None]}


@pytest.mark.parametrize("rows", [100, 10_000])
def test_grouped_quantiles(spark, skewed, rows):
    got = {r["g"]: (r["lo"], r["mid"]) for r in grouped_quantiles(
        spark.createDataFrame(skewed), ["g"], "v", [0.25, 0.5], ["lo", "mid"], bucket_rows=rows).collect()}
    want = skewed.groupby("g").v.quantile([0.25, 0.5]).unstack()
    assert all(np.allclose(got[g], want.loc[g]) for g in want.index)


def test_lookup_with_hot_key(spark, skewed):
    facts = spark.createDataFrame(skewed)
    dim = facts.groupBy("v").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = skew_safe_lookup(facts, dim, ["v"], "n", 3000)
    assert got.count() == 3000
    assert {r["v"]: r["top"] for r in got.collect()} == skewed.groupby("v").id.max().to_dict()


@pytest.mark.parametrize("limits", [{}, {"step": 2, "border_rows": 5}])
def test_quotas_are_exact_and_partition_free(spark, skewed, limits):
    df = add_row_id(spark.createDataFrame(skewed), ["id"])
    counts = skewed.g.value_counts().to_dict()
    sizes = {g: [n // 2, n // 3] for g, n in counts.items()}
    parts = assign_parts(df, "row_id", F.col("g"), ["x", "y"], sizes, **limits)
    got = {(r["g"], r["split"]): r["count"] for r in parts.groupBy("g", "split").count().collect()}
    for g, (x, y) in sizes.items():
        assert got[(g, "x")] == x and got[(g, "y")] == y and got[(g, None)] == counts[g] - x - y
    again = assign_parts(df.repartition(7), "row_id", F.col("g"), ["x", "y"], sizes)
    assert {(r["id"], r["split"]) for r in parts.collect()} == {(r["id"], r["split"]) for r in again.collect()}


def test_quota_edges(spark, skewed):
    df = add_row_id(spark.createDataFrame(skewed), ["id"])
    assert sample_exact(df, 0, "row_id").count() == 0
    assert sample_exact(df, 3000, "row_id").count() == 3000
    with pytest.raises(ValueError):
        sample_exact(df, 3001, "row_id")


def test_row_ids_of_copies_are_unique(spark):
    df = spark.createDataFrame([(1, None)] * 500 + [(1, "x")] * 3 + [(2, "x")], "a int, b string")
    ids = add_row_id(df, chunk=50)
    assert ids.count() == 504 and ids.select("row_id").distinct().count() == 504
    assert {r[0] for r in ids.select("row_id").collect()} == {r[0] for r in add_row_id(df.repartition(6)).select("row_id").collect()}


def test_modes_and_domains(spark):
    df = spark.createDataFrame([(2, "b", True, None), (1, "a", False, None), (2, "a", False, None), (1, None, None, None)],
                               "i int, s string, t boolean, n double")
    assert modes(df, ["i", "s", "t", "n"]) == {"i": 1, "s": "a", "t": False}
    assert small_domains(df, ["i", "s", "n"], 2) == {"i": [1, 2], "s": ["a", "b"], "n": []}
    assert small_domains(spark.range(100), ["id"], 20) == {"id": None}


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number("s")).collect()] == [1.5, None, None, None]
    one = spark.range(1)
    got = one.select(nearest_of(F.lit(1.5), [1, 2, 3]).alias("a"), nearest_of(F.lit(9.0), [1, 2]).alias("b"),
                     is_near_integer(F.lit(100000.5)).alias("c"), is_near_integer(F.lit(1.4)).alias("d"),
                     nearest_of(F.lit(None).cast("double"), [1.0]).alias("e")).first()
    assert tuple(got) == (1.0, 2.0, True, False, None)
    psi = spark.createDataFrame([(1,), (2,), (10,), (1000,)], "n int").select(digamma(F.col("n"))).collect()
    want = [-0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in (1, 2, 10, 1000)]
    assert np.allclose([r[0] for r in psi], want, atol=1e-9)
    assert one.select(draw(42, F.lit("1"))).first()[0] == 749406697372964569

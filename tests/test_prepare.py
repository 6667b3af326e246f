"""Cleaning, encoding, selection and splitting."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from evenkeel.operators import clean, encode, select as sel, split as sp
from evenkeel.plans.keys import add_row_id
from evenkeel.plans.recipe import Recipe


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(1, 1.0, "b", True), (2, None, "a", None), (3, 4.0, None, True), (4, float("nan"), "a", False), (None, 10.0, "b", True)]
    return spark.createDataFrame(rows, "i long, x double, s string, t boolean").withColumn("none", F.lit(None).cast("string"))


def _col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_impute(holes):
    auto = clean.impute(holes, ["i", "x", "s", "t", "none"], "auto")
    assert _col(auto, "i") == [1.0, 2.0, 3.0, 4.0, 2.5] and _col(auto, "x") == [1.0, 4.0, 4.0, 4.0, 10.0]
    assert _col(auto, "s") == ["b", "a", "a", "a", "b"] and _col(auto, "none") == [None] * 5
    mean = clean.impute(holes, ["x", "s"], "mean")
    assert _col(mean, "x") == [1.0, 5.0, 4.0, 5.0, 10.0] and None in _col(mean, "s")
    mode = clean.impute(holes, ["i", "t"], "mode")
    assert _col(mode, "i") == [1, 2, 3, 4, 1] and _col(mode, "t") == [True, True, True, False, True]
    const = clean.impute(holes, ["x", "s"], "constant", value="7")
    assert _col(const, "x") == [1.0, 7.0, 4.0, 7.0, 10.0] and _col(const, "s")[2] == "7"
    with pytest.raises(ValueError):
        clean.impute(holes, ["x"], "constant", value="seven")
    train_only = clean.impute(holes, ["x"], "median", fit_on=holes.where("x < 5"))
    assert _col(train_only, "x") == [1.0, 2.5, 4.0, 2.5, 10.0]


def test_outliers(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.standard_t(2, 500), "b": rng.normal(size=500), "c": 1.0})
    pdf.loc[:20, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    q1, q3 = pdf.a.quantile([.25, .75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert clean.filter_iqr(df, ["a"]).count() == (pdf.a.between(lo, hi) | pdf.a.isna()).sum()
    clipped = clean.winsorize_iqr(df, ["a"]).agg(F.min("a"), F.max("a"), F.count_if(F.isnan("a") | F.col("a").isNull())).first()
    assert np.allclose(clipped[:2], [pdf.a.clip(lo, hi).min(), pdf.a.clip(lo, hi).max()]) and clipped[2] == 21
    z = pd.concat([((pdf[c] - pdf[c].mean()) / pdf[c].std()).abs().le(2.0) | pdf[c].isna() for c in ("a", "b")], axis=1).all(axis=1)
    from evenkeel.sources.tables import nan_to_null

    assert clean.filter_zscore(nan_to_null(df), ["a", "b", "c"], 2.0).count() == z.sum()
    for bad in (lambda: clean.filter_iqr(df, ["a"], 0.5), lambda: clean.filter_zscore(df, ["a"], 9)):
        with pytest.raises(ValueError):
            bad()


def test_one_hot(holes):
    out = encode.one_hot(holes, ["s", "t"])
    assert out.columns == ["i", "x", "none", "s_a", "s_b", "t_False", "t_True"]
    assert [tuple(r) for r in out.select("s_a", "s_b", "t_False", "t_True").collect()] == [
        (0, 1, 0, 1), (1, 0, 0, 0), (0, 0, 0, 1), (1, 0, 1, 0), (0, 1, 0, 1)]
    assert encode.one_hot(holes, ["s"], drop_first=True).columns[-1] == "s_b"
    with pytest.raises(ValueError):
        encode.one_hot(holes, ["s"], cap=1)


@pytest.mark.parametrize("cap", [1, 100])
def test_ordinal(spark, holes, cap):
    got = encode.ordinal_encode(holes, ["s", "t"], cap=cap)
    assert {(r["i"], r["s"], r["t"]) for r in got.collect()} == {(1, 1.0, 1.0), (2, 0.0, None), (3, None, 1.0), (4, 0.0, 0.0), (None, 1.0, 1.0)}
    assert got.columns == holes.columns
    unseen = encode.ordinal_encode(spark.createDataFrame([("a",), ("z",)], "s string"), ["s"], fit_on=holes, cap=cap)
    assert sorted(_col(unseen, "s"), key=str) == [0.0, None]


def test_recipe(holes):
    recipe = Recipe(holes)
    recipe.derived["split"] = "old"
    recipe.apply("drop", lambda d: clean.drop_missing_rows(d, ["x"])).apply("keep", lambda d: d.where("i < 3"))
    assert recipe.derived == {} and [tuple(r) for r in recipe.log().collect()] == [(1, "drop", 5, 3), (2, "keep", 3, 1)]
    assert recipe.sizes == [5, 3, 1] and [tuple(r) for r in recipe.log().collect()][1] == (2, "keep", 3, 1)
    assert recipe.reset().current is holes and recipe.log().count() == 0


def _psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def _neighbour_mi(x, y, k=3):
    gap, terms = np.abs(x[:, None] - x[None, :]), []
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        wanted = min(k, same.sum())
        r = np.sort(gap[i, same])[wanted - 1]
        hits, kk = ((gap[i] == 0).sum(), (gap[i, same] == 0).sum() + 1) if r == 0 else ((gap[i] < r - 1e-9 * r).sum(), wanted)
        terms.append(_psi(kk) - _psi(same.sum() + 1) - _psi(hits))
    return max(0.0, _psi(len(x)) + np.mean(terms))


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 30}])
def test_neighbour_information(spark, options):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < .3).astype(int)
    cols = {"smooth": rng.normal(size=300) + y, "whole": rng.integers(0, 4, 300) + y * 1.0, "flat": np.where(rng.random(300) < .4, 0.0, rng.normal(size=300)),
            "flag": (rng.random(300) < .2 + .5 * y) * 1.0}
    df = spark.createDataFrame(pd.DataFrame({**cols, "y": y}))
    got = {r["feature"]: r["score"] for r in sel.mutual_info(df, list(cols), "y", **options).collect()}
    for c, x in cols.items():
        assert math.isclose(got[c], _neighbour_mi(x, y), abs_tol=1e-6), c


def test_neighbour_information_derives_its_histogram_once(spark):
    """the rows are read for one histogram; reaches that end in other slices are counted there."""
    rng = np.random.default_rng(5)
    y = np.where(np.arange(400) % 57 == 0, 2, rng.integers(0, 2, 400))             # a class so thin that its reach spans slices
    x = np.where(rng.random(400) < .2, 1.5, rng.normal(size=400))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = sel.mutual_info(df, ["x"], "y", bucket_rows=25)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert math.isclose(got.collect()[0]["score"], _neighbour_mi(x, y), abs_tol=1e-9)


def test_select_k_best(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"noise": rng.normal(size=400), "weak": rng.normal(size=400) + y, "strong": rng.normal(size=400) + 4 * y, "y": y}))
    for method in ("knn", "binned"):
        kept, table = sel.select_k_best(df, ["noise", "weak", "strong"], "y", 2, method)
        assert kept.columns == ["weak", "strong", "y"]
        assert [(r["feature"], r["selected"]) for r in table.collect()] == [("strong", True), ("weak", True), ("noise", False)]
    with pytest.raises(ValueError):
        sel.select_k_best(df, ["noise"], "y", 2)
    with pytest.raises(ValueError):
        sel.mutual_info(df.withColumn("t", F.lit("x")), ["t"], "y")
    with pytest.raises(ValueError):
        sel.mutual_info(df.withColumn("weak", F.when(F.col("weak") > 0, F.col("weak"))), ["weak"], "y")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.integers(20, 10_000), min_size=1, max_size=4), st.sampled_from([.05, .1, .2, .35, .4]), st.sampled_from([.05, .2, .3, .4]))
def test_split_sizes_add_up(counts, val, test):
    sizes = sp.split_sizes(counts, val, test)
    n = sum(counts.values())
    held = math.ceil((val + test) * n)
    assert all(sum(parts) == counts[s] for s, parts in sizes.items())
    assert sum(p[0] for p in sizes.values()) == n - held
    assert sum(p[2] for p in sizes.values()) == math.ceil(test / (val + test) * held)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 9))
def test_split_does_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    whole = sp.split(add_row_id(df, ["id"]), "y", "row_id")
    other = sp.split(add_row_id(df.repartition(parts), ["id"]), "y", "row_id")
    assert {tuple(r) for r in whole.select("id", "split").collect()} == {tuple(r) for r in other.select("id", "split").collect()}
    counts = {(r["split"], r["y"]): r["n_rows"] for r in sp.class_counts(whole, "y").collect()}
    sizes = sp.split_sizes({0: 428, 1: 72})
    assert counts == {(part, y): sizes[y][i] for y in (0, 1) for i, part in enumerate(("train", "validation", "test"))}


def test_split_limits(spark):
    df = add_row_id(spark.range(10).withColumn("y", F.lit(0)), ["id"])
    for bad in ({"val": .5}, {"test": .01}):
        with pytest.raises(ValueError):
            sp.split(df, "y", "row_id", **bad)
    with pytest.raises(ValueError):
        sp.split(add_row_id(spark.range(3).withColumn("y", F.col("id") % 2), ["id"]), "y", "row_id")


def test_shuffle_is_a_permutation(spark):
    df = add_row_id(spark.range(100), ["id"])
    one, two = _col(sp.shuffle(df, "row_id"), "id"), _col(sp.shuffle(df.repartition(5), "row_id"), "id")
    assert one == two != list(range(100)) and sorted(one) == list(range(100))


def test_many_classes_are_coded_by_a_join(spark, monkeypatch):
    from evenkeel.operators import select as sel

    monkeypatch.setattr(sel, "LITERAL_CLASSES", 3)
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f"c{k % 7}") for k in range(70)], "i long, t string")
    assert {(r["t"], r["code"]) for r in sel.factorize(df, "t").collect()} == {(None, None)} | {(f"c{k}", k - 1) for k in range(1, 7)}


def test_the_mode_of_decimals_breaks_ties_by_value(spark):
    from decimal import Decimal

    from evenkeel.plans.histogram import modes

    df = spark.createDataFrame([(Decimal("9.00"),), (Decimal("10.00"),)], "d decimal(10,2)")
    assert Decimal(modes(df, ["d"])["d"]) == Decimal("9.00")


def test_quota_table_is_the_plain_rule(spark):
    from evenkeel.operators import split as sp

    for counts, n in (({"a": 7, "b": 7, "c": 7}, 10), ({"x": 1, None: 5, "y": 3}, 4), ({"k%03d" % i: 1 + i % 9 for i in range(300)}, 611), ({"a": 2}, 0)):
        df = spark.createDataFrame([(s,) for s, c in counts.items() for _ in range(c)], "s string")
        got = {r["stratum"]: r["n_rows"] for r in sp.quota_table(df, "s", n).collect()}
        assert got == sp.stratum_quotas(counts, n) and sum(got.values()) == n
    assert sp.quota_table(spark.createDataFrame([], "s string"), "s", 0).count() == 0
    with pytest.raises(ValueError):
        sp.quota_table(spark.createDataFrame([("a",)], "s string"), "s", 2)

"""Profiles, chart aggregates and correlations against pandas."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import explore as ex, gates, profile as pf
from evenkeel.operators.correlate import correlation, ordered_pairs, pair_totals


@pytest.fixture(scope="module")
def edge(spark):
    """An all-missing and a constant column, ties, NaN beside NULL, a boolean."""
    rows = [(1, 5.0, float("nan"), "b", True), (2, 5.0, 1.0, "a", False), (2, 5.0, None, "a", None), (4, 5.0, 3.0, None, True),
            (4, 5.0, 3.0, "b", True), (4, 5.0, 3.0, "b", True)]
    return spark.createDataFrame([(*r, None) for r in rows],
                                 "i long, const double, holes double, s string, flag boolean, none double")


def test_shape_and_duplicates(edge):
    assert tuple(pf.shape_summary(edge).first()) == (6, 6, 2 + 1 + 1 + 6)
    assert pf.duplicate_count(edge).first()[0] == 1


def test_column_info(edge):
    got = {r["column"]: (r["missing"], r["missing_pct"], r["distinct_values"]) for r in pf.column_info(edge).collect()}
    assert got == {"i": (0, 0.0, 3), "const": (0, 0.0, 1), "holes": (2, 33.33, 2), "s": (1, 16.67, 2), "flag": (1, 16.67, 2),
                   "none": (6, 100.0, 0)}
    assert {r["column"] for r in pf.missing_report(edge).collect()} == {"holes", "s", "flag", "none"}


def test_describe(edge):
    pdf = pd.DataFrame({"i": [1, 2, 2, 4, 4, 4], "holes": [np.nan, 1, np.nan, 3, 3, 3]})
    want = pdf.describe()
    got = {r["column"]: r for r in pf.describe_all(edge).collect()}
    for c in pdf:
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("min", "min"), ("max", "max")):
            assert math.isclose(got[c][mine], want[c][theirs], abs_tol=1e-12)
    assert (got["flag"]["count"], got["flag"]["unique"], got["flag"]["top"], got["flag"]["freq"]) == (5, 2, "True", 4)
    assert (got["s"]["top"], got["s"]["freq"]) == ("b", 3)
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None


def test_histogram_keeps_all_rows(spark):
    df = spark.range(1000).select((F.col("id") ** 2).cast("double").alias("x"))
    rows = ex.histogram(df, "x", 10).collect()
    want = np.histogram(np.arange(1000.0) ** 2, 10)[0]
    assert [r["n_rows"] for r in sorted(rows, key=lambda r: r["bin"])] == want.tolist()
    assert sum(r["n_rows"] for r in ex.histogram(df.withColumn("x", F.lit(3.0)), "x", 5).collect()) == 1000
    with pytest.raises(ValueError):
        ex.histogram(df, "x", 4)


def test_box(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(400) < .5, "a", None), "v": np.exp(rng.normal(size=400))})
    df = spark.createDataFrame([(None if pd.isna(g) else g, float(v)) for g, v in pdf.values], "g string, v double")
    got = {r["key"]: r for r in ex.box_stats(df, "v", "g").collect()}
    for g in ("a", None):
        v = pdf.v[pdf.g == "a"] if g else pdf.v[pdf.g.isna()]
        q1, q3 = v.quantile([.25, .75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert math.isclose(got[g]["whisker_high"], inside.max()) and got[g]["n_outliers"] == len(v) - len(inside)
    assert ex.box_outliers(df, "v", "g").agg(F.sum("n_rows")).first()[0] == sum(r["n_outliers"] for r in got.values())


def test_box_of_small_groups_beside_a_hot_one(spark):
    rows = [("hot", float(i % 97)) for i in range(3000)] + [(None, 5.0)] + [(f"g{i}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["key"]: r for r in ex.box_stats(df, "v", "g").collect()}
    assert len(got) == 52 and (got[None]["n_rows"], got[None]["whisker_low"], got[None]["n_outliers"]) == (1, 5.0, 0)
    assert (got["hot"]["n_rows"], got["hot"]["q1"], got["hot"]["whisker_high"]) == (3000, 24.0, 96.0)
    assert all(got[f"g{i}"]["med"] == i for i in range(50))
    assert ex.box_stats(df.limit(0), "v", "g").count() == 0


def test_bars_and_lines(edge):
    assert [tuple(r) for r in ex.value_counts(edge, "s").collect()] == [("b", 3), ("a", 2), ("nan", 1)]
    assert [tuple(r) for r in ex.group_aggregate(edge, "s", "none", "sum").collect()] == [("a", 0.0), ("b", 0.0), (None, 0.0)]
    assert [tuple(r) for r in ex.group_aggregate(edge, "s", "i", "median").collect()] == [("a", 2.0), ("b", 4.0), (None, 4.0)]
    assert [tuple(r) for r in ex.group_aggregate(edge, "s", "none", "median").collect()] == [("a", None), ("b", None), (None, None)]
    assert [r["x"] for r in ex.line_series(edge, "i", "const").collect()] == [1, 2, 2, 4, 4, 4]
    with pytest.raises(ValueError):
        ex.scatter_points(edge, "i", "i")


@pytest.fixture(scope="module")
def tied():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 8, 300).astype(float)
    pdf = pd.DataFrame({"a": a, "b": np.round(a + rng.normal(size=300) * 3), "c": rng.normal(size=300)})
    pdf.loc[rng.random(300) < .1, "b"] = np.nan
    pdf.loc[rng.random(300) < .35, "c"] = 0.0
    return pdf


def _matrix(df):
    return {(r["column_a"], r["column_b"]): r["corr"] for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"group_points": 50}])
@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation(spark, tied, method, options):
    df = spark.createDataFrame(tied).withColumn("const", F.lit(1.0))
    got = _matrix(correlation(df, method, **options))
    for x in "abc":
        for y in "abc":
            pair = tied[[x, y]].dropna() if x != y else tied[[x]].dropna()
            if method == "kendall" and x != y:
                d = [np.sign(pair[k].to_numpy()[:, None] - pair[k].to_numpy()[None, :]) for k in (x, y)]
                want = (d[0] * d[1]).sum() / math.sqrt((d[0] ** 2).sum() * (d[1] ** 2).sum())
            else:
                ranks = pair.rank() if method == "spearman" else pair
                want = 1.0 if x == y else ranks[x].corr(ranks[y])
            assert math.isclose(got[(x, y)], want, abs_tol=1e-9), (x, y)
        assert got[(x, "const")] is None
    assert got[("const", "const")] is None


def test_ranks_of_values_and_columns_cut_by_ranges(spark, tied):
    """Few distinct values over many ranges, so that runs of ties and columns go on from range to range."""
    from evenkeel.plans.ranks import average_ranks

    rng = np.random.default_rng(5)
    rows = [(k, g, float(v)) for g, high in ((0, 2), (1, 1), (2, 500), (4, 3)) for k, v in enumerate(rng.integers(0, high, 400 + g))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            ranks, sizes = average_ranks(spark.createDataFrame(rows, "id long, g int, v double").repartition(3))
            got = {(r["g"], r["id"]): r["rank"] for r in ranks.collect()}
            want = pd.DataFrame(rows, columns=["id", "g", "v"])
            want["rank"] = want.groupby("g")["v"].rank()
            assert got == dict(zip(zip(want["g"], want["id"]), want["rank"]))
            assert sizes == want.groupby("g").size().to_dict()
            got = _matrix(correlation(spark.createDataFrame(tied), "spearman"))
            for x, y in (("a", "c"), ("a", "b"), ("b", "c")):
                paired = tied[[x, y]].dropna().rank()
                assert math.isclose(got[(x, y)], paired[x].corr(paired[y]), abs_tol=1e-9), (x, y)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pearson_far_from_zero_and_on_many_columns(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=500)
    pdf = pd.DataFrame({f"x{k}": base * (k % 3) + rng.normal(size=500) + 1e9 * (k % 4) for k in range(40)})
    pdf.loc[::7, "x5"] = np.nan
    pdf["pairwise_const"] = np.where(pdf["x5"].isna(), pdf["x1"], 0.1)            # varies, but not where x5 is there
    got = _matrix(correlation(spark.createDataFrame(pdf), "pearson"))
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            if {a, b} == {"x5", "pairwise_const"}:
                assert got[a, b] is None
            elif a != b:
                assert math.isclose(got[a, b], want.loc[a, b], abs_tol=1e-5), (a, b)
    assert spark.createDataFrame([(None, None)], "a double, b double").transform(correlation).where("corr IS NOT NULL").count() == 0


def test_pair_counting(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 30, 500).astype(float), rng.integers(0, 20, 500).astype(float), rng.integers(1, 5, 500)
    dx, dy, ww = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :]), w[:, None] * w[None, :]
    up, down = ((dx * dy > 0) * ww).sum() / 2, ((dx * dy < 0) * ww).sum() / 2
    assert ordered_pairs(x, y, w) == (up, down)
    pdf = pd.DataFrame({"pair": np.zeros(500, int), "x": x, "y": y, "w": w}).groupby(["pair", "x", "y"], as_index=False).sum()
    df = spark.createDataFrame(pdf).withColumn("pair", F.col("pair").cast("int"))
    assert pair_totals(df, 40) == {0: (up, down)}


def test_gates(spark, edge):
    assert gates.columns_by_kind(edge, "i") == (["const", "holes", "none"], ["s", "flag"])
    assert gates.non_numeric_columns(edge, "i") == ["s"]
    assert {r["column"] for r in gates.columns_with_nulls(edge).collect()} == {"holes", "s", "flag", "none"}
    with pytest.raises(ValueError):
        gates.drop_columns(edge, ["i"], "i")
    with pytest.raises(ValueError):
        gates.select_features(edge, [], "i")
    with pytest.raises(ValueError):
        gates.binary_target_values(edge, "i")
    with pytest.raises(ValueError):
        gates.model_ready(edge, "flag")
    ready = spark.createDataFrame([(1.0, True, "n"), (2.0, False, "y")], "a double, b boolean, t string")
    assert dict(gates.model_ready(ready, "t").dtypes)["b"] == "int"
    assert [r["t"] for r in gates.binarize_target(ready, "t").orderBy("a").collect()] == [0, 1]
    assert gates.exclusions(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


@pytest.mark.parametrize("name, expected", [
    ("id", True), ("user_id", True), ("id_no", True), ("CustomerID", True), ("paid", False), ("c_custkey", False), ("c_name", True),
    ("Home Address", True), ("work-email", True), ("고객번호", True), ("연체금액", False), ("midterm", False), ("rename", False),
    (" Name ", True), ("card.number", True), ("idx", False)])
def test_identifier_names(spark, name, expected):
    df = spark.createDataFrame([(name,)], "column_name string")
    assert gates.identifier_columns(df).first()["is_identifier"] is expected


def test_catalog(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "events")}
    flagged = {(r["table_name"], r["column_name"]) for r in gates.identifier_columns(gates.column_catalog(frames)).where("is_identifier").collect()}
    assert flagged == {("customer", "c_name"), ("events", "event_id"), ("events", "user_id")}
    assert gates.protected_columns(frames["events"]) == ["event_id", "user_id"]


def test_grid_of_missing_values_and_nan(spark):
    from evenkeel.operators.explore import scatter_grid, value_counts

    none = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert scatter_grid(none, "x", "y").count() == 0
    nan = spark.createDataFrame([(float("nan"), 1.0), (1.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert {(r["cell_x"], r["cell_y"]) for r in scatter_grid(nan, "x", "y", 2).collect()} == {(0, 0), (1, 1)}
    both = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert [(r["key"], r["n_rows"]) for r in value_counts(both, "x").collect()] == [("nan", 2), ("1.0", 1)]


def test_pairs_of_unit_points_match_the_weighted_count():
    from evenkeel.operators.correlate import unit_pairs

    rng = np.random.default_rng(12)
    for n, a, b in ((1, 3, 3), (2, 1, 1), (33, 4, 50), (700, 9, 700), (3000, 3000, 2)):
        x, y = rng.integers(0, a, n), rng.integers(0, b, n)
        assert unit_pairs(x, y) == ordered_pairs(x.astype(float), y.astype(float), np.ones(n))


def test_a_run_of_equal_values_is_not_held_whole(spark):
    from evenkeel.plans.ranks import _Ranker, average_ranks

    ranker = _Ranker(0, 50)
    for k in range(40):
        list(ranker.add(np.zeros(20, int), np.full(20, 7.0), np.arange(20) + 20 * k))
        assert sum(map(len, ranker.held)) <= 50 + 20
    rng = np.random.default_rng(13)
    for hot in (0.0, 0.5, 1.0):
        v = np.where(rng.random(3000) < hot, 1.0, rng.integers(0, 9, 3000).astype(float))
        g = rng.integers(0, 3, 3000)
        rows = [(i, int(g[i]), float(v[i])) for i in range(3000)]
        ranks, sizes = average_ranks(spark.createDataFrame(rows, "id long, g int, v double").repartition(3), held_rows=25)
        got = {(r["id"], r["g"]): r["rank"] for r in ranks.collect()}
        assert len(got) == 3000 and sizes == {k: int((g == k).sum()) for k in range(3)}
        for k in range(3):
            mine = np.flatnonzero(g == k)
            below, ties = (v[mine][:, None] > v[mine]).sum(1), (v[mine][:, None] == v[mine]).sum(1)
            assert [got[i, k] for i in mine.tolist()] == (below + (ties + 1) / 2).tolist()


def test_spearman_of_several_blocks_slices_and_missing_patterns(spark, monkeypatch):
    """Hot values, infinities, columns missing in other rows, more rows than a block; only the rows themselves are written."""
    from evenkeel.operators import correlate
    from evenkeel.plans import ranks

    written, kept = [], correlate.cut_lineage

    def counted(df):
        out = kept(df)
        written.append(out.count())
        assert all(a < b for part in out.select("id").rdd.glom().collect() for a, b in itertools.pairwise(r["id"] for r in part))
        return out

    monkeypatch.setattr(correlate, "cut_lineage", counted)
    monkeypatch.setattr(ranks, "cut_lineage", counted)
    rng = np.random.default_rng(12)
    n = 70_000
    wide = rng.normal(size=n)
    pdf = pd.DataFrame({"few": rng.integers(0, 5, n).astype(float), "wide": wide, "hot": np.where(rng.random(n) < 0.4, 3.0, wide + rng.normal(size=n)),
                        "holes": np.where(rng.random(n) < 0.1, np.nan, np.round(wide, 2)), "other": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 900, n))})
    pdf.loc[:3, "wide"] = [np.inf, -np.inf, np.inf, -0.0]
    got = _matrix(correlation(spark.createDataFrame(pdf).repartition(3), "spearman", group_points=20_000))
    assert sum(written) == n
    for x, y in itertools.combinations(pdf.columns, 2):
        paired = pdf[[x, y]].dropna().rank()
        assert math.isclose(got[x, y], paired[x].corr(paired[y]), abs_tol=1e-9), (x, y)

"""Class balance, neighbours, SMOTE and synthetic rows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel import session
from evenkeel.operators import balance as bal, synth as sy
from evenkeel.operators.neighbours import nearest_neighbours, search_cells
from evenkeel.operators.smote import smote, smote_rows, weighted_points
from evenkeel.plans.keys import add_row_id


@pytest.fixture(scope="module")
def points():
    """A third of the points are copies of one; coordinates are coarse, so distances tie."""
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(360, 3)), 1)
    v[:120] = v[0]
    return v


def _frame(spark, v):
    return spark.createDataFrame([tuple(map(float, r)) for r in v], "a double, b double, c double")


@pytest.mark.parametrize("cell, chunk", [(10_000, 10_000), (30, 20)])
def test_neighbours_match_brute_force(spark, points, cell, chunk):
    pts = weighted_points(_frame(spark, points), ["a", "b", "c"])
    table = pts.toPandas()
    v, ids, w = np.stack(table.v), table.pid.to_numpy(), table.w.to_numpy()
    found = nearest_neighbours(pts, 5, cell, chunk).toPandas()
    by_pid = {p: g.sort_values("place") for p, g in found.groupby("pid")}
    for i in range(len(v)):
        gap = sum((v[i, d] - v[:, d]) ** 2 for d in range(3))
        order = [j for j in np.lexsort((ids, gap)) if j != i]
        need = np.searchsorted(np.cumsum(w[order]), 5) + 1
        assert by_pid[ids[i]].nid.tolist() == ids[order[:need]].tolist()


def _compare_with_brute_force(table, found, k):
    v, ids, w = np.stack(table.v), table.pid.to_numpy(), table.w.to_numpy()
    by_pid = {p: g.sort_values("place") for p, g in found.groupby("pid")}
    for i in range(0, len(v), 7):
        gap = sum((v[i, d] - v[:, d]) ** 2 for d in range(v.shape[1]))
        order = [j for j in np.lexsort((ids, gap)) if j != i]
        need = np.searchsorted(np.cumsum(w[order]), k) + 1
        assert by_pid[ids[i]].nid.tolist() == ids[order[:need]].tolist()


@pytest.mark.parametrize("fan", [4096, 6])           # cells of one level, cells of several levels
def test_clusters_of_many_features_visit_few_cells(spark, fan):
    rng = np.random.default_rng(5)
    centres = rng.uniform(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.02, (3000, 16))
    names = [f"f{i}" for i in range(16)]
    pts = weighted_points(spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)), names)
    found, visited, cells = search_cells(pts, 5, 25, 500, fan)
    assert cells >= 3000 / 25 / 2                                 # no cell holds more than twice 25 points
    assert visited.count() < 3000 * cells / 10
    assert visited.distinct().count() == visited.count()          # no cell is asked twice
    _compare_with_brute_force(pts.toPandas(), found.toPandas(), 5)


def test_cells_that_hold_too_much_are_cut_again(spark):
    """Points that fill one small region densely and a wide one thinly, few cells a level, ties and copies."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.integers(0, 12, (1500, 2)) / 1e4, rng.integers(0, 30, (700, 2)).astype(float)])
    pts = weighted_points(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double"), ["a", "b"])
    found, visited, cells = search_cells(pts, 3, 10, 40, 3)
    assert cells > 9                                              # more than two levels of three
    _compare_with_brute_force(pts.toPandas(), found.toPandas(), 3)


def test_smote_rows_lie_between_minority_rows(spark, points):
    df = _frame(spark, points)
    got = np.array([tuple(r)[1:] for r in smote_rows(df, ["a", "b", "c"], 300, 360, cell_points=50, bucket_rows=64).collect()])
    whole = np.array([tuple(r)[1:] for r in smote_rows(df.repartition(6), ["a", "b", "c"], 300, 360).collect()])
    assert len(got) == 300 and np.allclose(np.sort(got, axis=0), np.sort(whole, axis=0))
    uniq = np.unique(points, axis=0)
    for x in got:
        a, b = uniq[:, None, :], uniq[None, :, :]
        step = b - a
        length = (step ** 2).sum(-1)
        t = np.clip(np.divide(((x - a) * step).sum(-1), length, out=np.zeros_like(length), where=length > 0), 0, 1)
        assert (((a + t[..., None] * step) - x) ** 2).sum(-1).min() < 1e-16


def test_smote_guards(spark, points):
    df = _frame(spark, points).withColumn("y", (F.col("b") > 0.6).cast("int"))
    out = smote(df, ["a", "b", "c"], "y", 0.8)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[1] == int(np.ceil(counts[0] * 0.8))
    assert out.where("is_synthetic").select("method").distinct().first()[0] == "SMOTE (ratio=0.80)"
    now = bal.rebalance_plan(df, "y").first()["current_ratio"]
    for bad in (lambda: smote(df, ["a"], "y", now), lambda: smote(df, ["a"], "y", k=11), lambda: smote(out, ["a"], "y", 0.5),
                lambda: smote(spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1)], "a double, y int"), ["a"], "y")):
        with pytest.raises(ValueError):
            bad()


def test_ratio_report_agrees_with_the_plan(spark):
    ratios = [0.05, 0.1, 0.2, 0.25, 0.26, 0.5, 1.0, 1.01]
    for n, m in ((20, 5), (3, 3), (9, 1)):
        df = spark.createDataFrame([(0,)] * n + [(1,)] * m + [(None,)], "y int")
        rows = {r["target_ratio"]: r for r in bal.ratio_report(df, "y", ratios).collect()}
        assert set(rows) == set(ratios)
        for ratio in ratios:
            try:
                assert rows[ratio]["needed"] == bal.require_plan(df, "y", ratio).needed and rows[ratio]["problem"] is None
            except ValueError as refused:
                assert rows[ratio]["needed"] is None and str(refused).startswith(rows[ratio]["problem"])
    empty = bal.ratio_report(spark.createDataFrame([], "y int"), "y", [0.5]).collect()
    assert [(r["needed"], r["problem"]) for r in empty] == [(None, "the minority class needs at least 1 rows")]


def test_plan_and_status(spark):
    even = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    plan = bal.rebalance_plan(even, "y").first()
    assert (plan["minority_label"], plan["majority_label"], plan["needed"]) == ("a", "b", 0)
    status = bal.pair_matching_status(even, "y").first()
    assert (status["is_matched"], status["ratio"], status["difference"]) == (True, 1.0, 0)
    none = bal.pair_matching_status(even.where("y = 'z'"), "y").first()
    assert (none["is_binary"], none["minority"], none["ratio"]) == (False, 0, None)
    assert bal.default_manual_ratio(0.1) == 0.5 and bal.default_manual_ratio(0.777) == 0.78
    with pytest.raises(ValueError):
        bal.require_plan(even, "y")


REAL = [(1.0, 0.0, 5.5), (2.0, 1.0, 7.25), (4.0, None, 6.0)]


def test_snap(spark):
    real = spark.createDataFrame([(*r, None) for r in REAL], "n double, flag double, x double, none double")
    syn = spark.createDataFrame([(1.5, 0.5, 9.0, 3.0), (3.4, -2.0, 6.1, 3.0), (None, 0.9, None, None)], "n double, flag double, x double, none double")
    assert [tuple(r) for r in sy.snap_to_domain(syn, real).collect()] == [(1.0, 0.0, 7.25, 3.0), (4.0, 0.0, 6.1, 3.0), (None, 1.0, None, None)]
    many = spark.range(31).select(F.col("id").cast("double").alias("n"))
    assert sy.snap_to_domain(syn.select("n"), many).first()[0] == 1.5


def test_profile_and_requests(spark):
    real = spark.createDataFrame([(i, "x@y", float(i % 25), 1.0) for i in range(50)], "user_id long, email string, v double, one double")
    got = {r["column"]: r for r in sy.minority_profile(real, ["email", "v", "one"]).collect()}
    assert set(got) == {"v", "one"} and got["v"]["allowed_values"] is None and got["one"]["allowed_values"] == [1.0]
    assert sy.minority_profile(real.limit(1), ["v"]).first()["std"] == 0.0
    examples = sy.example_rows(add_row_id(real, ["user_id"]), 3, "row_id")
    payload = sy.request_payload(real, ["user_id", "email"], examples)
    batches = sy.generation_batches(spark, payload, 60, 25, saved=10, last_batch=4).orderBy("batch_no").collect()
    assert [(b["batch_no"], b["n_rows"]) for b in batches] == [(5, 25), (6, 25)]
    for b in batches:
        sent = json.loads(b["request"])
        assert list(sent)[-1] == "number_of_rows" and sent["number_of_rows"] == 25 and len(sent["example_minority_rows"]) == 3
        assert "user_id" not in b["request"] and "x@y" not in b["request"]
    with pytest.raises(ValueError):
        sy.request_payload(real, real.columns)


def test_responses(spark):
    def batch(rows):
        return json.dumps({"rows": rows})

    good = spark.createDataFrame([(1, batch([{"a": 1, "b": "2.5"}, {"a": None, "b": 1}])), (2, batch([{"a": 1}, {"a": 2, "b": 3}]))],
                                 "batch_no long, response string")
    assert [tuple(r) for r in sy.parse_generated(good, ["a", "b"]).orderBy("batch_no").collect()] == [(1, 0, 1.0, 2.5), (2, 1, 2.0, 3.0)]
    for text, problem in (("{}", "no rows"), (batch([]), "no rows"), (batch([{"a": 1}]), "absent column b"), (batch([{"a": "x", "b": 1}]), "no valid numeric row"), ("oops", "no rows")):
        bad = good.union(spark.createDataFrame([(3, text)], "batch_no long, response string"))
        assert sy.response_report(bad, ["a", "b"]).where("batch_no = 3").first()["problem"] == problem
        with pytest.raises(ValueError, match="batch 3"):
            sy.parse_generated(bad, ["a", "b"])


def test_intake(spark):
    good = spark.createDataFrame([("1", 2.0, "t", 9)] * 5, "` a` string, `b ` double, y string, extra int")
    clean, report = sy.validate_synthetic(good, ["a", "b"], "y", 5)
    assert clean.columns == ["a", "b"] and all(r["passed"] for r in report.collect())
    for frame, check in ((good.drop("b "), "columns"), (good.withColumn(" a", F.lit("x")), "numeric"),
                         (good.withColumn("b ", F.lit(None).cast("double")), "missing"), (good.limit(4), "rows")):
        assert [r["check_name"] for r in sy.validate_synthetic(frame, ["a", "b"], "y", 5)[1].where("NOT passed").collect()] == [check]
    with pytest.raises(ValueError):
        sy.require_rows(clean.where("a > 9"))


def test_bootstrap(spark):
    real = spark.createDataFrame([(i, float(i), float(i) * 10, None if i % 2 else float(i), None) for i in range(20)],
                                 "id long, p double, q double, some double, none double")
    syn = spark.range(200).select((F.col("id") / 50).cast("long").alias("batch_no"), (F.col("id") % 50).alias("row_no"))
    rows = sy.bootstrap_columns(syn, real, ["p", "q", "some", "none"], "id").collect()
    assert len(rows) == 200 and all(r["q"] == 10 * r["p"] and r["some"] % 2 == 0 and r["none"] == 0.0 for r in rows)
    assert len({r["p"] for r in rows}) > 15


def test_drop_copies_compares_numbers(spark):
    train = spark.createDataFrame([(5, None), (6, 1.0)], "a int, b double")
    syn = spark.createDataFrame([(5.0, None), (6.0, 1.0), (6.0, 2.0), (6.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in sy.drop_copies(syn, train, ["a", "b"]).collect()] == [(6.0, 2.0)] * 2


def test_costs(spark):
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model_id string, input_per_million double, output_per_million double")
    requests = spark.createDataFrame([("x" * 9, 3, "y"), ("", 1, "y" * 8)], "request string, n_rows long, row_text string")
    got = sy.generation_cost(requests, prices).first()
    assert (got["calls"], got["input_tokens"], got["output_tokens"]) == (2, 3 + 30 + 0 + 30, 3 * 3 + 12 + 4 + 12)
    assert got["total_cost"] == pytest.approx((63 * 2 + 37 * 10) / 1e6)
    usage = spark.createDataFrame([("m", 1000, 100), ("m", 1000, 200)], "model_id string, input_tokens long, output_tokens long")
    assert sy.usage_cost(usage, prices).first()["total_cost"] == pytest.approx((2000 * 2 + 300 * 10) / 1e6)
    with pytest.raises(ValueError):
        sy.usage_cost(usage.withColumn("model_id", F.lit("unknown")), prices)
    payload = sy.request_payload(spark.createDataFrame([(1.0,), (3.0,)], "v double"))
    assert sy.generation_cost(sy.estimate_requests(spark, payload, 60, 25), prices).first()["calls"] == 3


def test_identity(spark):
    df = spark.createDataFrame([(i % 3, None if i % 2 else "x") for i in range(20)], "a int, b string")
    mark = sy.dataset_signature(df).first()[0]
    assert mark == sy.dataset_signature(df.orderBy(F.desc("a")).repartition(3)).first()[0]
    for other in (df.limit(19), df.withColumnRenamed("a", "c"), df.withColumn("a", F.col("a").cast("long")), df.withColumn("b", F.coalesce("b", F.lit("y")))):
        assert sy.dataset_signature(other).first()[0] != mark
    one, payload = sy.job_id(df, {"batch_size": 5, "excluded_cols": ["b", "a"]})
    two, _ = sy.job_id(df, {"excluded_cols": ["a", "b"], "batch_size": 5})
    assert one == two and len(one) == 24 and payload["excluded_cols"] == ["a", "b"]
    assert sy.job_id(df, {"batch_size": 6, "excluded_cols": ["a", "b"]})[0] != one


def test_first_rows(spark):
    df = spark.range(95).select((F.col("id") / 10).cast("long").alias("batch_no"), (F.col("id") % 10).alias("row_no"), "id").repartition(4)
    assert sorted(r["id"] for r in sy.first_rows(df, 42).collect()) == list(range(42))
    assert sy.first_rows(df, 1000).count() == 95


def test_large_whole_numbers_are_no_copies_of_their_neighbours(spark):
    from evenkeel.operators.synth import drop_copies

    train = spark.createDataFrame([(9007199254740992, 5)], "a long, b int")
    made = spark.createDataFrame([(9007199254740993, 5), (9007199254740992, 5)], "a long, b int")
    assert [r["a"] for r in drop_copies(made, train, ["a", "b"]).collect()] == [9007199254740993]
    floats = spark.createDataFrame([(9007199254740992.0, 5.0)], "a double, b double")
    assert drop_copies(floats, train, ["a", "b"]).count() == 0


def test_no_generated_row_left_is_an_error(spark):
    import pytest

    from evenkeel.operators.synth import finish_generated

    train = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1)], "x double, y int")
    with pytest.raises(ValueError, match="no synthetic rows"):
        finish_generated(train, spark.createDataFrame([(3.0,)], "x double"), ["x"], "y", 1)
    status = finish_generated(train, spark.createDataFrame([(3.0,), (4.0,)], "x double"), ["x"], "y", 1)[1].first()
    assert status["is_matched"]


def test_too_many_examples_are_an_error(spark):
    import pytest

    from evenkeel.operators.synth import request_payload

    real = spark.createDataFrame([(float(k),) for k in range(120)], "x double")
    with pytest.raises(ValueError, match="example rows"):
        request_payload(real, (), real)
    assert len(request_payload(real, (), real.limit(50))["example_minority_rows"]) == 50


def test_checkpoint_without_numbers_is_refused_when_cut(spark):
    import pytest

    from evenkeel.sources.generated import validate_checkpoint

    rows = spark.createDataFrame([(1.0,)], "x double")
    assert validate_checkpoint(rows, {"job_id": "j"}, "j", ["x"]).count() == 1
    with pytest.raises(ValueError, match="batch_no"):
        validate_checkpoint(rows, {"job_id": "j"}, "j", ["x"], target_rows=1)


def test_resume_starts_goes_on_and_ends(spark, tmp_path):
    from evenkeel.sources.generated import resume_generation

    real = spark.createDataFrame([(0.0,), (100.0,), (7.25,)] + [(float(k),) for k in range(30)], "x double")
    responses = spark.createDataFrame([(b, '{"rows": [' + ", ".join(f'{{"x": {b}.5}}' for _ in range(2)) + "]}") for b in range(1, 9)], "batch_no long, response string")
    path = str(tmp_path / "run")
    rows, report = resume_generation(spark, path, "j", responses.where("batch_no <= 2"), ["x"], 5, 2, real, usage={"input_tokens": 3})
    assert rows.count() == 4 and report["status"] == "in_progress" and report["last_batch"] == 2
    rows, report = resume_generation(spark, path, "j", responses, ["x"], 5, 2, real, usage={"input_tokens": 4})
    assert rows.count() == 5 and report["status"] == "completed" and report["input_tokens"] == 7 and report["saved_before"] == 4
    assert resume_generation(spark, path, "j", responses, ["x"], 5, 2, real)[0].count() == 5


def test_a_point_looks_at_few_boxes_to_find_those_it_reaches():
    from evenkeel.operators.neighbours import BoxTree

    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += np.size(at[0]) if isinstance(at, tuple) else 0
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(8)
    low = np.array([(i, j) for i in range(50) for j in range(40)], dtype=float)
    high, v = low + rng.uniform(0, 1, low.shape), rng.uniform(0, 40, (300, 2))
    r2 = np.where(np.arange(300) % 100 == 0, np.inf, 0.3)
    tree = BoxTree.of(low, high)
    row, box, gap = BoxTree(tree.low.view(Counted), tree.high, tree.child, tree.box).met(v, r2)
    gaps = (np.maximum(0, np.maximum(low[None] - v[:, None], v[:, None] - high[None])) ** 2).sum(-1)
    want = [(i, j) for i, j in zip(*np.nonzero(gaps <= r2[:, None]))]
    assert sorted(zip(row, box)) == want and np.allclose(gap, gaps[row, box])
    assert Counted.looked < 300 * 2000 * 2 / 10                   # of 2,000 boxes with two coordinates each


def test_a_block_looks_at_few_points_and_finds_the_nearest():
    from evenkeel.operators.neighbours import closest

    rng = np.random.default_rng(9)
    for points in (rng.integers(0, 40, (1500, 2)).astype(float), rng.normal(size=(1500, 3)), np.round(rng.normal(size=(1500, 1)), 2)):
        points[5, 0], points[6, 0] = np.nan, np.inf
        gap = sum((points[:, None, d] - points[None, :, d]) ** 2 for d in range(points.shape[1]))
        near, dist = closest(points, points, 6)
        for i in set(range(1500)) - {5, 6}:
            want = np.argsort(gap[i], kind="stable")[:6]
            assert near[i].tolist() == want.tolist() and dist[i].tolist() == gap[i, want].tolist()


def test_smote_writes_little_for_a_row(spark, monkeypatch):
    """Neighbour lists of points whose search ends in their own cell are not written."""
    from evenkeel.operators import neighbours, smote as module

    written = []

    def weighed(df):
        kept = session.cut_lineage(df)
        written.append(sum(os.path.getsize(f.removeprefix("file:")) for f in kept.inputFiles()))
        return kept

    monkeypatch.setattr(neighbours, "cut_lineage", weighed)
    monkeypatch.setattr(module, "cut_lineage", weighed)
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(0, 1000, (20_000, 2))], "a double, b double")
    assert smote_rows(df, ["a", "b"], 20_000, 20_000, cell_points=1_000).count() == 20_000
    assert sum(written) < 20_000 * 150                            # 16 of them are the row itself


def test_smote_of_rows_with_missing_values_in_several_cells(spark):
    rng = np.random.default_rng(11)
    rows = [(None if i % 10 == 0 else float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 100, (900, 2)))]
    out = smote_rows(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 900, 900, cell_points=60).collect()
    assert sorted(r["synthetic_no"] for r in out) == list(range(900))
    assert 0 < sum(r["a"] is None for r in out) < 200 and not any(r["b"] is None or r["a"] != r["a"] for r in out)

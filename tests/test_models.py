"""Classifiers, the network trainer and evaluation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import evaluate as ev, models as ml, network as nw
from evenkeel.operators.split import split
from evenkeel.plans.keys import add_row_id


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    y = (rng.random(600) < .3).astype(int)
    return pd.DataFrame({"id": range(600), "a": rng.normal(size=600) * 10 + 12 * y, "b": rng.normal(size=600), "y": y})


@pytest.fixture(scope="module")
def parts(spark, table):
    return split(add_row_id(spark.createDataFrame(table), ["id"]), "y", "row_id").cache()


def test_logistic_solves_the_penalised_problem(spark, table):
    df = spark.createDataFrame(table)
    fitted = ml.fit_logistic(df, ["a", "b"], "y", C=0.5)
    x = table[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        reg = np.diag([1 / 0.5, 1 / 0.5, 0])
        w -= np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + reg, x1.T @ (p - table.y) + reg @ w)
    assert np.allclose([*fitted.model.coefficients, fitted.model.intercept], w, atol=1e-5)
    scored = ml.score(fitted, df).orderBy("id").toPandas()
    assert np.allclose(scored.prob, 1 / (1 + np.exp(-x1 @ w)), atol=1e-5)
    assert (scored.pred == (scored.prob >= 0.5)).all() and np.allclose(scored.a, table.a)


def test_scaler_handles_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in ml.apply_scaler(df, ml.fit_scaler(df, ["a", "b"])).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    sizes = (3, 5, 4, 1)
    flat = nw.initial(sizes, "fan_in", 1)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    g, _ = nw.gradient(flat, sizes, x, y)
    for at in rng.choice(len(flat), 25, replace=False):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        slope = [nw.log_loss(nw.logits(flat + s * step, sizes, x), y).mean() for s in (1, -1)]
        assert abs(g[at] - (slope[0] - slope[1]) / 2e-6) < 1e-7


def test_all_models_learn(spark, parts):
    predictions, fitted = ml.train_all(parts, ["a", "b"], "y", "row_id",
                                       ["Logistic Regression", "Random Forest", "Decision Tree", "Multilayer Perceptron", "DNN"],
                                       {"Random Forest": {"trees": 20}, "DNN": {"epochs": 15}, "Multilayer Perceptron": {"max_iter": 25}})
    scores = ev.metrics(predictions, ["model", "sampling", "split"]).toPandas()
    assert len(scores) == 10 and (scores.roc_auc > .65).all() and set(scores.sampling) == {"No oversampling"}
    history = fitted["DNN"].history.toPandas()
    assert history.epoch.tolist() == list(range(1, len(history) + 1)) and history.loss.iloc[-1] < history.loss.iloc[0]
    assert history.notna().all().all()


def test_sharded_training_is_repeatable(spark, parts):
    scaled = parts.select((F.col("a") / 10).alias("a"), "b", "y", "row_id", "split")
    train, val = scaled.where("split = 'train'"), scaled.where("split = 'validation'")
    nets = [nw.fit_dnn(t, val, ["a", "b"], "y", "row_id", epochs=4, buckets=3) for t in (train.repartition(1), train.repartition(7))]
    assert np.allclose(nets[0][0].flat, nets[1][0].flat)
    losses = [r["loss"] for r in nets[0][1].orderBy("epoch").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]


def test_early_stop_keeps_the_best(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "y": rng.integers(0, 2, 200), "row_id": [str(i) for i in range(200)]})
    df = spark.createDataFrame(pdf)
    spec = nw.Spec((16,), lr=0.05, epochs=40, patience=2)
    net, history = nw.fit_network(df.where("row_id < '3'"), df.where("row_id >= '3'"), ["x"], "y", spec)
    h = history.toPandas()
    assert len(h) < 40 and len(h) - 1 - h.val_loss.argmin() == 2


def test_parameter_limits(spark, parts):
    train = parts.where("split = 'train'")
    for bad in (lambda: ml.fit_logistic(train, ["a"], "y", C=0), lambda: ml.fit_tree(train, ["a"], "y", depth=51),
                lambda: ml.fit_tree(train, ["a"], "y", min_split=1), lambda: nw.fit_dnn(train, train, ["a"], "y", "row_id", dropout=.9)):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 500)
    prob = np.round(np.clip(rng.normal(.4 + .2 * y, .2), 0, 1), 2)
    return pd.DataFrame({"model": np.where(rng.random(500) < .5, "m", "n"), "split": "test", "y": y, "prob": prob, "pred": (prob >= .5).astype(int)})


@pytest.mark.parametrize("rows", [20, 100_000])
def test_auc_and_curve(spark, scored, rows):
    df = spark.createDataFrame(scored)
    areas = {r["model"]: r["roc_auc"] for r in ev.roc_auc(df, bucket_rows=rows).collect()}
    curve = ev.roc_curve(df, bucket_rows=rows).toPandas()
    for m, g in scored.groupby("model"):
        pos, neg = g.prob[g.y == 1].to_numpy(), g.prob[g.y == 0].to_numpy()
        want = ((pos[:, None] > neg) + .5 * (pos[:, None] == neg)).mean()
        assert np.isclose(areas[m], want)
        c = curve[curve.model == m].sort_values(["fpr", "tpr"])
        assert np.isclose(np.trapezoid(c.tpr, c.fpr), want)
        assert tuple(c.iloc[0][["fpr", "tpr"]]) == (0, 0) and tuple(c.iloc[-1][["fpr", "tpr"]]) == (1, 1) and np.isinf(c.threshold.iloc[0])
        slopes = np.arctan2(np.diff(c.tpr), np.diff(c.fpr))
        assert (np.abs(np.diff(slopes)) > 1e-12).all()


def test_metrics_where_undefined(spark):
    df = spark.createDataFrame([("m", "test", 0, .1, 0), ("m", "test", 0, .2, 0)], "model string, split string, y int, prob double, pred int")
    assert tuple(ev.metrics(df).first())[2:] == (1.0, 0.0, 0.0, 0.0, None)


def test_reports(spark, scored):
    scores = ev.metrics(spark.createDataFrame(scored))
    assert ev.comparison(scores).columns == ["model", *ev.METRICS] and ev.comparison(scores, "validation").count() == 0
    assert ev.melt_metrics(scores).count() == 10 and ev.model_detail(scores, "m").count() == 1
    assert {tuple(r) for r in ev.random_baseline(spark.createDataFrame(scored)).collect()} == {("Random baseline", 0.0, 0.0), ("Random baseline", 1.0, 1.0)}


def test_depths_beyond_the_limits_are_refused(spark):
    df = spark.createDataFrame([(float(k), k % 2) for k in range(20)], "x double, y int")
    with pytest.raises(ValueError, match="depth"):
        ml.fit_forest(df, ["x"], "y", depth=31)
    with pytest.raises(ValueError, match="depth"):
        ml.fit_tree(df, ["x"], "y", depth=51)


def _plain_tree(x, y, depth, min_split):
    """Shares of class 1 by plain recursion: every cut between two neighbouring values of the node."""
    out = np.full(len(y), y.mean())
    if len(y) < min_split or y.min() == y.max() or depth == 0:
        return out
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:]):
            left = x[:, f] <= (low + high) / 2
            impurity = sum(m.sum() * (1 - y[m].mean() ** 2 - (1 - y[m].mean()) ** 2) for m in (left, ~left))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, left)
    if best is not None:
        for m in (best[1], ~best[1]):
            out[m] = _plain_tree(x[m], y[m], depth - 1, min_split)
    return out


@pytest.mark.parametrize("depth,min_split", [(3, 2), (0, 7), (6, 31)])
def test_tree_against_plain_recursion(spark, depth, min_split):
    rng = np.random.default_rng(depth)
    x = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 5, 400) / 4, rng.integers(0, 2, 400)]).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.random(400) < .25)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t), i) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y int, i int")
    fitted = ml.fit_tree(df.repartition(3), ["a", "b", "c"], "y", depth, min_split)
    got = [r["prob"] for r in ml.score(fitted, df).orderBy("i").collect()]
    assert np.allclose(got, _plain_tree(x, y, depth or 99, min_split))
    assert fitted.model.rows[fitted.model.feature >= 0].min() >= min_split


def test_odd_min_split_leaves_a_node_whole(spark):
    """Nine rows, five of them right of the first cut: cut again with min_split 5, whole with 6 (and with half of it a child)."""
    df = spark.createDataFrame([(0., 0)] * 4 + [(1., 1), (2., 1), (3., 1), (4., 1), (5., 0)], "x double, y int")
    counts = {m: len(ml.fit_tree(df, ["x"], "y", 0, m).model.feature) for m in (5, 6)}
    assert counts == {5: 5, 6: 3}


def test_tree_on_odd_tables(spark):
    same = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert ml.fit_tree(same, ["x"], "y").model.prob.tolist() == [0.5]            # nothing to cut
    wide = spark.createDataFrame([(float(k), int(k >= 700)) for k in range(1000)], "x double, y int")
    tree = ml.fit_tree(wide, ["x"], "y", max_bins=10).model                       # cut at an exact tenth
    assert abs(tree.cut[0] - 0.7 * 999) < 1e-9 and tree.prob[tree.feature < 0].tolist() == [0.0, 1.0]
    with pytest.raises(ValueError, match="rows"):
        ml.fit_tree(same.where("x > 5"), ["x"], "y")
    with pytest.raises(ValueError, match="complete"):
        ml.fit_tree(spark.createDataFrame([(None, 0), (1.0, 1)], "x double, y int"), ["x"], "y")


@pytest.mark.parametrize("shuffled", [1, 40])
def test_the_steps_of_a_network_take_as_many_tasks_as_cores(spark, monkeypatch, shuffled):
    """However many partitions the table comes in; a few rows take one task."""
    from evenkeel.operators.network import Spec, fit_network

    df = spark.range(12_000).selectExpr("id / 12000.0 AS x", "cast(id % 2 AS int) AS y")
    seen, frame = [], type(df)
    inner = frame.mapInPandas

    def watched(self, *args, **kw):
        seen.append(self.rdd.getNumPartitions())
        return inner(self, *args, **kw)

    monkeypatch.setattr(frame, "mapInPandas", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    try:
        fit_network(df, df.limit(50), ["x"], "y", Spec((), epochs=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [spark.sparkContext.defaultParallelism] * 4 + [1]


def test_forest_rows_keep_their_nodes(spark, table):
    """the forest with kept nodes is the one that walks each row down from the root."""
    from pyspark.ml.classification import RandomForestClassifier
    df = spark.createDataFrame(table).repartition(2).cache()
    fitted = ml.fit_forest(df, ["a", "b"], "y", trees=7, depth=9)
    assert fitted.model.getCacheNodeIds()
    walked = RandomForestClassifier(featuresCol="_features", labelCol="y", numTrees=7, maxDepth=9, featureSubsetStrategy="sqrt", seed=ml.SEED,
                                    maxMemoryInMB=1024, cacheNodeIds=False).fit(ml._vectors(df, ["a", "b"]))
    assert [t.toDebugString.split("\n", 1)[1] for t in fitted.model.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]


@pytest.mark.parametrize("rows", [20, 100_000])
def test_metrics_shuffle_the_scores_once(spark, scored, rows):
    """no join brings offsets back to the scores, and their slices meet in one shuffle."""
    df = spark.createDataFrame(scored)
    counts = df.groupBy("model", "prob", "pred").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).cache()
    area = ev._area(counts, ["model"], rows)
    plan = area._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    for m, g in scored.groupby("model"):
        pos, neg = g.prob[g.y == 1].to_numpy(), g.prob[g.y == 0].to_numpy()
        want = ((pos[:, None] > neg) + .5 * (pos[:, None] == neg)).mean()
        assert np.isclose(area.where(F.col("model") == m).first()["roc_auc"], want, rtol=1e-12)

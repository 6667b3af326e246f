"""Model and evaluation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenkeel.functions.scalars import SEED
from evenkeel.operators import evaluate as ev, models as ml
from evenkeel.operators.network import Spec, fit_network, initial
from evenkeel.operators.smote import smote
from evenkeel.operators.split import split
from evenkeel.session import cut_lineage, shared_folder
from evenkeel.sources.tables import read_table, write_csv
from evenkeel.workloads.prepare import split_toxic
from evenkeel.workloads.registry import CREDIT, CREDIT_FEATS, LINE_KEYS, SCORES, TOXIC_FEATS, credit_lineitem, query, rounded, scores, table

_AUC = """a AS (SELECT model, split, sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN y = 1 THEN r END) AS u FROM (SELECT *,
    rank() OVER (PARTITION BY model, split ORDER BY prob) + (count(*) OVER (PARTITION BY model, split, prob) - 1) / 2.0 AS r FROM s) GROUP BY 1, 2),
  auc AS (SELECT model, split, (u - p * (p + 1) / 2.0) / (p::DOUBLE * n) AS roc_auc FROM a)"""
_METRICS = f"""s AS ({SCORES}), {_AUC}, c AS (SELECT model, split, count(*) AS n, sum(y * pred) AS tp, sum((1 - y) * pred) AS fp, sum(y * (1 - pred)) AS fn
    FROM s GROUP BY 1, 2), metrics AS (SELECT model, split, (n - fp - fn) / n::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision",
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, roc_auc
    FROM c JOIN auc USING (model, split))"""
_FIVE = ["accuracy", '"precision"', "recall", "f1", "roc_auc"]


def _round_all(places: int, how: str = "round") -> str:
    return ", ".join(f"{how}({m}, {places}) AS {m}" for m in _FIVE)


@query("metrics", f"WITH {_METRICS} SELECT model, split, {_round_all(8)} FROM metrics")
def metrics(spark, sf):
    return rounded(ev.metrics(scores(spark, sf)), 8)


@query("roc_auc", f"WITH s AS ({SCORES}), {_AUC} SELECT model, split, round(roc_auc, 8) AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(scores(spark, sf)), 8)


@query("roc_curve", f"""WITH s AS ({SCORES}), h AS (SELECT model, prob, sum(y) AS pos, sum(1 - y) AS neg FROM s WHERE split = 'test' GROUP BY 1, 2),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n,
    lead(pos) OVER (PARTITION BY model ORDER BY prob DESC) AS np, lead(neg) OVER (PARTITION BY model ORDER BY prob DESC) AS nn
    FROM h WINDOW w AS (PARTITION BY model ORDER BY prob DESC))
  SELECT model, round(fp / n::DOUBLE, 8) AS fpr, round(tp / p::DOUBLE, 8) AS tpr, round(prob, 8) AS threshold FROM c WHERE np IS NULL OR pos * nn <> neg * np
  UNION ALL SELECT DISTINCT model, 0.0, 0.0, 'inf'::DOUBLE FROM s""")
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(scores(spark, sf)), 8)


@query("random_baseline", f"SELECT 'Random baseline' AS model, unnest([0.0::DOUBLE, 1.0]) AS fpr, unnest([0.0::DOUBLE, 1.0]) AS tpr FROM (SELECT 1 FROM ({SCORES}) LIMIT 1)")
def random_baseline(spark, sf):
    return ev.random_baseline(scores(spark, sf))


@query("comparison_test", f"WITH {_METRICS} SELECT model, {_round_all(4, 'round_even')} FROM metrics WHERE split = 'test'")
def comparison_test(spark, sf):
    return ev.comparison(ev.metrics(scores(spark, sf)))


@query("comparison_validation", f"WITH {_METRICS} SELECT model, {_round_all(4, 'round_even')} FROM metrics WHERE split = 'validation'")
def comparison_validation(spark, sf):
    return ev.comparison(ev.metrics(scores(spark, sf)), "validation")


@query("melt_metrics", f"""WITH {_METRICS} SELECT model, unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS metric,
  unnest([{', '.join(f'round({m}, 8)' for m in _FIVE)}]) AS score FROM metrics WHERE split = 'test'""")
def melt_metrics(spark, sf):
    return rounded(ev.melt_metrics(ev.metrics(scores(spark, sf))), 8)


@query("model_detail", f"WITH {_METRICS} SELECT model, {_round_all(8)} FROM metrics WHERE split = 'test' AND model = 'F'")
def model_detail(spark, sf):
    return rounded(ev.model_detail(ev.metrics(scores(spark, sf)), "F"), 8)


@query("results_export", f"WITH {_METRICS} SELECT model, {_round_all(4, 'round_even')} FROM metrics WHERE split = 'test'")
def results_export(spark, sf):
    """The comparison table written as CSV and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    write_csv(ev.comparison(ev.metrics(scores(spark, sf))), path)
    return read_table(spark, path, "csv")


@query("standardise", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS pd
    FROM lineitem WHERE l_linenumber <= 4)
  SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS l_quantity, round((l_extendedprice - pm) / pd, 6) AS l_extendedprice FROM lineitem, s""")
def standardise(spark, sf):
    """Scaling fitted on part of the rows, applied to all."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaler = ml.fit_scaler(df.where("l_linenumber <= 4"), ["l_quantity", "l_extendedprice"])
    return rounded(ml.apply_scaler(df, scaler))


# ---- fitted models that SQL can follow -----------------------------------------------------------------------

_STUMP = ["l_quantity", "l_discount", "l_tax"]


def _cuts_sql(c: str) -> str:
    """Every cut half way between two neighbouring values, with the weighted Gini impurity it leaves."""
    return f"""SELECT '{c}' AS feature, ({c} + above) / 2 AS cut, n, p, (n - p * p / n - (n - p) * (n - p) / n
    + (alln - n) - (allp - p) * (allp - p) / (alln - n) - (alln - n - allp + p) * (alln - n - allp + p) / (alln - n)) AS impurity FROM (
    SELECT {c}, lead({c}) OVER w AS above, sum(n) OVER w AS n, sum(p) OVER w AS p, sum(n) OVER () AS alln, sum(p) OVER () AS allp
    FROM (SELECT {c}, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM c GROUP BY 1) WINDOW w AS (ORDER BY {c})) WHERE above IS NOT NULL"""


#: a label that quantity foretells
_LARGE = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CAST((l_quantity > 25) <> (l_linenumber = 3) AS INT) AS target FROM lineitem"


@query("tree_scores", f"""WITH c AS ({_LARGE}), cuts AS ({' UNION ALL '.join(_cuts_sql(f) for f in _STUMP)}),
  best AS (SELECT * FROM cuts ORDER BY impurity, feature LIMIT 1), whole AS (SELECT count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM c),
  s AS (SELECT l_orderkey, l_linenumber, CASE feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END <= cut AS low,
    best.p / best.n AS p_low, (whole.p - best.p) / (whole.n - best.n) AS p_high FROM c, best, whole)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN low THEN p_low ELSE p_high END, 6) AS prob,
    CAST(CASE WHEN low THEN p_low ELSE p_high END >= 0.5 AS INT) AS pred FROM s""")
def tree_scores(spark, sf):
    """A tree of one cut, the best of all by Gini impurity, and the score of every line."""
    df = table(spark, sf, "lineitem").withColumn("target", ((F.col("l_quantity") > 25) != (F.col("l_linenumber") == 3)).cast("int"))
    fitted = ml.fit_tree(df, _STUMP, "target", depth=1, max_bins=64)
    return rounded(ml.score(fitted, df).select("l_orderkey", "l_linenumber", "prob", "pred"))


def _levels_sql(levels: int, min_split: int) -> str:
    """Level by level: the node of each line, each node's best cut (ties by feature and value), the children's numbers."""
    parts = [f"l0 AS (SELECT *, 1 AS node FROM ({_MIXED}))"]
    for k in range(levels):
        hist = " UNION ALL ".join(f"SELECT node, {i} AS f, {c} AS v, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM l{k} GROUP BY 1, 2, 3"
                                  for i, c in enumerate(_DEEP))
        picked = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_DEEP))
        parts.append(f"""h{k} AS (SELECT node, f, v, lead(v) OVER w AS above, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER (PARTITION BY node, f) AS alln,
          sum(p) OVER (PARTITION BY node, f) AS allp FROM ({hist}) WINDOW w AS (PARTITION BY node, f ORDER BY v)),
        d{k} AS (SELECT node, f, (v + above) / 2 AS cut FROM h{k} WHERE above IS NOT NULL AND alln >= {min_split} AND allp > 0 AND allp < alln
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY nl - pl * pl / nl - (nl - pl) * (nl - pl) / nl + (alln - nl)
            - (allp - pl) * (allp - pl) / (alln - nl) - (alln - nl - allp + pl) * (alln - nl - allp + pl) / (alln - nl), f, v) = 1),
        l{k + 1} AS (SELECT l.* EXCLUDE (node), CASE WHEN f IS NULL THEN l.node WHEN CASE f {picked} END <= cut THEN 2 * l.node ELSE 2 * l.node + 1 END AS node
          FROM l{k} l LEFT JOIN d{k} d ON l.node = d.node)""")
    return ", ".join(parts)


_DEEP = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
#: a label that several columns tell together
_MIXED = """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CAST((l_quantity > 25 AND l_discount > 0.04) <> (l_linenumber >= 5)
  OR (l_returnflag = 'R' AND l_extendedprice > 30000) AS INT) AS target FROM lineitem"""


@query("tree_levels", f"""WITH {_levels_sql(4, 7)}, s AS (SELECT node, avg(target) AS prob FROM l4 GROUP BY 1)
  SELECT l_orderkey, l_linenumber, round(prob, 6) AS prob, CAST(prob >= 0.5 AS INT) AS pred FROM l4 JOIN s USING (node)""")
def tree_levels(spark, sf):
    """A tree of four levels, nodes of fewer than seven rows left whole, and the score of every line."""
    mixed = F.expr("CAST((l_quantity > 25 AND l_discount > 0.04) <> (l_linenumber >= 5) OR (l_returnflag = 'R' AND l_extendedprice > 30000) AS INT)")
    df = table(spark, sf, "lineitem").withColumn("target", mixed)
    fitted = ml.fit_tree(df, _DEEP, "target", depth=4, min_split=7, max_bins=64)
    return rounded(ml.score(fitted, df).select("l_orderkey", "l_linenumber", "prob", "pred"))


def _newton_sql(steps: int) -> str:
    """Newton steps for a slope (with the penalty 1 / n) and an intercept, over the rows grouped by value."""
    parts = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"""g{k} AS (SELECT a, b, sum(r) AS ga, sum(r * z) + b AS gb, sum(v) AS haa, sum(v * z) AS hab, sum(v * z * z) + 1 AS hbb
          FROM (SELECT a, b, z, n * h - p AS r, n * h * (1 - h) AS v FROM (SELECT a, b, z, n, p, 1 / (1 + exp(-(a + b * z))) AS h FROM grp, w{k})) GROUP BY a, b)""")
        parts.append(f"""w{k + 1} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
          b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})""")
    return ", ".join(parts)


@query("logistic_scores", f"""WITH c AS ({CREDIT}), m AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS d FROM c),
  grp AS (SELECT (l_tax - m) / d AS z, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM c, m GROUP BY 1), {_newton_sql(8)}
  SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(a + b * (l_tax - m) / d))), 5) AS prob FROM c, m, w8""")
def logistic_scores(spark, sf):
    """Logistic regression on one scaled column and the score of every line."""
    df = credit_lineitem(spark, sf)
    fitted = ml.fit_logistic(df, ["l_tax"], "target")
    return rounded(ml.score(fitted, df).select("l_orderkey", "l_linenumber", "prob"), 5)


_PARTED = f"""SELECT *, CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'validation' ELSE 'test' END AS split FROM ({CREDIT})"""


@query("train_all_plain", f"""WITH parted AS ({_PARTED}), c AS (SELECT * FROM parted WHERE split = 'train'), m AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS d FROM c),
  grp AS (SELECT (l_tax - m) / d AS z, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM c, m GROUP BY 1), {_newton_sql(8)},
  best AS (SELECT * FROM ({_cuts_sql('l_tax')}) ORDER BY impurity, cut LIMIT 1), whole AS (SELECT count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM c),
  held AS (SELECT split, target AS y, 1 / (1 + exp(-(a + b * (l_tax - m) / d))) AS linear,
    CASE WHEN l_tax <= cut THEN best.p / best.n ELSE (whole.p - best.p) / (whole.n - best.n) END AS tree FROM parted, m, w8, best, whole WHERE split <> 'train'),
  s AS (SELECT 'Logistic Regression' AS model, split, y, linear AS prob FROM held UNION ALL SELECT 'Decision Tree', split, y, tree FROM held)
  SELECT model, 'No oversampling' AS sampling, split, y, round(prob, 5) AS prob, CAST(prob >= 0.5 AS INT) AS pred, count(*) AS n FROM s GROUP BY ALL""")
def train_all_plain(spark, sf):
    """Two models on the same train lines without balancing, and the counts of their scores on all other lines."""
    split = F.expr("CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'validation' ELSE 'test' END")
    key = F.concat_ws("-", *LINE_KEYS)
    parts = cut_lineage(credit_lineitem(spark, sf).select("l_tax", "target", key.alias("row_id"), split.alias("split")))
    predictions, _ = ml.train_all(parts, ["l_tax"], "target", "row_id", ["Logistic Regression", "Decision Tree"], {"Decision Tree": {"depth": 1}})
    return rounded(predictions, 5).groupBy("model", "sampling", "split", "y", "prob", "pred").agg(F.count(F.lit(1)).alias("n"))


def _adam_sql(steps: int) -> str:
    """Adam steps of a network without hidden layers, over the rows grouped by value, and what each epoch reports."""
    b, w = initial((1, 1), "fan_in", SEED)[::-1].tolist()
    parts = [f"s0 AS (SELECT {w!r}::DOUBLE AS w, {b!r}::DOUBLE AS b, 0.0::DOUBLE AS mw, 0.0::DOUBLE AS mb, 0.0::DOUBLE AS vw, 0.0::DOUBLE AS vb)"]
    for k in range(steps):
        parts.append(f"""r{k} AS (SELECT sum(n * h - p) / sum(n) AS gb, sum((n * h - p) * x) / sum(n) AS gw,
          sum(n * (greatest(z, 0) + ln(1 + exp(-abs(z)))) - p * z) / sum(n) AS loss, sum(CASE WHEN z >= 0 THEN p ELSE n - p END) / sum(n) AS accuracy
          FROM (SELECT x, n, p, b + w * x AS z, 1 / (1 + exp(-(b + w * x))) AS h FROM grp, s{k}))""")
        if k < steps - 1:
            parts.append(f"""t{k} AS (SELECT w, b, 0.9 * mw + 0.1 * gw AS mw, 0.9 * mb + 0.1 * gb AS mb, 0.999 * vw + 0.001 * gw * gw AS vw,
              0.999 * vb + 0.001 * gb * gb AS vb FROM s{k}, r{k}),
              s{k + 1} AS (SELECT w - 0.05 * (mw / {1 - 0.9 ** (k + 1)!r}) / (sqrt(vw / {1 - 0.999 ** (k + 1)!r}) + 1e-8) AS w,
              b - 0.05 * (mb / {1 - 0.9 ** (k + 1)!r}) / (sqrt(vb / {1 - 0.999 ** (k + 1)!r}) + 1e-8) AS b, mw, mb, vw, vb FROM t{k})""")
    return ", ".join(parts)


_EPOCHS = 12


@query("network_linear", f"""WITH c AS (SELECT (l_quantity - 25) / 15.0::DOUBLE AS x, CAST((l_quantity > 25) <> (l_linenumber = 3) AS INT) AS y FROM lineitem),
  grp AS (SELECT x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM c GROUP BY 1), {_adam_sql(_EPOCHS + 1)}
  {" UNION ALL ".join(f"SELECT {k + 1}::INT AS epoch, round(a.loss, 6) AS loss, round(b.loss, 6) AS val_loss, round(a.accuracy, 6) AS accuracy, round(b.accuracy, 6) AS val_accuracy FROM r{k} a, r{k + 1} b" for k in range(_EPOCHS))}""")
def network_linear(spark, sf):
    """The trainer without hidden layers and with one bucket: its history is that of plain Adam on all lines."""
    df = table(spark, sf, "lineitem").select(((F.col("l_quantity") - 25) / 15.0).alias("x"),
                                             ((F.col("l_quantity") > 25) != (F.col("l_linenumber") == 3)).cast("int").alias("y"))
    return rounded(fit_network(df, df, ["x"], "y", Spec((), lr=0.05, epochs=_EPOCHS), buckets=1)[1])


# ---- fitted models: no SQL form, checked in the tests ------------------------------------------------------

def _lineitem(spark, sf):
    df = credit_lineitem(spark, sf, row_id="row_id").select(*CREDIT_FEATS, "target", "row_id")
    return cut_lineage(split(df, "target", "row_id"))


def _on_lineitem(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf):
        predictions, _ = ml.train_all(_lineitem(spark, sf), CREDIT_FEATS, "target", "row_id", [model])
        return ev.metrics(predictions, ["model", "sampling", "split"])


_on_lineitem("logistic", "Logistic Regression")
_on_lineitem("tree", "Decision Tree")


def _on_toxic(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf):
        predictions, _ = ml.train_all(cut_lineage(split_toxic(spark, sf)), TOXIC_FEATS, "toxic", "row_id", [model])
        return ev.metrics(predictions, ["model", "sampling", "split"])


_on_toxic("forest", "Random Forest")
_on_toxic("mlp", "Multilayer Perceptron")


@query("dnn_history")
def dnn_history(spark, sf):
    """Loss and accuracy per epoch of the deep network."""
    _, fitted = ml.train_all(cut_lineage(split_toxic(spark, sf)), TOXIC_FEATS, "toxic", "row_id", ["DNN"])
    return fitted["DNN"].history


@query("score_rows")
def score_rows(spark, sf):
    """Every held-out row with its probability and the class at one half."""
    parts = _lineitem(spark, sf)
    predictions, _ = ml.train_all(parts, CREDIT_FEATS, "target", "row_id", ["Decision Tree"])
    return predictions.select("split", "row_id", "y", "prob", "pred")


@query("train_all_balanced")
def train_all_balanced(spark, sf):
    """Default models on SMOTE-balanced train rows; validation and test keep their own distribution."""
    parts = cut_lineage(split_toxic(spark, sf).select(*TOXIC_FEATS, "toxic", "row_id", "split"))
    balanced = smote(parts.where("split = 'train'").drop("split", "row_id"), TOXIC_FEATS, "toxic")
    predictions, _ = ml.train_all(parts, TOXIC_FEATS, "toxic", "row_id", balanced=cut_lineage(balanced))
    return ev.comparison(ev.metrics(predictions, ["model", "sampling", "split"]))

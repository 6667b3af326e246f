"""From a raw table to a metrics table in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.operators.clean import winsorize_iqr
from evenkeel.operators.encode import one_hot
from evenkeel.operators.evaluate import comparison, metrics
from evenkeel.operators.gates import model_ready
from evenkeel.operators.models import train_all
from evenkeel.operators.split import split
from evenkeel.session import cut_lineage
from evenkeel.workloads.registry import CREDIT_FEATS, credit_lineitem, query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winsorise the price, one-hot the status, split 60/20/20, fit a logistic regression, compare."""
    raw = credit_lineitem(spark, sf_dir, row_id="row_id")
    clean = one_hot(winsorize_iqr(raw, ["l_extendedprice"]), ["l_linestatus"])
    feats = [*CREDIT_FEATS, *[c for c in clean.columns if c.startswith("l_linestatus_")]]
    model_ready(clean.select(*feats, "target"), "target")                 # the gates, on the columns that count
    parts = split(clean.select(*feats, "target", "row_id"), "target", "row_id")
    parts = cut_lineage(parts)                                            # written once, read by every fit and score
    predictions, _ = train_all(parts, feats, "target", "row_id", ["Logistic Regression"])
    return comparison(metrics(predictions, ["model", "sampling", "split"]))


query("flagship")(flagship)

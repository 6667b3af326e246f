"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, row_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", row_id=row_id)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the floating columns, so that the order of additions does not show."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


# ---- derived fixtures: the same expressions in Spark and SQL ----------------------------------------

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
CREDIT_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def credit_lineitem(spark: SparkSession, sf_dir: str, row_id: str | None = None) -> DataFrame:
    """Lineitem as a credit table: target 1 where the line was returned (about one in three)."""
    return table(spark, sf_dir, "lineitem", row_id).withColumn("target", (F.col("l_returnflag") == "R").cast("int"))


CREDIT = "SELECT *, CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem"


def credit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credit table with holes in a numeric and a text column."""
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")),
        "l_linestatus": F.when(F.col("l_orderkey") % 23 != 0, F.col("l_linestatus"))})


MISSING = """SELECT * REPLACE (CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS l_quantity,
                              CASE WHEN l_orderkey % 23 <> 0 THEN l_linestatus END AS l_linestatus) FROM lineitem"""


def toxic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: target toxic (about one in seven), three numeric features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lang = F.lit(None).cast("double")
    for i, code in enumerate(["de", "en", "es", "fr"]):
        lang = F.when(F.col("lang") == code, F.lit(float(i))).otherwise(lang)
    return (table(spark, sf_dir, "labels").join(docs, "doc_id")
            .select("doc_id", "toxic", F.col("n_chars").cast("double").alias("n_chars"),
                    F.col("quality").cast("double").alias("quality"), lang.alias("lang_code")))


TOXIC = """SELECT l.doc_id, l.toxic, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.quality AS DOUBLE) AS quality,
       CASE d.lang WHEN 'de' THEN 0.0::DOUBLE WHEN 'en' THEN 1.0 WHEN 'es' THEN 2.0 WHEN 'fr' THEN 3.0 END AS lang_code
FROM labels l JOIN documents d USING (doc_id)"""
TOXIC_FEATS = ["n_chars", "quality", "lang_code"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions over lineitem: probability is the price scaled to 0..1 at 3 places, so ties occur."""
    prob = F.round(F.col("l_extendedprice") / 110000.0, 3)
    return credit_lineitem(spark, sf_dir).select(
        F.col("l_linestatus").alias("model"),
        F.when(F.col("l_linenumber") <= 4, F.lit("test")).otherwise("validation").alias("split"),
        F.col("target").alias("y"), prob.alias("prob"), (prob >= 0.5).cast("int").alias("pred"))


SCORES = """SELECT l_linestatus AS model, CASE WHEN l_linenumber <= 4 THEN 'test' ELSE 'validation' END AS split,
       CAST(l_returnflag = 'R' AS INT) AS y, round(l_extendedprice / 110000.0, 3) AS prob,
       CAST(round(l_extendedprice / 110000.0, 3) >= 0.5 AS INT) AS pred FROM lineitem"""


def sql_draw(seed: int | str, text: str) -> str:
    """The seeded hash of a row id in SQL."""
    return f"('0x' || substr(md5('{seed}|' || {text}), 1, 15))::BIGINT"


LINE_ID = " || ".join(f"length(CAST({k} AS VARCHAR)) || ':' || {k}" for k in LINE_KEYS)

"""Profiling and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import explore as ex, gates, profile as pf
from evenkeel.operators.correlate import correlation
from evenkeel.workloads.registry import (CREDIT_FEATS, LINE_ID, LINE_KEYS, MISSING, credit_missing, query, rounded,
                                         sql_draw, table)
from evenkeel.plans.keys import add_row_id

LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("shape_summary", f"""SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns,
  (sum(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_missing
  FROM ({MISSING})""")
def shape_summary(spark, sf):
    return pf.shape_summary(credit_missing(spark, sf))


@query("duplicate_count", """WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')
  SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::BIGINT AS n_duplicates FROM t""")
def duplicate_count(spark, sf):
    """All columns of the lines, the returned ones twice."""
    lines = table(spark, sf, "lineitem")
    return pf.duplicate_count(lines.unionByName(lines.where("l_returnflag = 'R'")))


_INFO = "\nUNION ALL\n".join(
    f"""SELECT {i}::INT AS position, '{c}' AS "column", '{t}' AS dtype, (count(*) - count({c}))::BIGINT AS missing,
    round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
    count(DISTINCT {c})::BIGINT AS distinct_values FROM m""" for i, (c, t) in enumerate(LINE_TYPES.items()))


@query("column_info", f"WITH m AS ({MISSING}) {_INFO}")
def column_info(spark, sf):
    return pf.column_info(credit_missing(spark, sf))


@query("missing_report", f"""WITH m AS ({MISSING}), i AS ({_INFO})
  SELECT position, "column", dtype, missing, missing_pct FROM i WHERE missing > 0""")
def missing_report(spark, sf):
    return pf.missing_report(credit_missing(spark, sf))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *CREDIT_FEATS]


def _numeric_sql(c: str, source: str, value: str | None = None, std: bool = True) -> str:
    v = value or c
    return f"""SELECT '{c}' AS "column", count({v})::BIGINT AS count, round(avg({v}), 4) AS mean,
    {f'round(stddev_samp({v}), 4)' if std else 'NULL::DOUBLE'} AS std, round(min({v})::DOUBLE, 4) AS min,
    round(quantile_cont({v}, 0.25)::DOUBLE, 4) AS p25, round(quantile_cont({v}, 0.5)::DOUBLE, 4) AS p50,
    round(quantile_cont({v}, 0.75)::DOUBLE, 4) AS p75, round(max({v})::DOUBLE, 4) AS max FROM {source}"""


@query("describe_numeric", f"WITH m AS ({MISSING}) " + "\nUNION ALL\n".join(
    _numeric_sql(c, "m", f"{c}::DOUBLE") for c in LINE_NUMBERS))
def describe_numeric(spark, sf):
    return rounded(pf.describe_numeric(credit_missing(spark, sf), LINE_NUMBERS), 4)


def _text_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {source})::BIGINT AS count,
    (SELECT count(DISTINCT {c}) FROM {source})::BIGINT AS "unique", top, freq FROM
    (SELECT CAST({c} AS VARCHAR) AS top, count(*)::BIGINT AS freq FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
     ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query("describe_categorical", "\nUNION ALL\n".join(
    [_text_sql(c, "customer") for c in ("c_name", "c_mktsegment")]))
def describe_categorical(spark, sf):
    return pf.describe_categorical(table(spark, sf, "customer"))


_ORDER_SECONDS = "epoch_us(o_orderdate) / 1000000.0::DOUBLE"


@query("describe_all", f"""SELECT "column", count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
  mean, std, min, p25, p50, p75, max FROM ({_numeric_sql('o_orderkey', 'orders', 'o_orderkey::DOUBLE')} UNION ALL
  {_numeric_sql('o_custkey', 'orders', 'o_custkey::DOUBLE')} UNION ALL {_numeric_sql('o_totalprice', 'orders')} UNION ALL
  {_numeric_sql('o_orderdate', 'orders', f'({_ORDER_SECONDS})', std=False)})
  UNION ALL SELECT "column", count, "unique", top, freq, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (
  {_text_sql('o_orderstatus', 'orders')} UNION ALL {_text_sql('o_orderpriority', 'orders')})""")
def describe_all(spark, sf):
    return rounded(pf.describe_all(table(spark, sf, "orders")), 4)


@query("histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
  b AS (SELECT least(floor((l_extendedprice - lo) / w), 29)::INT AS bin, count(*)::BIGINT AS n FROM lineitem, e GROUP BY 1)
  SELECT i::INT AS bin, round(lo + i * w, 6) AS bin_start, round(lo + (i + 1) * w, 6) AS bin_end, coalesce(n, 0)::BIGINT AS n_rows
  FROM range(30) t(i) CROSS JOIN e LEFT JOIN b ON b.bin = i""")
def histogram(spark, sf):
    return rounded(ex.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


_BOX = """WITH q AS (SELECT event_type AS key, count(value) AS n_rows, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
  j AS (SELECT q.*, e.value AS y, e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM events e JOIN q ON q.key = e.event_type)"""


@query("box_stats", f"""{_BOX} SELECT key, any_value(n_rows)::BIGINT AS n_rows, round(any_value(q1), 6) AS q1,
  round(any_value(med), 6) AS med, round(any_value(q3), 6) AS q3, round(min(CASE WHEN inside THEN y END), 6) AS whisker_low,
  round(max(CASE WHEN inside THEN y END), 6) AS whisker_high, count(*) FILTER (NOT inside)::BIGINT AS n_outliers FROM j GROUP BY key""")
def box_stats(spark, sf):
    return rounded(ex.box_stats(table(spark, sf, "events"), "value", "event_type"))


@query("box_outliers", f"{_BOX} SELECT key, y, count(*)::BIGINT AS n_rows FROM j WHERE NOT inside GROUP BY ALL")
def box_outliers(spark, sf):
    return ex.box_outliers(table(spark, sf, "events"), "value", "event_type")


@query("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def scatter_points(spark, sf):
    return ex.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("scatter_sample", f"""SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem
  ORDER BY {sql_draw(42, LINE_ID)}, {LINE_ID} LIMIT 2000""")
def scatter_sample(spark, sf):
    df = add_row_id(table(spark, sf, "lineitem"), LINE_KEYS)
    return ex.scatter_points(df, "l_quantity", "l_extendedprice", "l_returnflag", 2000, "row_id")


@query("scatter_grid", """WITH e AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 50 AS xw,
    min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS yw FROM lineitem)
  SELECT least(floor((l_quantity - x0) / xw), 49)::INT AS cell_x, least(floor((l_extendedprice - y0) / yw), 49)::INT AS cell_y,
  count(*)::BIGINT AS n_rows FROM lineitem, e GROUP BY 1, 2""")
def scatter_grid(spark, sf):
    return ex.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 50)


@query("value_counts", f"""WITH m AS ({MISSING}) SELECT coalesce(l_linestatus, 'nan') AS key, count(*)::BIGINT AS n_rows FROM m GROUP BY 1""")
def value_counts(spark, sf):
    return ex.value_counts(credit_missing(spark, sf), "l_linestatus")


def _group(how: str, sql: str) -> None:
    @query(f"group_{how}", f"""WITH m AS ({MISSING}) SELECT l_linestatus AS key, round({sql}, 4) AS value FROM m GROUP BY 1""")
    def run(spark, sf):
        return rounded(ex.group_aggregate(credit_missing(spark, sf), "l_linestatus", "l_quantity", how), 4)


_group("mean", "avg(l_quantity)")
_group("sum", "coalesce(sum(l_quantity), 0)")
_group("median", "quantile_cont(l_quantity, 0.5)")


@query("line_series", f"WITH m AS ({MISSING}) SELECT l_shipdate AS x, l_quantity AS y FROM m WHERE l_quantity IS NOT NULL")
def line_series(spark, sf):
    return ex.line_series(credit_missing(spark, sf), "l_shipdate", "l_quantity")


def _pairs_sql(source: str, cols: list[str], corr: str) -> str:
    parts = [f"SELECT '{c}' AS column_a, '{c}' AS column_b, 1.0::DOUBLE AS corr" for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT unnest(['{a}', '{b}']) AS column_a, unnest(['{b}', '{a}']) AS column_b, "
                         f"({corr.format(a=a, b=b, src=source)}) AS corr")
    return "\nUNION ALL\n".join(parts)


@query("corr_pearson", f"WITH m AS ({MISSING}) " + _pairs_sql("m", LINE_NUMBERS, "SELECT round(corr({a}, {b}), 6) FROM {src}"))
def corr_pearson(spark, sf):
    return rounded(correlation(credit_missing(spark, sf), "pearson", LINE_NUMBERS))


_RANKED = """SELECT round(corr(ra, rb), 6) FROM (SELECT
  rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("corr_spearman", f"WITH m AS ({MISSING}) " + _pairs_sql("m", LINE_NUMBERS, _RANKED))
def corr_spearman(spark, sf):
    return rounded(correlation(credit_missing(spark, sf), "spearman", LINE_NUMBERS))


_TAU = """SELECT round(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}))
  / sqrt(sum(abs(sign(p.{a} - q.{a}))) * sum(abs(sign(p.{b} - q.{b})))::DOUBLE), 6) FROM {src} p, {src} q"""
CUSTOMER_FEATS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("corr_kendall", _pairs_sql("customer", CUSTOMER_FEATS, _TAU))
def corr_kendall(spark, sf):
    return rounded(correlation(table(spark, sf, "customer"), "kendall", CUSTOMER_FEATS))


@query("corr_kendall_lineitem")
def corr_kendall_lineitem(spark, sf):
    """All pairs of the eight numeric columns: too many row pairs for a self-join in SQL."""
    return rounded(correlation(table(spark, sf, "lineitem"), "kendall", LINE_NUMBERS))


# ---- gates ---------------------------------------------------------------------------------------------

_MIXED = """SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) END AS mixed,
  CAST(l_quantity AS VARCHAR) AS digits FROM lineitem"""


def _mixed(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "N", F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string"))
        .alias("mixed"), F.col("l_quantity").cast("string").alias("digits"))


@query("to_numeric", f"SELECT l_orderkey, TRY_CAST(mixed AS DOUBLE) AS mixed, TRY_CAST(digits AS DOUBLE) AS digits FROM ({_MIXED})")
def to_numeric(spark, sf):
    return gates.to_numeric(_mixed(spark, sf), ["mixed", "digits"])


@query("numeric_cast_errors", f"""SELECT 'mixed' AS "column", count(*)::BIGINT AS bad_values FROM ({_MIXED})
  WHERE mixed IS NOT NULL AND TRY_CAST(mixed AS DOUBLE) IS NULL HAVING count(*) > 0""")
def numeric_cast_errors(spark, sf):
    return gates.numeric_cast_errors(_mixed(spark, sf), ["mixed", "digits"])


@query("columns_with_nulls", f"""WITH m AS ({MISSING}) SELECT 'l_quantity' AS "column", (count(*) - count(l_quantity))::BIGINT AS nulls FROM m
  UNION ALL SELECT 'l_linestatus', (count(*) - count(l_linestatus))::BIGINT FROM m""")
def columns_with_nulls(spark, sf):
    return gates.columns_with_nulls(credit_missing(spark, sf))


@query("binary_target_values", """SELECT l_linestatus AS target_value, (row_number() OVER (ORDER BY l_linestatus) - 1)::INT AS code
  FROM (SELECT DISTINCT l_linestatus FROM lineitem)""")
def binary_target_values(spark, sf):
    values = gates.binary_target_values(table(spark, sf, "lineitem"), "l_linestatus")
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "target_value string, code int")


@query("binarize_target", "SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS INT) AS l_linestatus FROM lineitem")
def binarize_target(spark, sf):
    return gates.binarize_target(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus")


@query("select_features", "SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def select_features(spark, sf):
    return gates.select_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf):
    return gates.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"], "o_orderstatus")


@query("protect_identifiers", "SELECT ts, event_type, value, props FROM events")
def protect_identifiers(spark, sf):
    return gates.protect_identifiers(table(spark, sf, "events"))


@query("exclusion_list", "SELECT ts, event_type, props FROM events")
def exclusion_list(spark, sf):
    """Events without their protected columns and one that the user excludes besides; naming a protected one again changes nothing."""
    events = table(spark, sf, "events")
    protected = gates.protected_columns(events)
    return events.drop(*gates.exclusions(protected, ["value", *protected[:1]]))


_NAMES = ", ".join(f"'{x}'" for x in gates.EXACT_IDENTIFIERS)
_PARTS = " OR ".join(f"contains(clean, '{x}')" for x in gates.IDENTIFIER_PARTS)


@query("identifier_columns", f"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS column_name FROM documents),
  l AS (SELECT column_name, lower(regexp_replace(column_name, '^\\s+|\\s+$', '', 'g')) AS low FROM w),
  c AS (SELECT column_name, low, regexp_replace(low, '[^0-9a-zA-Z가-힣]+', '', 'g') AS clean,
        string_split_regex(low, '[^0-9a-zA-Z가-힣]+') AS tokens FROM l)
  SELECT column_name, (clean IN ({_NAMES}) OR list_contains(tokens, 'id') OR list_contains(tokens, 'name')
    OR suffix(low, '_id') OR prefix(low, 'id_') OR {_PARTS}) AS is_identifier FROM c""")
def identifier_columns(spark, sf):
    """The name classifier over every distinct word of the documents, taken as a column name."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("column_name")).distinct()
    return gates.identifier_columns(words)

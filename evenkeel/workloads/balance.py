"""Class balance and synthetic-row queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenkeel.operators import balance as bal, synth as sy
from evenkeel.operators.smote import smote as smote_op
from evenkeel.plans.keys import add_row_id
from evenkeel.session import shared_folder
from evenkeel.sources import generated as gen
from evenkeel.streaming.ingest import ingest_generated_stream, report_generated_stream
from evenkeel.workloads.registry import (CREDIT_FEATS, TOXIC, TOXIC_FEATS, credit_lineitem, query, rounded,
                                         sql_draw, table, toxic_docs)

_DIST = """SELECT '{stage}' AS stage, CAST(toxic AS VARCHAR) AS class, count(*)::BIGINT AS n_rows,
  round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM {src} GROUP BY toxic"""


@query("class_distribution", _DIST.format(stage="all", src="labels"))
def class_distribution(spark, sf):
    return bal.class_distribution(table(spark, sf, "labels"), "toxic", "all")


_SHIFTED = "SELECT toxic, n_chars + 3 AS n_chars, quality, lang_code FROM t WHERE toxic = 1"


@query("balance_report", f"""WITH t AS ({TOXIC}), after AS (SELECT toxic FROM t UNION ALL SELECT toxic FROM t WHERE toxic = 1)
  {_DIST.format(stage='before', src='t')} UNION ALL {_DIST.format(stage='after', src='after')}""")
def balance_report(spark, sf):
    before = toxic_docs(spark, sf)
    after = bal.append_synthetic(before, before.where("toxic = 1"), "toxic", 1, "copies")
    return bal.balance_report(before, after, "toxic")


_STATUS = """SELECT count(*) = 2 AS is_binary, count(*) = 2 AND min(n) = max(n) AS is_matched, min(n)::BIGINT AS minority, max(n)::BIGINT AS majority,
  CASE WHEN count(*) = 2 THEN min(n) / max(n)::DOUBLE END AS ratio, CASE WHEN count(*) = 2 THEN (max(n) - min(n))::BIGINT END AS difference"""


@query("pair_matching_status", f"{_STATUS} FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)")
def pair_matching_status(spark, sf):
    return bal.pair_matching_status(table(spark, sf, "labels"), "toxic")


@query("pair_matching_status_multiclass", f"{_STATUS} FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)")
def pair_matching_status_multiclass(spark, sf):
    return bal.pair_matching_status(table(spark, sf, "lineitem"), "l_returnflag")


@query("rebalance_plan", """WITH k AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1),
  m AS (SELECT (SELECT label FROM k ORDER BY n, label LIMIT 1) AS minority_label, (SELECT label FROM k ORDER BY n DESC, label DESC LIMIT 1) AS majority_label,
        min(n)::BIGINT AS minority, max(n)::BIGINT AS majority FROM k)
  SELECT *, minority / majority::DOUBLE AS current_ratio, 0.5::DOUBLE AS target_ratio, greatest(0, ceil(majority * 0.5) - minority)::BIGINT AS needed FROM m""")
def rebalance_plan(spark, sf):
    return bal.rebalance_plan(table(spark, sf, "labels"), "toxic", 0.5)


@query("append_synthetic", f"""WITH t AS ({TOXIC}), a AS (SELECT toxic, n_chars, quality, lang_code, false AS is_synthetic FROM t
    UNION ALL SELECT *, true FROM ({_SHIFTED})) SELECT *, 'shifted' AS method FROM a""")
def append_synthetic(spark, sf):
    train = toxic_docs(spark, sf).drop("doc_id")
    shifted = train.where("toxic = 1").drop("toxic").withColumn("n_chars", F.col("n_chars") + 3)
    return bal.append_synthetic(train, shifted, "toxic", 1, "shifted")


# ---- SMOTE ------------------------------------------------------------------------------------------------

_PID = "md5('[' || n_chars || ',' || quality || ',' || lang_code || ']')"
_DIST2 = "(p.n_chars - q.n_chars) ** 2 + (p.quality - q.quality) ** 2 + (p.lang_code - q.lang_code) ** 2"


@query("smote", f"""WITH t AS ({TOXIC}), mino AS (SELECT n_chars, quality, lang_code, {_PID} AS pid, row_number() OVER (ORDER BY {_PID}) - 1 AS pos,
    row_number() OVER (PARTITION BY {_PID}) AS copy FROM t WHERE toxic = 1),
  near AS (SELECT p.pos, q.n_chars AS a, q.quality AS b, q.lang_code AS c,
    row_number() OVER (PARTITION BY p.pos ORDER BY {_DIST2}, CASE WHEN p.pid = q.pid THEN 0 ELSE 1 END, q.pid) - 1 AS slot
    FROM mino p JOIN mino q ON p.pos <> q.pos),
  need AS (SELECT (2 * count(*) FILTER (toxic = 0) - count(*))::BIGINT AS n, count(*) FILTER (toxic = 1) AS m FROM t),
  draws AS (SELECT i, {sql_draw(42, "'base|' || i")} % m AS pos, {sql_draw(42, "'slot|' || i")} % 5 AS slot,
    {sql_draw(42, "'gap|' || i")} / 1152921504606846976.0::DOUBLE AS gap FROM need, range((SELECT n FROM need)) r(i))
  SELECT n_chars, quality, lang_code, toxic, false AS is_synthetic FROM t UNION ALL
  SELECT round(p.n_chars + (a - p.n_chars) * gap, 6), round(p.quality + (b - p.quality) * gap, 6), round(p.lang_code + (c - p.lang_code) * gap, 6), 1, true
  FROM draws d JOIN mino p ON p.pos = d.pos JOIN near n ON n.pos = d.pos AND n.slot = d.slot""")
def smote(spark, sf):
    """Train rows and SMOTE rows at 1:1 with k = 5."""
    train = toxic_docs(spark, sf).select(*TOXIC_FEATS, "toxic")
    return rounded(smote_op(train, TOXIC_FEATS, "toxic", 1.0, 5).drop("method"))


@query("smote_lineitem")
def smote_lineitem(spark, sf):
    """SMOTE over the returned lines: too many distances for SQL."""
    df = credit_lineitem(spark, sf).select(*CREDIT_FEATS, "target")
    return smote_op(df, CREDIT_FEATS, "target", 1.0, 5)


# ---- external synthetic rows -------------------------------------------------------------------------------

def _outside(spark, sf):
    """Stand-in for an external generator: every document as a synthetic row, shifted, with untidy headers."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id"), (F.col("n_chars") + 7.4).alias(" n_chars"), F.lit(0.6).alias("quality "),
                       (F.length("source") % 5).cast("string").alias("lang_code"), F.lit("x").alias("toxic"))


_OUTSIDE = "SELECT doc_id, n_chars + 7.4::DOUBLE AS n_chars, 0.6::DOUBLE AS quality, (length(source) % 5)::DOUBLE AS lang_code FROM documents"


@query("validate_synthetic", f"""SELECT unnest(['columns', 'extra_columns', 'numeric', 'missing', 'rows']) AS check_name,
  unnest([true, true, true, true, count(*) >= 297]) AS passed, unnest(['', 'doc_id', '', '', count(*) || ' of 297']) AS detail FROM ({_OUTSIDE})""")
def validate_synthetic(spark, sf):
    return sy.validate_synthetic(_outside(spark, sf), TOXIC_FEATS, "toxic", 297)[1]


@query("validate_synthetic_rejects", f"""SELECT 'columns' AS check_name, true AS passed, '' AS detail UNION ALL SELECT 'extra_columns', true, ''
  UNION ALL SELECT 'numeric', count(*) = 0, CASE WHEN count(*) = 0 THEN '' ELSE 'o_orderpriority' END FROM orders WHERE try_cast(o_orderpriority AS DOUBLE) IS NULL""")
def validate_synthetic_rejects(spark, sf):
    rows = table(spark, sf, "orders").select("o_totalprice", "o_orderpriority")
    return sy.validate_synthetic(rows, ["o_totalprice", "o_orderpriority"], "target", 10)[1]


_DOMAIN = """d AS (SELECT min(n_chars) AS n_lo, max(n_chars) AS n_hi, min(quality) AS q_lo, max(quality) AS q_hi, min(lang_code) AS l_lo,
    max(lang_code) AS l_hi, list(DISTINCT quality) AS q_v, list(DISTINCT lang_code) AS l_v FROM real)"""
_NEAREST = "list_sort(list_transform({v}, lambda z: {{'d': abs(z - {x}), 'v': z}}))[1].v"


def _snap_sql(src: str, keep: str = "") -> str:
    q, g = "greatest(least(quality, q_hi), q_lo)", "greatest(least(lang_code, l_hi), l_lo)"
    return (f"SELECT {keep} greatest(least(n_chars, n_hi), n_lo) AS n_chars, {_NEAREST.format(v='q_v', x=q)} AS quality, "
            f"{_NEAREST.format(v='l_v', x=g)} AS lang_code FROM {src}, d")


@query("snap_to_domain", f"""WITH t AS ({TOXIC}), real AS (SELECT * FROM t WHERE toxic = 1), {_DOMAIN}, o AS ({_OUTSIDE}) {_snap_sql('o', 'doc_id,')}""")
def snap_to_domain(spark, sf):
    real = toxic_docs(spark, sf).where("toxic = 1").select(*TOXIC_FEATS)
    rows = _outside(spark, sf).drop("toxic")
    tidy = rows.toDF(*[c.strip() for c in rows.columns])
    return sy.snap_to_domain(tidy, real)


@query("apply_synthetic", f"""WITH t AS ({TOXIC}), real AS (SELECT * FROM t WHERE toxic = 1), {_DOMAIN},
  need AS (SELECT greatest(0, ceil(count(*) FILTER (toxic = 0) * 0.5) - count(*) FILTER (toxic = 1))::BIGINT AS n FROM t),
  o AS ({_OUTSIDE}), s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {sql_draw(42, 'CAST(doc_id AS VARCHAR)')}, CAST(doc_id AS VARCHAR)) AS rn FROM o) WHERE rn <= (SELECT n FROM need))
  SELECT n_chars, quality, lang_code, toxic, false AS is_synthetic, 'external (ratio=0.50)' AS method FROM t UNION ALL
  SELECT *, 1, true, 'external (ratio=0.50)' FROM ({_snap_sql('s')})""")
def apply_synthetic(spark, sf):
    train = toxic_docs(spark, sf).select(*TOXIC_FEATS, "toxic")
    plan = bal.require_plan(train, "toxic", 0.5)
    rows = _outside(spark, sf)
    clean, _ = sy.validate_synthetic(rows, [*TOXIC_FEATS, "doc_id"], "toxic", plan.needed)
    keyed = add_row_id(clean.withColumn("doc_id", F.col("doc_id").cast("bigint")), ["doc_id"]).drop("doc_id")
    return sy.apply_synthetic(train, keyed, TOXIC_FEATS, "toxic", plan, "row_id")


def _profile_sql(c: str) -> str:
    values = f"(SELECT list_sort(list(DISTINCT {c})) FROM real)"
    return f"""SELECT '{c}' AS "column", 'double' AS dtype, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean,
    round(CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0 END, 6) AS std, quantile_cont({c}, 0.25) AS q1, median({c}) AS median,
    quantile_cont({c}, 0.75) AS q3, CASE WHEN (SELECT count(DISTINCT {c}) FROM real) <= 20 THEN {values} END AS allowed_values FROM real"""


@query("minority_profile", f"WITH t AS ({TOXIC}), real AS (SELECT * FROM t WHERE toxic = 1) " + "\nUNION ALL\n".join(
    _profile_sql(c) for c in TOXIC_FEATS))
def minority_profile(spark, sf):
    return rounded(sy.minority_profile(toxic_docs(spark, sf).where("toxic = 1"), TOXIC_FEATS))


@query("bootstrap_columns", f"""WITH t AS ({TOXIC}), real AS (SELECT n_chars, lang_code, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pick FROM t WHERE toxic = 1),
  s AS (SELECT (o_orderkey // 25)::BIGINT AS batch_no, (o_orderkey % 25)::BIGINT AS row_no, o_totalprice FROM orders)
  SELECT batch_no, row_no, o_totalprice, n_chars, lang_code FROM (SELECT *, ('0x' || substr(md5((42 + batch_no) || '|' || row_no), 1, 15))::BIGINT
    % (SELECT count(*) FROM real) AS pick FROM s) JOIN real USING (pick)""")
def bootstrap_columns(spark, sf):
    """Withheld columns for one generated row per order."""
    real = toxic_docs(spark, sf).where("toxic = 1")
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 25).alias("batch_no"),
                                             (F.col("o_orderkey") % 25).alias("row_no"), "o_totalprice")
    return sy.bootstrap_columns(rows, real, ["n_chars", "lang_code"], "doc_id")


@query("drop_copies", """WITH s AS (SELECT l_orderkey, l_quantity, (l_discount + CASE WHEN l_tax > 0.04 THEN 0.5 ELSE 0 END) AS l_discount FROM lineitem),
  k AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R')
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_quantity = s.l_quantity AND k.l_discount = s.l_discount)""")
def drop_copies(spark, sf):
    lines = table(spark, sf, "lineitem")
    synthetic = lines.select("l_orderkey", "l_quantity", (F.col("l_discount") + F.when(F.col("l_tax") > 0.04, 0.5).otherwise(0.0)).alias("l_discount"))
    return sy.drop_copies(synthetic, lines.where("l_returnflag = 'R'"), ["l_quantity", "l_discount"])


@query("finish_generated", f"""WITH t AS ({TOXIC}), real AS (SELECT n_chars, quality, lang_code, toxic FROM t),
  made AS (SELECT n_chars + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 0.5 END AS n_chars, quality, lang_code FROM t WHERE toxic = 0),
  fresh AS (SELECT * FROM made WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.n_chars = made.n_chars AND r.quality = made.quality AND r.lang_code = made.lang_code)),
  k AS (SELECT toxic, count(*) AS n FROM (SELECT toxic FROM real UNION ALL SELECT 1 FROM fresh) GROUP BY 1)
  {_STATUS} FROM k""")
def finish_generated(spark, sf):
    """Generated rows, half of them copies: copies go, the rest is appended, the 1:1 status is reported."""
    docs = toxic_docs(spark, sf)
    made = docs.where("toxic = 0").select((F.col("n_chars") + F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.5)).alias("n_chars"),
                                          "quality", "lang_code")
    return sy.finish_generated(docs.select(*TOXIC_FEATS, "toxic"), made, TOXIC_FEATS, "toxic", 1)[1]


_RATIOS = [0.05, 0.1, 0.3, 0.5, 0.75, 1.0, 1.1]


@query("ratio_guard", f"""WITH c AS (SELECT least(sum(r), sum(1 - r)) AS lo, greatest(sum(r), sum(1 - r)) AS hi FROM (SELECT CAST(l_returnflag = 'R' AS INT) AS r FROM lineitem)),
  t AS (SELECT unnest({_RATIOS}::DOUBLE[]) AS target_ratio), p AS (SELECT target_ratio, lo, hi, lo / hi AS current_ratio,
    CASE WHEN target_ratio NOT BETWEEN 0.1 AND 1 THEN 'the target ratio must lie in 0.10..1.00'
      WHEN target_ratio <= lo / hi THEN 'the target ratio must exceed the current one' END AS problem FROM t, c)
  SELECT target_ratio, round(current_ratio, 6) AS current_ratio, CASE WHEN problem IS NULL THEN ceil(hi * target_ratio) - lo END::BIGINT AS needed, problem FROM p""")
def ratio_guard(spark, sf):
    """Which target ratios the returned lines allow."""
    return bal.ratio_report(credit_lineitem(spark, sf), "target", _RATIOS).withColumn("current_ratio", F.round("current_ratio", 6))


# ---- requests, responses, costs ------------------------------------------------------------------------------

@query("generation_batches", """SELECT i + 1 AS batch_no, least(25, n - i * 25)::BIGINT AS n_rows FROM
  (SELECT count(*) FILTER (toxic = 0) - count(*) FILTER (toxic = 1) AS n FROM labels), range(100000) r(i) WHERE i * 25 < n""")
def generation_batches(spark, sf):
    """Requests for the missing minority rows, by size; `generation_requests` compares their text."""
    return _requests(spark, sf).where(F.length("request") > 0).drop("request")


def _requests(spark, sf):
    real = toxic_docs(spark, sf).where("toxic = 1")
    plan = bal.require_plan(table(spark, sf, "labels"), "toxic")
    examples = sy.example_rows(real.withColumn("row_id", F.col("doc_id").cast("string")), 10, "row_id")
    payload = sy.request_payload(real, ["doc_id", "toxic"], examples)
    return sy.generation_batches(spark, payload, plan.needed, 25)


_FEATURE = "struct<dtype:string,min:double,max:double,mean:double,std:double,q1:double,median:double,q3:double,allowed_values:array<double>>"
_REQUEST = (f"task string, rules array<string>, minority_feature_profile map<string,{_FEATURE}>, "
            "example_minority_rows array<map<string,double>>, number_of_rows long")
_EXAMPLES = f"(SELECT * FROM real ORDER BY {sql_draw(sy.SEED, 'CAST(doc_id AS VARCHAR)')}, CAST(doc_id AS VARCHAR) LIMIT 10)"


@query("generation_requests", f"""WITH t AS ({TOXIC}), real AS (SELECT * FROM t WHERE toxic = 1),
  b AS (SELECT i + 1 AS batch_no, least(25, n - i * 25)::BIGINT AS number_of_rows FROM
    (SELECT count(*) FILTER (toxic = 0) - count(*) FILTER (toxic = 1) AS n FROM labels), range(100000) r(i) WHERE i * 25 < n),
  p AS ({" UNION ALL ".join(f"SELECT (SELECT sum({c}) FROM {_EXAMPLES}) AS example_sum, * FROM ({_profile_sql(c)})" for c in TOXIC_FEATS)})
  SELECT batch_no, number_of_rows, '{sy.TASK}' AS task, {len(sy.RULES)} AS n_rules, 10 AS n_examples, p.* FROM b, p""")
def generation_requests(spark, sf):
    """The text of every request, read back: the rows it asks for, the profile of each feature and the example rows."""
    read = _requests(spark, sf).select("batch_no", F.from_json("request", _REQUEST).alias("r")).select("batch_no", "r.*")
    wide = read.select("batch_no", "number_of_rows", "task", F.size("rules").alias("n_rules"), F.size("example_minority_rows").alias("n_examples"),
                       "example_minority_rows", F.explode("minority_feature_profile").alias("column", "feature"))
    total = F.aggregate("example_minority_rows", F.lit(0.0), lambda s, row: s + F.element_at(row, F.col("column")))
    return rounded(wide.select("batch_no", "number_of_rows", "task", "n_rules", "n_examples", total.alias("example_sum"), "column", "feature.*"))


@query("pending_batches", """SELECT l_orderkey AS batch_no FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def pending_batches(spark, sf):
    """Every order with lines is a planned batch; finished orders are done."""
    planned = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_no")).distinct()
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_no"))
    return sy.open_batches(planned, done)


def _responses(spark, sf):
    """One response per 25 customers, as JSON; a text balance and a missing one do not survive the checks."""
    rows = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 25).alias("batch_no"), F.struct(
            F.col("c_custkey"),
            F.when(F.col("c_nationkey") == 3, F.lit("n/k")).when(F.col("c_nationkey") != 7, F.col("c_acctbal").cast("string")).alias("c_acctbal"),
            F.col("c_nationkey")).alias("cell"))
    return (rows.groupBy("batch_no").agg(F.array_sort(F.collect_list("cell")).alias("rows"))      # 25 rows per batch by construction
            .select("batch_no", F.to_json(F.struct("rows")).alias("response")))


@query("parse_generated", """SELECT (c_custkey // 25)::BIGINT AS batch_no, (row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) - 1)::INT AS row_no,
  c_custkey::DOUBLE AS c_custkey, c_acctbal FROM customer QUALIFY c_nationkey NOT IN (3, 7)""")
def parse_generated(spark, sf):
    return sy.parse_generated(_responses(spark, sf), ["c_custkey", "c_acctbal"])


@query("response_report", """SELECT (c_custkey // 25)::BIGINT AS batch_no, count(*)::BIGINT AS n_rows, count(*) FILTER (c_nationkey NOT IN (3, 7))::BIGINT AS n_valid,
  CASE WHEN count(*) FILTER (c_nationkey NOT IN (3, 7)) = 0 THEN 'no valid numeric row' END AS problem FROM customer GROUP BY 1""")
def response_report(spark, sf):
    return sy.response_report(_responses(spark, sf), ["c_custkey", "c_acctbal"])


def _prices(spark, sf):
    """A price per nation stands in for a price list of models."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("model_id"), (F.col("n_nationkey") / 10.0 + 0.05).alias("input_per_million"),
                                             (F.col("n_nationkey") / 2.0 + 0.4).alias("output_per_million"))


_PRICES = "p AS (SELECT n_name AS model_id, n_nationkey / 10.0::DOUBLE + 0.05 AS input_per_million, n_nationkey / 2.0::DOUBLE + 0.4 AS output_per_million FROM nation)"
_COSTS = """round(input_tokens / 1e6 * input_per_million, 6) AS input_cost, round(output_tokens / 1e6 * output_per_million, 6) AS output_cost,
  round(input_tokens / 1e6 * input_per_million + output_tokens / 1e6 * output_per_million, 6) AS total_cost"""


@query("generation_cost", f"""WITH {_PRICES}, u AS (SELECT count(*)::BIGINT AS calls,
    sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END + 30)::BIGINT AS input_tokens,
    sum(25 * (greatest(1, ceil(length(source) / 4.0)) + 2) + 12)::BIGINT AS output_tokens FROM documents)
  SELECT model_id, calls, input_tokens, output_tokens, {_COSTS} FROM u, p""")
def generation_cost(spark, sf):
    requests = table(spark, sf, "documents").select(F.col("text").alias("request"), F.lit(25).cast("bigint").alias("n_rows"), F.col("source").alias("row_text"))
    return rounded(sy.generation_cost(requests, _prices(spark, sf)))


@query("usage_cost", f"""WITH {_PRICES}, u AS (SELECT n_name AS model_id, sum(o_custkey)::BIGINT AS input_tokens, sum(o_orderkey)::BIGINT AS output_tokens
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
  SELECT model_id, input_tokens, output_tokens, {_COSTS} FROM u JOIN p USING (model_id)""")
def usage_cost(spark, sf):
    usage = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
             .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
             .select(F.col("n_name").alias("model_id"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens")))
    return rounded(sy.usage_cost(usage, _prices(spark, sf)))


def _double_sql(c: str) -> str:
    """A double as <53-bit integer>p<power of two>."""
    p, w = f"floor(log2(abs({c})))", f"({c} / pow(2.0::DOUBLE, floor(log2(abs({c})))) * 4503599627370496.0::DOUBLE)"
    return (f"CASE WHEN {c} = 0 THEN '0' WHEN abs{w} >= 9007199254740992.0::DOUBLE THEN ({w} / 2)::BIGINT || 'p' || ({p} + 1)::BIGINT "
            f"WHEN abs{w} < 4503599627370496.0::DOUBLE THEN ({w} * 2)::BIGINT || 'p' || ({p} - 1)::BIGINT ELSE {w}::BIGINT || 'p' || {p}::BIGINT END")


def signature_sql(src: str, cols: dict[str, str]) -> str:
    shown = {c: f"({_double_sql(c)})" if t == "double" else f"CAST({c} AS VARCHAR)" for c, t in cols.items()}
    text = " || ".join(f"coalesce(length({v}) || ':' || {v}, '-')" for v in shown.values())
    schema = "|".join(f"{c}:{t}" for c, t in cols.items())
    return f"""(SELECT sha256(count(*) || '|' || sum(u::HUGEINT) || '|' || bit_xor(u) || '|{schema}') FROM (SELECT {sql_draw(0, text)} AS u FROM {src}))"""


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("dataset_signature", f"SELECT {signature_sql('customer', _CUSTOMER)} AS signature")
def dataset_signature(spark, sf):
    return sy.dataset_signature(table(spark, sf, "customer"))


@query("job_id", f"""SELECT substr(sha256('{{"batch_size": 25, "columns": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "data_signature": "' ||
  {signature_sql('customer', _CUSTOMER)} || '", "excluded_cols": ["c_custkey", "c_name"], "target_rows": 100}}'), 1, 24) AS job_id""")
def job_id(spark, sf):
    df = table(spark, sf, "customer")
    job, _ = sy.job_id(df, {"batch_size": 25, "excluded_cols": ["c_name", "c_custkey"], "target_rows": 100})
    return spark.createDataFrame([(job,)], "job_id string")


# ---- checkpoints and the stream ---------------------------------------------------------------------------------

def _generated(spark, sf):
    return table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).alias("batch_no"), (F.col("o_orderkey") % 1000).cast("int").alias("row_no"), "o_totalprice")


@query("checkpoint_round_trip", """SELECT (o_orderkey // 1000)::BIGINT AS batch_no, (o_orderkey % 1000)::INT AS row_no, o_totalprice FROM orders""")
def checkpoint_round_trip(spark, sf):
    """Save all batches, drop the run, save again in two parts with one batch written twice, read back."""
    path = f"{shared_folder(spark)}/generated-{uuid.uuid4().hex}"
    rows = _generated(spark, sf)
    gen.write_generated(rows, path, "job-a", {"target_rows": 1})
    gen.drop_generated(spark, path, "job-a")
    gen.write_generated(rows.where("batch_no <= 3"), path, "job-a", {"target_rows": 1})
    gen.write_generated(rows.where("batch_no >= 3"), path, "job-a", {"target_rows": 1}, "completed")
    return gen.read_generated(spark, path, "job-a")[0].select("batch_no", "row_no", "o_totalprice")


@query("validate_checkpoint", """WITH lo AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'F')
  SELECT (o_orderkey // 1000)::BIGINT AS batch_no, (o_orderkey % 1000)::INT AS row_no, greatest(least(o_totalprice, b), a) AS o_totalprice FROM orders, lo
  ORDER BY 1, 2 LIMIT 2345""")
def validate_checkpoint(spark, sf):
    """An imported checkpoint snapped to the finished orders and cut to its target rows."""
    real = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_totalprice")
    return gen.validate_checkpoint(_generated(spark, sf), {"job_id": "j"}, "j", ["o_totalprice"], real, 2345)


@query("ingest_generated_stream", """WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT batch_no, row_no, c_custkey, greatest(least(c_acctbal, b), a) AS c_acctbal FROM (
  SELECT (c_custkey // 25)::BIGINT AS batch_no, (row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) - 1)::INT AS row_no,
  c_custkey::DOUBLE AS c_custkey, c_acctbal FROM customer QUALIFY c_nationkey NOT IN (3, 7)), r""")
def ingest_generated_stream_query(spark, sf):
    """Response files arrive twice; the stream is stopped and started again in between."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    responses = _responses(spark, sf)
    real = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_acctbal")
    for part in (responses.where("batch_no % 2 = 0"), responses):
        part.write.mode("append").json(f"{base}/in")
        ingest_generated_stream(spark, f"{base}/in", ["c_custkey", "c_acctbal"], f"{base}/out", f"{base}/state", real).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("batch_no", "row_no", "c_custkey", "c_acctbal")


@query("report_generated_stream", """SELECT (c_custkey // 25)::BIGINT AS batch_no, CASE (c_custkey // 25) % 5 WHEN 1 THEN count(*) ELSE 0 END::BIGINT AS n_rows,
  0::BIGINT AS n_valid, CASE (c_custkey // 25) % 5 WHEN 1 THEN 'absent column c_acctbal' ELSE 'no rows' END AS problem
  FROM customer WHERE (c_custkey // 25) % 5 IN (1, 2, 3) GROUP BY c_custkey // 25""")
def report_generated_stream_query(spark, sf):
    """Of five responses one lacks a column, one is empty, one is cut off; they arrive twice and are reported once."""
    base = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    kind = F.col("batch_no") % 5
    good = _responses(spark, sf).where("batch_no % 5 NOT IN (1, 2, 3) OR batch_no % 5 = 2").withColumn(
        "response", F.when(kind == 2, F.lit('{"rows": []}')).otherwise(
            F.regexp_replace("response", '"c_acctbal":"n/k"', '"c_acctbal":"1"')))
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 25).alias("batch_no"), F.struct("c_custkey").alias("cell"))
    bad = (rows.where("batch_no % 5 IN (1, 3)").groupBy("batch_no").agg(F.collect_list("cell").alias("rows"))
           .select("batch_no", F.to_json(F.struct("rows")).alias("response"))
           .withColumn("response", F.when(kind == 3, F.expr("substring(response, 1, length(response) - 9)")).otherwise(F.col("response"))))
    for _ in range(2):
        good.unionByName(bad).write.mode("append").json(f"{base}/in")
        report_generated_stream(spark, f"{base}/in", ["c_custkey", "c_acctbal"], f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("batch_no", "n_rows", "n_valid", "problem")


@query("resume_generation", """WITH k AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer WHERE c_mktsegment = 'BUILDING'),
  r AS (SELECT (c_custkey // 25 + 1)::BIGINT AS batch_no, (row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) - 1)::INT AS row_no,
    c_custkey::DOUBLE AS c_custkey, c_acctbal FROM customer QUALIFY c_nationkey NOT IN (3, 7)),
  old AS (SELECT * FROM r WHERE batch_no <= 4), missing AS (SELECT 900 - count(*) AS n FROM old),
  fresh AS (SELECT * FROM r WHERE batch_no > 4 AND batch_no <= 4 + ceil((SELECT n FROM missing) / 25.0::DOUBLE) ORDER BY batch_no, row_no LIMIT (SELECT n FROM missing))
  SELECT batch_no, row_no, c_custkey, c_acctbal FROM old UNION ALL SELECT batch_no, row_no, c_custkey, greatest(least(c_acctbal, b), a) FROM fresh, k""")
def resume_generation(spark, sf):
    """A run stopped after four batches goes on from its checkpoint, with the responses of all customers at hand."""
    path, cols = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}", ["c_custkey", "c_acctbal"]
    responses = _responses(spark, sf).withColumn("batch_no", F.col("batch_no") + 1)
    gen.write_generated(sy.parse_generated(responses.where("batch_no <= 4"), cols), path, "job-r", {"input_tokens": 10})
    real = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_acctbal")
    rows, report = gen.resume_generation(spark, path, "job-r", responses, cols, 900, 25, real, usage={"input_tokens": 5, "output_tokens": 7})
    if report["input_tokens"] != 15 or report["output_tokens"] != 7:
        raise ValueError(f"the token totals were not carried on: {report}")
    return rows.select("batch_no", "row_no", "c_custkey", "c_acctbal")

"""Cleaning, encoding, selection, splitting and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import clean, encode, gates, select as sel, split as sp
from evenkeel.plans.keys import add_row_id
from evenkeel.plans.quota import assign_parts
from evenkeel.plans.recipe import Recipe, Workspace
from evenkeel.session import shared_folder
from evenkeel.sources import tables as src
from evenkeel.workloads.balance import signature_sql
from evenkeel.workloads.registry import (CREDIT, CREDIT_FEATS, LINE_ID, LINE_KEYS, MISSING, TOXIC, TOXIC_FEATS, credit_lineitem,
                                         credit_missing, query, rounded, sql_draw, table, toxic_docs)

KEEP = ["l_orderkey", "l_linenumber", "l_quantity", "l_linestatus"]


def _holes(spark, sf):
    return credit_missing(spark, sf).select(*KEEP)


_H = f"WITH m AS (SELECT {', '.join(KEEP)} FROM ({MISSING}))"
_MODE = "(SELECT {c} FROM m WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _impute(name: str, quantity: str, status: str, method: str, **options) -> None:
    @query(name, f"""{_H} SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, {quantity}), 4) AS l_quantity,
      {status} AS l_linestatus FROM m""")
    def run(spark, sf):
        return rounded(clean.impute(_holes(spark, sf), ["l_quantity", "l_linestatus"], method, **options), 4)


_STATUS_MODE = f"coalesce(l_linestatus, {_MODE.format(c='l_linestatus')})"
_impute("impute_auto", "(SELECT quantile_cont(l_quantity, 0.5) FROM m)", _STATUS_MODE, "auto")
_impute("impute_mean", "(SELECT avg(l_quantity) FROM m)", "l_linestatus", "mean")
_impute("impute_median", "(SELECT quantile_cont(l_quantity, 0.5) FROM m)", "l_linestatus", "median")
_impute("impute_mode", _MODE.format(c="l_quantity"), _STATUS_MODE, "mode")
_impute("impute_constant", "0.0", "coalesce(l_linestatus, '0')", "constant", value="0")


@query("drop_missing_rows", f"{_H} SELECT * FROM m WHERE l_quantity IS NOT NULL AND l_linestatus IS NOT NULL")
def drop_missing_rows(spark, sf):
    return clean.drop_missing_rows(_holes(spark, sf), ["l_quantity", "l_linestatus"])


_FENCE = """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"""


@query("filter_iqr", f"""{_FENCE} SELECT event_id, event_type, value FROM events, q
  WHERE value IS NULL OR value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def filter_iqr(spark, sf):
    return clean.filter_iqr(table(spark, sf, "events").select("event_id", "event_type", "value"), ["value"], 1.5)


@query("winsorize_iqr", f"""{_FENCE} SELECT event_id, event_type,
  round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events, q""")
def winsorize_iqr(spark, sf):
    return rounded(clean.winsorize_iqr(table(spark, sf, "events").select("event_id", "event_type", "value"), ["value"], 1.5))


@query("filter_zscore", """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
  SELECT event_id, event_type, value FROM events, s WHERE value IS NULL OR abs((value - m) / d) <= 3.0""")
def filter_zscore(spark, sf):
    return clean.filter_zscore(table(spark, sf, "events").select("event_id", "event_type", "value"), ["value"], 3.0)


@query("preprocessing_log", f"""WITH m AS ({MISSING}), q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a,
    quantile_cont(l_extendedprice, 0.75) AS b FROM m WHERE l_quantity IS NOT NULL)
  SELECT 1 AS step_no, 'drop rows / l_quantity' AS action, (SELECT count(*) FROM m)::BIGINT AS rows_before, (SELECT count(l_quantity) FROM m)::BIGINT AS rows_after
  UNION ALL SELECT 2, 'IQR filter / l_extendedprice', (SELECT count(l_quantity) FROM m)::BIGINT, (SELECT count(*) FROM m, q
    WHERE l_quantity IS NOT NULL AND l_extendedprice BETWEEN a - 1.0 * (b - a) AND b + 1.0 * (b - a))::BIGINT""")
def preprocessing_log(spark, sf):
    recipe = Recipe(credit_missing(spark, sf))
    recipe.apply("drop rows / l_quantity", lambda d: clean.drop_missing_rows(d, ["l_quantity"]))
    recipe.apply("IQR filter / l_extendedprice", lambda d: clean.filter_iqr(d, ["l_extendedprice"], 1.0))
    return recipe.log()


@query("reset_to_raw", f"SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus FROM ({MISSING})")
def reset_to_raw(spark, sf):
    """Two steps, one of them written by the log, and back to the raw table."""
    recipe = Recipe(_holes(spark, sf))
    recipe.apply("drop rows / l_quantity", lambda d: clean.drop_missing_rows(d, ["l_quantity"]))
    recipe.log()
    recipe.apply("drop columns / l_linestatus", lambda d: d.drop("l_linestatus")).reset()
    if recipe.actions or recipe.log().count():
        raise ValueError("a reset recipe keeps no steps")
    return recipe.current


@query("load_resets_state", """SELECT 'lineitem again' AS loaded, 1::BIGINT AS n_steps, count(*) FILTER (l_quantity > 25)::BIGINT AS n_rows FROM lineitem
  UNION ALL SELECT 'orders', 0, count(*) FROM orders UNION ALL SELECT 'lineitem after orders', 0, count(*) FROM lineitem""")
def load_resets_state(spark, sf):
    """Loading the same content keeps the steps; other content starts afresh."""
    work, found = Workspace(spark), []
    work.load(f"{sf}/lineitem.parquet", "parquet").apply("filter / l_quantity", lambda d: d.where("l_quantity > 25"))
    for name, path in (("lineitem again", "lineitem"), ("orders", "orders"), ("lineitem after orders", "lineitem")):
        recipe = work.load(f"{sf}/{path}.parquet", "parquet")
        found.append(recipe.current.agg(F.lit(name).alias("loaded"), F.lit(len(recipe.actions)).cast("bigint").alias("n_steps"),
                                        F.count(F.lit(1)).alias("n_rows")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("csv_documents", f"""SELECT doc_id, CASE WHEN text NOT IN ({', '.join(f"'{t}'" for t in src.MISSING_TOKENS)}) THEN text END AS text FROM documents""")
def csv_documents(spark, sf):
    """Whole texts, nearly all with line breaks, as CSV and back; the files are read in splits."""
    import uuid

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    src.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return src.read_table(spark, path, "csv")


def _one_hot(name: str, drop_first: bool) -> None:
    statuses, flags = ["F", "O"], ["A", "N", "R"]
    first = 1 if drop_first else 0
    cols = ", ".join([f"coalesce(l_linestatus = '{v}', false)::INT AS \"l_linestatus_{v}\"" for v in statuses[first:]]
                     + [f"coalesce(l_returnflag = '{v}', false)::INT AS \"l_returnflag_{v}\"" for v in flags[first:]])

    @query(name, f"WITH m AS ({MISSING}) SELECT l_orderkey, l_linenumber, {cols} FROM m")
    def run(spark, sf):
        df = credit_missing(spark, sf).select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
        return encode.one_hot(df, ["l_linestatus", "l_returnflag"], drop_first)


_one_hot("one_hot", False)
_one_hot("one_hot_drop_first", True)


@query("ordinal_encode", """WITH c AS (SELECT c_mktsegment AS v, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code
    FROM (SELECT DISTINCT c_mktsegment FROM customer))
  SELECT c_custkey, code AS c_mktsegment FROM customer JOIN c ON v = c_mktsegment""")
def ordinal_encode(spark, sf):
    return encode.ordinal_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("ordinal_encode_wide", """WITH c AS (SELECT p_name AS v, (row_number() OVER (ORDER BY p_name) - 1)::DOUBLE AS code
    FROM (SELECT DISTINCT p_name FROM part))
  SELECT p_partkey, code AS p_name FROM part JOIN c ON v = p_name""")
def ordinal_encode_wide(spark, sf):
    """A text column with many categories: codes are joined, not inlined."""
    return encode.ordinal_encode(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], cap=100)


@query("encoding_maps", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS category, (row_number() OVER (ORDER BY o_orderstatus) - 1)::INT AS code
  FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL
  SELECT 'o_orderpriority', o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def encoding_maps(spark, sf):
    return encode.encoding_maps(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


# ---- feature selection -----------------------------------------------------------------------------------

def _binned_sql(c: str, bins: int = 10) -> str:
    edges = " + ".join(f"({c} > q[{i + 1}])::INT" for i in range(bins - 1))
    probs = ", ".join(str((i + 1) / bins) for i in range(bins - 1))
    return f"""SELECT '{c}' AS feature, greatest(0.0, sum(n / t * ln(n * t / (nb * nc)))) AS score FROM (
    SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY bin)::DOUBLE AS nb, sum(n) OVER (PARTITION BY target)::DOUBLE AS nc FROM (
    SELECT {edges} AS bin, target, count(*) AS n FROM c, (SELECT quantile_cont({c}, [{probs}]) AS q FROM c) GROUP BY 1, 2))"""


# the ties among quantile edges are harmless: repeated edges shift bin numbers but not the bins
_BINNED = f"WITH c AS ({CREDIT}), s AS ({' UNION ALL '.join(_binned_sql(c) for c in CREDIT_FEATS)})"


@query("mutual_info_binned", f"{_BINNED} SELECT feature, round(score, 6) AS score FROM s")
def mutual_info_binned(spark, sf):
    return rounded(sel.mutual_info(credit_lineitem(spark, sf).select(*CREDIT_FEATS, "target"), CREDIT_FEATS, "target", "binned"))


@query("select_k_best_scores", f"""{_BINNED} SELECT feature, round(score, 6) AS score,
  row_number() OVER (ORDER BY score DESC, feature) <= 2 AS selected FROM s""")
def select_k_best_scores(spark, sf):
    df = credit_lineitem(spark, sf).select(*CREDIT_FEATS, "target")
    return rounded(sel.select_k_best(df, CREDIT_FEATS, "target", 2, "binned")[1])


@query("select_k_best", "SELECT o_custkey, o_totalprice, o_orderstatus FROM orders")
def select_k_best(spark, sf):
    """Both features are kept at k = 2 of 2, so the reduced frame is known without the scores."""
    df = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    return sel.select_k_best(df, ["o_custkey", "o_totalprice"], "o_orderstatus", 2, "binned")[0]


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c})::BIGINT AS n_rows, round(sum({c}), 2) AS total FROM c" for c in CREDIT_FEATS)


@query("select_k_best_frame", f"""{_BINNED}, r AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS k FROM s)
  SELECT t.* FROM ({_LONG}) t JOIN r USING (feature) WHERE k <= 2""")
def select_k_best_frame(spark, sf):
    """The columns that are kept at k = 2 of 4, scored on all rows: which they are depends on the scores."""
    df = credit_lineitem(spark, sf).select(*CREDIT_FEATS, "target")
    kept = sel.select_k_best(df, CREDIT_FEATS, "target", 2, "binned")[0].drop("target")
    long = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept.columns])).alias("x"))
    return long.groupBy("x.feature").agg(F.count("x.v").alias("n_rows"), F.round(F.sum("x.v"), 2).alias("total"))


@query("impute_skipped", f"""WITH m AS ({MISSING}) SELECT 'mean' AS method, 'l_linestatus' AS "column", 'not numeric' AS reason
  UNION ALL SELECT 'mean', 'nothing', 'no value' FROM m HAVING count(l_quantity) > 0
  UNION ALL SELECT 'auto', 'nothing', 'no value' FROM m HAVING count(l_quantity) > 0""")
def impute_skipped(spark, sf):
    """What mean, automatic and constant fills leave alone; `nothing` has no value."""
    df = credit_missing(spark, sf).select("l_quantity", "l_linestatus", F.lit(None).cast("double").alias("nothing"))
    found = None
    for method in ("mean", "auto", "constant"):
        part = clean.skipped_columns(df, df.columns, method).select(F.lit(method).alias("method"), "column", "reason")
        found = part if found is None else found.unionByName(part)
    return found


_PSI = """psi AS (SELECT (i + 1)::BIGINT AS n, -0.5772156649015329 + coalesce(sum(CASE WHEN i > 0 THEN 1.0::DOUBLE / i END)
    OVER (ORDER BY i), 0) AS v FROM range((SELECT count(*)::BIGINT + 1 FROM customer)) t(i))"""


def _knn_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, greatest(0.0, (SELECT v FROM psi WHERE n = (SELECT count(*) FROM pts))
    + avg(pk.v) - avg(pc.v) - avg(pm.v)) AS score FROM (
    SELECT id, any_value(n_class) AS n_class, any_value(k) AS k, any_value(r) AS r, count(*) AS m FROM (
      SELECT a.id, a.n_class, a.r, CASE WHEN a.r = 0 THEN a.copies ELSE least(3, a.n_class - 1) END AS k, abs(a.{c} - b.{c}) AS d, a.{c} AS x
      FROM (SELECT *, count(*) OVER (PARTITION BY y, {c}) AS copies,
            (SELECT list_sort(list(abs(p.{c} - q.{c})))[least(3, p.n_class - 1)] FROM pts q WHERE q.y = p.y AND q.id <> p.id) AS r FROM pts p) a, pts b)
    WHERE d < greatest(r - r * 1e-9 - abs(x) * 1e-14, r / 2) OR (r = 0 AND d = 0) GROUP BY id) z
    JOIN psi pk ON pk.n = z.k JOIN psi pc ON pc.n = z.n_class JOIN psi pm ON pm.n = z.m"""


@query("mutual_info_knn", f"""WITH {_PSI}, pts AS (SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey,
    count(*) OVER (PARTITION BY c_mktsegment) AS n_class FROM customer),
  s AS ({' UNION ALL '.join(_knn_sql(c) for c in ('c_acctbal', 'c_nationkey'))}) SELECT feature, round(score, 6) AS score FROM s""")
def mutual_info_knn(spark, sf):
    df = table(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    return rounded(sel.mutual_info(df, ["c_acctbal", "c_nationkey"], "c_mktsegment", "knn"))


@query("mutual_info_knn_lineitem")
def mutual_info_knn_lineitem(spark, sf):
    """The nearest-neighbour scores of the whole line table: too many distances for SQL."""
    return rounded(sel.mutual_info(credit_lineitem(spark, sf).select(*CREDIT_FEATS, "target"), CREDIT_FEATS, "target", "knn"))


@query("factorize", """SELECT o_orderkey, c.code FROM orders JOIN (SELECT o_orderpriority AS v, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders)) c ON v = o_orderpriority""")
def factorize(spark, sf):
    return sel.factorize(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


# ---- splitting and sampling ------------------------------------------------------------------------------

def _split_sql(source: str, row_id: str, strat: str, keep: str) -> str:
    """Stratified 60/20/20: per-class sizes by largest remainder, rows by seeded hash."""
    return f"""WITH src AS ({source}), k AS (SELECT {strat} AS s, count(*) AS n FROM src GROUP BY 1),
  t AS (SELECT sum(n)::BIGINT AS n, ceil((0.2::DOUBLE + 0.2::DOUBLE) * sum(n))::BIGINT AS held FROM k),
  t2 AS (SELECT n, held, n - held AS n_train, ceil(0.2::DOUBLE / (0.2::DOUBLE + 0.2::DOUBLE) * held)::BIGINT AS n_test FROM t),
  a AS (SELECT s, k.n, floor(n_train * k.n / t2.n::DOUBLE)::BIGINT AS f, n_train * k.n / t2.n::DOUBLE AS e, t2.* EXCLUDE (n) FROM k, t2),
  b AS (SELECT s, n, held, n_test, f + (row_number() OVER (ORDER BY e - f DESC, CAST(s AS VARCHAR)) <= n_train - sum(f) OVER ())::INT AS train FROM a),
  c AS (SELECT *, n - train AS rest, (held - n_test) * (n - train) / held::DOUBLE AS e FROM b),
  d AS (SELECT s, train, floor(e)::BIGINT + (row_number() OVER (ORDER BY e - floor(e) DESC, CAST(s AS VARCHAR))
        <= (held - n_test) - sum(floor(e)) OVER ())::INT AS val FROM c),
  r AS (SELECT src.*, row_number() OVER (PARTITION BY {strat} ORDER BY {sql_draw(42, row_id)}, {row_id}) AS rn FROM src),
  out AS (SELECT r.*, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'validation' ELSE 'test' END AS split
          FROM r JOIN d ON d.s = r.{strat})
  {keep}"""


def split_lineitem(spark, sf):
    return sp.split(add_row_id(credit_lineitem(spark, sf), LINE_KEYS), "target", "row_id")


@query("split", _split_sql(CREDIT, LINE_ID, "target", f"SELECT {', '.join(LINE_KEYS)}, target, split FROM out"))
def split(spark, sf):
    return split_lineitem(spark, sf).select(*LINE_KEYS, "target", "split")


@query("split_unstratified", _split_sql(f"SELECT *, 1 AS one FROM orders", "CAST(o_orderkey AS VARCHAR)", "one",
                                       "SELECT o_orderkey, split FROM out"))
def split_unstratified(spark, sf):
    df = add_row_id(table(spark, sf, "orders"), ["o_orderkey"])
    return sp.split(df, "o_orderstatus", "row_id", stratify=False).select("o_orderkey", "split")


@query("class_counts", _split_sql(TOXIC, "CAST(doc_id AS VARCHAR)", "toxic",
                                  "SELECT split, toxic, count(*)::BIGINT AS n_rows FROM out GROUP BY ALL"))
def class_counts(spark, sf):
    return sp.class_counts(split_toxic(spark, sf), "toxic")


def split_toxic(spark, sf):
    return sp.split(add_row_id(toxic_docs(spark, sf), ["doc_id"]), "toxic", "row_id")


@query("stratum_quotas", """WITH k AS (SELECT l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY 1),
  e AS (SELECT s, 10000 * n / sum(n) OVER ()::DOUBLE AS e FROM k)
  SELECT s AS stratum, (floor(e) + (row_number() OVER (ORDER BY e - floor(e) DESC, s) <= 10000 - sum(floor(e)) OVER ())::INT)::BIGINT AS n_rows FROM e""")
def stratum_quotas(spark, sf):
    return sp.quota_table(table(spark, sf, "lineitem"), "l_returnflag", 10_000)


@query("stratum_quotas_wide", """WITH k AS (SELECT o_custkey AS s, count(*) AS n FROM orders GROUP BY 1),
  e AS (SELECT s, 5000 * n // sum(n) OVER () AS e, 5000 * n % sum(n) OVER () AS r FROM k)
  SELECT s AS stratum, (e + (row_number() OVER (ORDER BY r DESC, CAST(s AS VARCHAR)) <= 5000 - sum(e) OVER ())::INT)::BIGINT AS n_rows FROM e""")
def stratum_quotas_wide(spark, sf):
    """A sample of 5,000 orders shared among all customers in proportion to their orders."""
    return sp.quota_table(table(spark, sf, "orders"), "o_custkey", 5_000)


@query("sample_exact", f"SELECT {', '.join(LINE_KEYS)} FROM lineitem ORDER BY {sql_draw(7, LINE_ID)}, {LINE_ID} LIMIT 1234")
def sample_exact(spark, sf):
    df = add_row_id(table(spark, sf, "lineitem").select(*LINE_KEYS), LINE_KEYS)
    return sp.sample_exact(df, 1234, "row_id", 7).drop("row_id")


@query("sample_stratified", f"""WITH q(f, n) AS (VALUES ('A', 500), ('N', 300), ('R', 200)) SELECT {', '.join(LINE_KEYS)}, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {sql_draw(42, LINE_ID)}, {LINE_ID}) AS rn FROM lineitem) JOIN q ON f = l_returnflag WHERE rn <= n""")
def sample_stratified(spark, sf):
    df = add_row_id(table(spark, sf, "lineitem").select(*LINE_KEYS, "l_returnflag"), LINE_KEYS)
    parts = assign_parts(df, "row_id", F.col("l_returnflag"), ["in"], {"A": [500], "N": [300], "R": [200]})
    return parts.where("split = 'in'").drop("split", "row_id")


_COPY_ID = "md5('{\"l_returnflag\":\"' || l_returnflag || '\",\"l_linestatus\":\"' || l_linestatus || '\",\"l_linenumber\":' || l_linenumber || '}') || '-' || (row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber) - 1)"


@query("row_identity", f"SELECT l_returnflag, l_linestatus, l_linenumber, {_COPY_ID} AS row_id FROM lineitem")
def row_identity(spark, sf):
    """Row ids from content and copy number, on columns where every row has many copies."""
    return add_row_id(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("shuffle", f"SELECT o_orderkey, {sql_draw(42, 'CAST(o_orderkey AS VARCHAR)')} AS place FROM orders")
def shuffle(spark, sf):
    from evenkeel.functions.scalars import draw

    df = add_row_id(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return sp.shuffle(df, "row_id").select("o_orderkey", draw(42, "row_id").alias("place"))


# ---- sources and sinks ------------------------------------------------------------------------------------

@query("csv_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def csv_round_trip(spark, sf):
    """Write the conversations as CSV, quotes and line breaks in them, read them back with inferred types."""
    import uuid

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    src.write_csv(table(spark, sf, "conversations"), path)
    return src.read_table(spark, path, "csv")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark, sf):
    return src.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 20, "o_orderkey")


@query("scan_ranges", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem
  WHERE l_extendedprice BETWEEN 20000 AND 40000 AND l_discount >= 0.05""")
def scan_ranges(spark, sf):
    """Lines of a price range; the comparisons of doubles are made by the Parquet reader."""
    lines = src.read_table(spark, f"{sf}/lineitem.parquet", ranges={"l_extendedprice": (20000.0, 40000.0), "l_discount": (0.05, None)})
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query("strip_headers", "SELECT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def strip_headers(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias(" n_nationkey "), F.col("n_name").alias("n_name "))
    trimmed = src.strip_headers(nation)
    return trimmed.join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name")


@query("minority_rows", f"SELECT doc_id, n_chars, quality, lang_code FROM ({TOXIC}) WHERE toxic = 1")
def minority_rows(spark, sf):
    return src.minority_rows(toxic_docs(spark, sf), "toxic", 1)


_LINES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
          "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
          "l_shipdate": "timestamp_ntz"}


@query("content_fingerprint", f"SELECT {signature_sql('lineitem', _LINES)} AS fingerprint")
def content_fingerprint(spark, sf):
    return src.content_fingerprint(spark, f"{sf}/lineitem.parquet")


@query("model_ready", f"SELECT n_chars, quality, lang_code, toxic FROM ({TOXIC})")
def model_ready(spark, sf):
    return gates.model_ready(toxic_docs(spark, sf).select(*TOXIC_FEATS, "toxic"), "toxic")

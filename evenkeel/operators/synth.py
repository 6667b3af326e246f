"""Synthetic minority rows from outside: contract checks, snapping, requests, responses and costs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel.functions.scalars import SEED, draw, is_near_integer, kind_of, missing, nearest_of, to_number
from evenkeel.operators.balance import Plan, append_synthetic, pair_matching_status
from evenkeel.operators.gates import check_columns, columns_with_nulls, numeric_cast_errors, to_numeric
from evenkeel.operators.profile import numeric_stats
from evenkeel.plans.histogram import small_domains
from evenkeel.plans.order import number_rows, prefix_sum
from evenkeel.plans.quota import sample_exact
from evenkeel.sources.tables import strip_headers

ALLOWED_VALUES = 20
DISCRETE_VALUES = 30
MAX_EXAMPLES = 50

# The request texts; their length enters the token estimate.
TASK = "Generate realistic synthetic minority-class tabular credit-risk feature rows."
RULES = [
    "Generate new synthetic observations, not explanations.",
    "Respect each feature's observed range and allowed_values when provided.",
    "Preserve plausible dependencies and correlations among variables.",
    "Do not copy an input row verbatim.",
    "Return exactly the requested number of rows.",
]
SYSTEM_TEXT = (
    "You generate synthetic tabular data for an academic credit-risk "
    "classification experiment. Follow the supplied statistical constraints "
    "and return only data conforming to the schema."
)
CHARS_PER_TOKEN = 4
CALL_INPUT_EXTRA, ROW_OUTPUT_EXTRA, CALL_OUTPUT_EXTRA = 30, 2, 12


# ---- external rows -------------------------------------------------------------------------------

def validate_synthetic(df: DataFrame, feats: Sequence[str], label: str, needed: int) -> tuple[DataFrame, DataFrame]:
    """(clean rows, report). The report has one row per check; later checks stop at the first failure."""
    rows = strip_headers(df)
    rows = rows.drop(label) if label in rows.columns else rows
    lost, extra = check_columns(rows, feats)
    report = [("columns", not lost, ", ".join(lost)), ("extra_columns", True, ", ".join(extra))]
    clean = rows
    if not lost:
        chosen = rows.select(*[F.col(f"`{c}`") for c in feats])
        bad = sorted(r["column"] for r in numeric_cast_errors(chosen, feats).collect())     # at most one row per column
        report.append(("numeric", not bad, ", ".join(bad)))
        clean = to_numeric(chosen, feats)
        if not bad:
            holes = sorted(r["column"] for r in columns_with_nulls(clean).collect())
            report.append(("missing", not holes, ", ".join(holes)))
            if not holes:
                n = clean.count()
                report.append(("rows", n >= needed, f"{n} of {needed}"))
    return clean, df.sparkSession.createDataFrame(report, "check_name string, passed boolean, detail string")


def apply_synthetic(train: DataFrame, synthetic: DataFrame, feats: Sequence[str], label: str, plan: Plan, row_id: str,
                    method: str = "external", seed: int = SEED) -> DataFrame:
    """Take exactly the needed rows, snap them to the minority's domain and append them."""
    if plan.needed <= 0:
        raise ValueError("no synthetic rows are needed")
    chosen = sample_exact(synthetic, plan.needed, row_id, seed).drop(row_id)
    real = train.where(F.col(label) == F.lit(plan.minority_label)).select(*feats)
    return append_synthetic(train, snap_to_domain(chosen, real), label, plan.minority_label,
                            f"{method} (ratio={plan.target_ratio:.2f})")


def minority_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per numeric column with its spread, and its values where there are at most 20."""
    numbers = df.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in cols])
    stats = numeric_stats(numbers, cols)
    values = small_domains(numbers, cols, ALLOWED_VALUES)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for c in cols:
        s = stats[c]
        if s["count"]:
            rows.append((c, kinds[c], s["min"], s["max"], s["mean"], s["std"] if s["std"] is not None else 0.0,
                         s["p25"], s["p50"], s["p75"], values[c]))
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, min double, max double, mean double, std double, q1 double, "
              "median double, q3 double, allowed_values array<double>")


def domain_of(real: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, list[float] | None]]:
    """(low, high, discrete values or None) per column with any value; few whole numbers are discrete."""
    numbers = real.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in cols])
    ends = numbers.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}"))]).first()
    values = small_domains(numbers, cols, DISCRETE_VALUES)
    near = {c: v for c, v in values.items() if v}
    whole = {}
    if near:
        tests = real.sparkSession.range(1).select(*[
            F.forall(F.array(*[F.lit(float(x)) for x in v]), is_near_integer).alias(f"w{i}")
            for i, v in enumerate(near.values())]).first()
        whole = {c: tests[f"w{i}"] for i, c in enumerate(near)}
    return {c: (ends[f"lo{i}"], ends[f"hi{i}"], near[c] if whole.get(c) else None)
            for i, c in enumerate(cols) if ends[f"lo{i}"] is not None}


def snap_columns(df: DataFrame, domain: dict[str, tuple[float, float, list[float] | None]]) -> DataFrame:
    """Clip to the real range and, in a discrete column, move to the nearest real value; NULL stays NULL."""
    out = {}
    for c, (low, high, values) in domain.items():
        if c in df.columns:
            v = to_number(F.col(f"`{c}`"))
            clipped = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))
            out[c] = nearest_of(clipped, values) if values else clipped
    return df.withColumns(out)


def snap_to_domain(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    return snap_columns(synthetic, domain_of(real, [c for c in real.columns if c in synthetic.columns]))


def bootstrap_columns(synthetic: DataFrame, real: DataFrame, cols: Sequence[str], row_id: str,
                      batch: str = "batch_no", row: str = "row_no", seed: int = SEED) -> DataFrame:
    """Fill withheld columns by drawing with replacement from the real values.

    Columns that are equally complete draw from the same row; a column without values becomes 0.0.
    """
    fields = {f.name: f for f in real.schema.fields}
    counts = real.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~missing(fields[c])).alias(c) for c in cols]).first()
    groups: dict[tuple[int, str], list[str]] = {}
    for c in cols:
        n = counts[c]
        groups.setdefault((n, "" if n in (0, counts["_n"]) else c), []).append(c)
    out = synthetic
    for (n, _), members in groups.items():
        if n == 0:
            out = out.withColumns({c: F.lit(0.0) for c in members})
            continue
        source = real.where(~missing(fields[members[0]])).select(F.col(row_id).cast("string").alias("_id"), *members)
        numbered = number_rows(source, "_id", "_pick").drop("_id")
        pick = F.pmod(draw(F.lit(seed) + F.col(batch), row), F.lit(n))
        out = out.withColumn("_pick", pick).join(numbered, "_pick").drop("_pick")   # draws spread evenly over the keys
    return out


def _common_type(a: T.DataType, b: T.DataType) -> str:
    """The type in which two columns are compared without loss, where there is one."""
    if kind_of(b) not in ("numeric", "boolean"):
        return "string"
    if all(isinstance(t, (T.IntegralType, T.BooleanType)) for t in (a, b)):
        return "bigint"
    if all(isinstance(t, (T.IntegralType, T.BooleanType, T.DecimalType)) for t in (a, b)):
        places = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in (a, b))
        if places + whole <= 38:
            return f"decimal({places + whole},{places})"
    return "double"


def _as(c: Column, kind: T.DataType, to: str) -> Column:
    return (c.cast("int") if isinstance(kind, T.BooleanType) and to != "string" else c).cast(to)


def drop_copies(synthetic: DataFrame, train: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Synthetic rows that equal no train row in all features, numbers compared as numbers: whole and decimal numbers
    exactly, as double only where a side is floating.

    The copied feature vectors are found on distinct rows first, so the last join meets a short list.
    """
    common = {c: _common_type(synthetic.schema[c].dataType, train.schema[c].dataType) for c in feats}

    def keyed(df: DataFrame) -> list[Column]:
        return [_as(F.col(f"`{c}`"), df.schema[c].dataType, common[c]).alias(f"_k{i}") for i, c in enumerate(feats)]

    def same(left: DataFrame, right: DataFrame) -> Column:
        cond = F.lit(True)
        for i in range(len(feats)):
            cond = cond & left[f"_k{i}"].eqNullSafe(right[f"_r{i}"])
        return cond

    renamed = [F.col(f"_k{i}").alias(f"_r{i}") for i in range(len(feats))]
    known = train.select(*keyed(train)).distinct().select(*renamed)
    mine = synthetic.select("*", *keyed(synthetic))
    vectors = mine.select(*[f"_k{i}" for i in range(len(feats))]).distinct()
    copied = vectors.join(known, same(vectors, known), "left_semi").select(*renamed)
    return mine.join(copied, same(mine, copied), "left_anti").drop(*[f"_k{i}" for i in range(len(feats))])


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no synthetic rows are left after the checks")
    return df


def finish_generated(train: DataFrame, generated: DataFrame, feats: Sequence[str], label: str, minority,
                     method: str = "generated") -> tuple[DataFrame, DataFrame]:
    """(balanced train rows, 1:1 status): copies of train rows go, none left is an error, the rest is appended."""
    fresh = require_rows(drop_copies(generated.select(*feats), train, feats))
    balanced = append_synthetic(train, fresh, label, minority, method)
    return balanced, pair_matching_status(balanced, label)


# ---- requests ------------------------------------------------------------------------------------

def request_payload(real: DataFrame, excluded: Sequence[str] = (), examples: DataFrame | None = None) -> dict:
    """Profile and optional example rows; excluded columns never enter. Sizes are bounded by the columns."""
    cols = [c for c in real.columns if c not in excluded]
    if not cols:
        raise ValueError("every column is withheld")
    profile = {}
    for r in minority_profile(real, cols).collect():         # one row per column
        info = r.asDict()
        name = info.pop("column")
        if info["allowed_values"] is None:
            info.pop("allowed_values")
        profile[name] = info
    payload = {"task": TASK, "rules": RULES, "minority_feature_profile": profile}
    if examples is not None:
        rows = examples.select(*cols).limit(MAX_EXAMPLES + 1).collect()
        if len(rows) > MAX_EXAMPLES:
            raise ValueError(f"a request holds {MAX_EXAMPLES} example rows at most")
        payload["example_minority_rows"] = [r.asDict() for r in rows]
    return payload


def response_schema(cols: Sequence[str]) -> dict:
    row = {"type": "object", "properties": {c: {"type": "number"} for c in cols}, "required": list(cols),
           "additionalProperties": False}
    return {"type": "object", "properties": {"rows": {"type": "array", "items": row}}, "required": ["rows"],
            "additionalProperties": False}


def example_rows(real: DataFrame, n: int, row_id: str, seed: int = SEED) -> DataFrame:
    """The seeded example rows, used for the estimate and the requests alike."""
    if not 1 <= n <= MAX_EXAMPLES:
        raise ValueError(f"example rows must lie in 1..{MAX_EXAMPLES}")
    return sample_exact(real, min(n, real.count()), row_id, seed).drop(row_id)


def generation_batches(spark: SparkSession, payload: dict, n: int, batch: int, saved: int = 0, last_batch: int = 0) -> DataFrame:
    """(batch_no, n_rows, request) for the rows still to come; numbering continues after a resume."""
    text = json.dumps(payload, ensure_ascii=False, default=str)
    return pending_batches(spark, n, batch, saved, last_batch).withColumn(
        "request", F.concat(F.lit(text[:-1] + ', "number_of_rows": '), F.col("n_rows").cast("string"), F.lit("}")))


def pending_batches(spark: SparkSession, n: int, batch: int, saved: int = 0, last_batch: int = 0) -> DataFrame:
    """(batch_no, n_rows) that bring `saved` rows up to n."""
    if batch < 1:
        raise ValueError("a batch needs at least one row")
    left = max(0, n - saved)
    calls = -(-left // batch)
    return spark.range(calls).select(
        (F.col("id") + last_batch + 1).alias("batch_no"),
        F.least(F.lit(batch), F.lit(left) - F.col("id") * batch).cast("bigint").alias("n_rows"))


def open_batches(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned batches whose number has not finished yet."""
    return planned.join(done.select("batch_no").distinct(), "batch_no", "left_anti")


def first_rows(df: DataFrame, n: int, batch: str = "batch_no", row: str = "row_no") -> DataFrame:
    """The first n rows by (batch, row) without sorting the whole table in one task."""
    from pyspark.sql import Window as W

    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_rows"))
    starts = prefix_sum(sizes, batch, "_rows", before="_start", total="_all").select(batch, "_start")
    # a batch is one response: at most a hundred rows or so
    within = F.row_number().over(W.partitionBy(batch).orderBy(row))
    return (df.join(starts, batch).withColumn("_at", F.col("_start") + within).where(F.col("_at") <= n)
            .drop("_start", "_at"))


# ---- responses -----------------------------------------------------------------------------------

ROWS = "rows array<map<string,string>>"


def _exploded(responses: DataFrame) -> DataFrame:
    parsed = responses.select("batch_no", F.from_json("response", ROWS)["rows"].alias("rows"))
    return parsed.select("batch_no", F.posexplode("rows").alias("row_no", "cells"))


def response_rows(responses: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(batch_no, row_no, columns as double); rows with any missing or non-numeric value are dropped."""
    cells = _exploded(responses)
    return cells.select("batch_no", "row_no", *[to_number(F.try_element_at("cells", F.lit(c))).alias(c) for c in cols]
                        ).dropna("any", subset=list(cols))


def response_report(responses: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(batch_no, n_rows, n_valid, problem) per batch; problem is NULL for a usable batch."""
    parsed = responses.select("batch_no", F.coalesce(F.from_json("response", ROWS)["rows"], F.array().cast(
        "array<map<string,string>>")).alias("rows"))

    def has(c: str):
        return lambda r: F.map_contains_key(r, c)

    seen = [F.exists("rows", has(c)) for c in cols]
    absent = F.array_compact(F.array(*[F.when(~s, F.lit(c)) for s, c in zip(seen, cols)]))

    def whole(r: Column) -> Column:
        ok = F.lit(True)
        for c in cols:
            ok = ok & to_number(F.try_element_at(r, F.lit(c))).isNotNull()
        return ok

    n_valid = F.size(F.filter("rows", whole)).cast("bigint")
    return parsed.select(
        "batch_no", F.size("rows").cast("bigint").alias("n_rows"), n_valid.alias("n_valid"),
        F.when(F.size("rows") == 0, F.lit("no rows"))
        .when(F.size(absent) > 0, F.concat(F.lit("absent column "), F.array_join(absent, ", ")))
        .when(n_valid == 0, F.lit("no valid numeric row")).alias("problem"))


def parse_generated(responses: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Checked rows of all batches; the first unusable batch is an error."""
    bad = response_report(responses, cols).where("problem IS NOT NULL").orderBy("batch_no").limit(1).collect()
    if bad:
        raise ValueError(f"batch {bad[0]['batch_no']}: {bad[0]['problem']}")
    return response_rows(responses, cols)


# ---- costs ---------------------------------------------------------------------------------------

def tokens_of(text: Column) -> Column:
    """A quarter of the characters, rounded up; nothing for empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(float(CHARS_PER_TOKEN))))).cast("bigint")


def generation_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Estimated cost per model of requests (request, n_rows, row_text), under every listed price."""
    tokens = requests.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(tokens_of(F.col("request")) + CALL_INPUT_EXTRA), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.col("n_rows") * (tokens_of(F.col("row_text")) + ROW_OUTPUT_EXTRA) + CALL_OUTPUT_EXTRA),
                   F.lit(0)).alias("output_tokens"))
    # the totals are one row; the price table is the larger side
    return _priced(prices.withColumn("_one", F.lit(1)).join(F.broadcast(tokens.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def _priced(df: DataFrame) -> DataFrame:
    million = 1_000_000.0
    cost_in = F.col("input_tokens") / million * F.col("input_per_million")
    cost_out = F.col("output_tokens") / million * F.col("output_per_million")
    keep = [c for c in ("model_id", "calls", "input_tokens", "output_tokens") if c in df.columns]
    return df.select(*keep, cost_in.alias("input_cost"), cost_out.alias("output_cost"), (cost_in + cost_out).alias("total_cost"))


def estimate_requests(spark: SparkSession, payload: dict, n: int, batch: int) -> DataFrame:
    """The texts a run would send and receive, for generation_cost."""
    cols = list(payload["minority_feature_profile"])
    text = SYSTEM_TEXT + json.dumps(payload, ensure_ascii=False, default=str) + json.dumps(response_schema(cols), ensure_ascii=False)
    row = json.dumps({c: payload["minority_feature_profile"][c]["median"] for c in cols}, ensure_ascii=False)
    return pending_batches(spark, n, batch).select("batch_no", "n_rows", F.lit(text).alias("request"), F.lit(row).alias("row_text"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Actual tokens per model times its price; a model without a price is an error."""
    unknown = usage.select("model_id").distinct().join(prices, "model_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no price for model {unknown[0][0]}")
    sums = usage.groupBy("model_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return _priced(sums.join(prices, "model_id"))


# ---- identity ------------------------------------------------------------------------------------

TWO52 = 4503599627370496.0


def double_text(c: Column) -> Column:
    """A double as <53-bit integer>p<power of two>: exact, and the same text in any engine."""
    power = F.floor(F.log2(F.abs(c)))
    return _double_text(c, power, c / F.pow(F.lit(2.0), power.cast("double")) * TWO52)


def _double_text(c: Column, power: Column, whole: Column) -> Column:
    # a logarithm next to a whole number may be rounded to the other side of it
    power, whole = (F.when(F.abs(whole) >= 9007199254740992.0, power + 1).when(F.abs(whole) < 4503599627370496.0, power - 1).otherwise(power),
                    F.when(F.abs(whole) >= 9007199254740992.0, whole / 2).when(F.abs(whole) < 4503599627370496.0, whole * 2).otherwise(whole))
    return (F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
            .when(c == 0, F.lit("0")).when(c.isNotNull(), F.concat(whole.cast("bigint").cast("string"), F.lit("p"), power.cast("string"))))


def row_text(df: DataFrame) -> Column:
    """All values of a row with their lengths, so that no two different rows read alike."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        s = double_text(c.cast("double")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        parts.append(_sized(s))
    return F.concat(*parts)


def _sized(s: Column) -> Column:
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _staged_text(df: DataFrame) -> DataFrame:
    """One column `text`: `row_text` of each row, in projections of their own, so that what a later one reads several times
    is worked out once a row."""
    fields = df.schema.fields
    doubles = [i for i, f in enumerate(fields) if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    step = df.select(*[F.col(f"`{f.name}`").cast("double" if i in doubles else "string").alias(f"v{i}") for i, f in enumerate(fields)])
    if doubles:
        x = {i: F.col(f"v{i}") for i in doubles}
        plain = {i: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c != 0) for i, c in x.items()}
        step = step.select("*", *[F.when(plain[i], F.floor(F.log2(F.abs(x[i])))).alias(f"p{i}") for i in doubles])
        step = step.select("*", *[(x[i] / F.pow(F.lit(2.0), F.col(f"p{i}").cast("double")) * TWO52).alias(f"w{i}") for i in doubles])
        texts = {i: _double_text(x[i], F.col(f"p{i}"), F.col(f"w{i}")) for i in doubles}
        step = step.select(*[texts.get(i, F.col(f"v{i}")).alias(f"v{i}") for i in range(len(fields))])
    return step.select(F.concat(*[_sized(F.col(f"v{i}")) for i in range(len(fields))]).alias("text"))


def dataset_signature(df: DataFrame) -> DataFrame:
    """One row: a hash of content and schema that does not depend on row order or partitioning."""
    rows = _staged_text(df).select(draw(0, "text").alias("u"))
    schema = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    # the 60 bits are added up in three parts, each in a bigint
    parts = [F.coalesce(F.sum(F.shiftright("u", at).bitwiseAND((1 << 20) - 1)), F.lit(0)).cast("decimal(38,0)").alias(f"s{at}") for at in (0, 20, 40)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *parts, F.coalesce(F.bit_xor("u"), F.lit(0)).cast("string").alias("x"))
    total = (F.col("s40") * (1 << 40) + F.col("s20") * (1 << 20) + F.col("s0")).cast("decimal(38,0)").cast("string")
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), total, "x", F.lit(schema)), 256).alias("signature"))


def job_id(df: DataFrame, settings: dict) -> tuple[str, dict]:
    """24 hex digits over the sorted settings and the data, and the settings as recorded."""
    payload = {"data_signature": dataset_signature(df).first()[0], "columns": list(df.columns), **settings}
    if "excluded_cols" in payload:
        payload["excluded_cols"] = sorted(payload["excluded_cols"] or [])
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:24], payload

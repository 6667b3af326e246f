"""Scans, sinks, checkpoints, the stream and the registered queries."""

import json

import pytest
from pyspark.sql import functions as F

from evenkeel.plans.recipe import Workspace
from evenkeel.sources import generated as gen, tables as src
from evenkeel.streaming.ingest import ingest_generated_stream, packed_rows, report_generated_stream, taken_rows


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿i,x,s,flag,none\n1,1.5,a,True,\n,NA,,False,NA\n3,nan,5d,True,null\n", encoding="utf-8")
    df = src.read_table(spark, str(tmp_path / "t.csv"), "csv")
    assert dict(df.dtypes) == {"i": "bigint", "x": "double", "s": "string", "flag": "boolean", "none": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "a", True, None), (None, None, None, False, None), (3, None, "5d", True, None)]


def test_ranges_of_doubles_reach_the_reader(spark, tmp_path):
    nan = float("nan")
    rows = [(float(k), k, f"s{k}") for k in range(20)] + [(nan, 20, "nan"), (None, 21, None), (float("inf"), None, "inf"), (-0.0, 23, "zero")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "x double, i int, s string").coalesce(1).write.parquet(path)

    def kept(**ranges):
        return {r["s"] for r in src.read_table(spark, path, ranges=ranges).collect()}

    assert kept(x=(5.0, 7.0)) == {"s5", "s6", "s7"}
    assert kept(x=(18.0, None)) == {"s18", "s19", "inf"}                    # NaN compares above all numbers, but is missing
    assert kept(x=(None, 1.0)) == {"s0", "s1", "zero"}
    assert kept(x=(None, None)) == {f"s{k}" for k in range(20)} | {"inf", "zero"}
    assert kept(x=(0.0, 3.0), i=(2, None)) == {"s2", "s3", "zero"} and kept(x=(9.0, 8.0)) == set()
    assert kept(s=("s18", "s2")) == {"s18", "s19", "s2"}
    plain = src.nan_to_null(spark.read.parquet(path)).where("x >= 18")
    assert {r["s"] for r in plain.collect()} == kept(x=(18.0, None))
    numbered = src.read_table(spark, path, row_id="row_id", ranges={"x": (5.0, 7.0)})
    everything = {r["s"]: r["row_id"] for r in src.read_table(spark, path, row_id="row_id").collect()}
    assert {r["s"]: r["row_id"] for r in numbered.collect()} == {s: everything[s] for s in ("s5", "s6", "s7")}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "GreaterThanOrEqual(x,5.0)" in pushed and "LessThanOrEqual(x,7.0)" in pushed


def test_round_trip_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"q')], "i long, s string")
    src.write_csv(df, str(tmp_path / "one"))
    assert {tuple(r) for r in src.read_table(spark, str(tmp_path / "one"), "csv").collect()} == {(1, "a,b"), (2, 'q"q')}
    work = Workspace(spark)
    first = work.load(str(tmp_path / "one"))
    first.apply("x", lambda d: d.limit(1))
    assert work.load(str(tmp_path / "one")) is first
    src.write_csv(df.limit(1), str(tmp_path / "two"))
    assert work.load(str(tmp_path / "two")) is not first and work.recipe.actions == []


def test_scan_normalises_nan_and_numbers_rows(spark, tmp_path):
    spark.createDataFrame([(float(i) if i % 2 else float("nan"),) for i in range(10)], "x double").repartition(3).write.parquet(str(tmp_path / "p"))
    df = src.read_table(spark, str(tmp_path / "p"), row_id="row_id")
    assert df.where("x IS NULL").count() == 5 and df.select("row_id").distinct().count() == 10


def test_preview_limits(spark):
    assert [r["id"] for r in src.preview(spark.range(50), 3, "id").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        src.preview(spark.range(5), 101)


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "g")
    rows = spark.range(20).select((F.col("id") / 5).cast("long").alias("batch_no"), (F.col("id") % 5).alias("row_no"), F.col("id").cast("double").alias("v"))
    assert gen.read_generated(spark, path, "j") is None
    gen.write_generated(rows.where("batch_no < 2"), path, "j", {"batch_size": 5})
    gen.write_generated(rows.where("batch_no = 1"), path, "j", {"batch_size": 5})
    gen.write_generated(rows, path, "other", {})
    back, meta = gen.read_generated(spark, path, "j")
    assert back.count() == 10 and (meta["generated_rows"], meta["batch_size"], meta["status"]) == (10, 5, "in_progress")
    gen.drop_generated(spark, path, "j")
    assert gen.read_generated(spark, path, "j") is None and gen.read_generated(spark, path, "other")[0].count() == 20
    gen.write_generated(rows.where("batch_no = 3"), path, "j", {}, "completed")
    assert gen.read_generated(spark, path, "j")[0].count() == 5
    real = spark.createDataFrame([(2.5,), (7.5,)], "v double")
    kept = gen.validate_checkpoint(rows, {"job_id": "j"}, "j", ["v"], real, 7).orderBy("batch_no", "row_no")
    assert [r["v"] for r in kept.collect()] == [2.5, 2.5, 2.5, 3.0, 4.0, 5.0, 6.0]
    for bad in ((None, {}, "j", ["v"]), (rows, {"job_id": "k"}, "j", ["v"]), (rows, {"job_id": "j"}, "j", ["w"])):
        with pytest.raises(ValueError):
            gen.validate_checkpoint(*bad)


def test_stream_resumes(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def arrive(name, batches):
        lines = [json.dumps({"batch_no": b, "response": json.dumps({"rows": [{"a": b * 10 + i, "b": "x" if i == 2 else i} for i in range(4)]})}) for b in batches]
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))

    real = spark.createDataFrame([(0.0,), (25.0,)], "a double")
    for name, batches in (("one", [1, 2]), ("two", [2, 3])):      # batch 2 arrives twice
        arrive(name, batches)
        ingest_generated_stream(spark, inbox, ["a", "b"], out, state, real, 1).awaitTermination()
    got = sorted((r["batch_no"], r["row_no"], r["a"]) for r in spark.read.parquet(out).collect())
    assert got == [(b, i, 25.0 if b == 3 else (0.0 if b * 10 + i < 12.5 else 25.0)) for b in (1, 2, 3) for i in (0, 1, 3)]


@pytest.mark.parametrize("files", [["bad", "good"], ["bad good"]])
def test_a_bad_response_leaves_its_batch_to_the_retry(spark, tmp_path, files):
    inbox, out, state, report, marks = (str(tmp_path / x) for x in ("in", "out", "state", "report", "marks"))
    (tmp_path / "in").mkdir()
    rows = lambda *a: json.dumps({"rows": [{"a": x} for x in a]})
    texts = {"bad": {1: '{"rows": [{"a": 1', 2: rows(), 3: json.dumps({"rows": [{"b": 1}]}), 4: rows(7, 8), 5: rows(1, 2)},
             "good": {1: rows(1, 2), 2: rows(3), 3: rows(4), 4: rows(7, 8, 9), 5: rows(1, 2)}}
    for k, names in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(
            json.dumps({"batch_no": b, "response": r}) for name in names.split() for b, r in texts[name].items()))
        ingest_generated_stream(spark, inbox, ["a"], out, state, None, 1).awaitTermination()
        report_generated_stream(spark, inbox, ["a"], report, marks, 1).awaitTermination()
    got = sorted((r["batch_no"], r["row_no"], r["a"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 3), (3, 0, 4), (4, 0, 7), (4, 1, 8), (4, 2, 9), (5, 0, 1), (5, 1, 2)]
    told = sorted((r["batch_no"], r["problem"]) for r in spark.read.parquet(report).collect())
    assert told == [(1, "no rows"), (2, "no rows"), (3, "absent column a"), (4, "differs from another text")]


def _entries(spark, state):
    """(batch_no, upto, bytes above) of the intake's state, as the store holds it."""
    rows = spark.read.format("statestore").load(state).selectExpr("key.batch_no", "value.groupState.*").collect()
    return {r["batch_no"]: (r["upto"], len(r["above"])) for r in rows}


def test_the_state_of_a_batch_is_one_entry_that_does_not_grow(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    rows = lambda cells: json.dumps({"rows": [{"a": x} for x in cells]})
    whole, holes = rows(range(1000)), rows(x if x % 10 else "n/k" for x in range(1000))
    seen = []
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(
            json.dumps({"batch_no": b, "response": r}) for b, r in ((1, whole), (2, holes), (None, rows([5])))))
        ingest_generated_stream(spark, inbox, ["a"], out, state, None, 1, keep_seconds=3600).awaitTermination()
        seen.append(_entries(spark, state))
    assert seen[0] == seen[1] == seen[2] == {1: (1000, 0), 2: (0, 125), None: (1, 0)}
    got = {r["batch_no"]: r["count"] for r in spark.read.parquet(out).groupBy("batch_no").count().collect()}
    assert got == {1: 1000, 2: 900, None: 1}
    (tmp_path / "in" / "last.json").write_text(json.dumps({"batch_no": 2, "response": whole}))      # the retry fills the holes
    ingest_generated_stream(spark, inbox, ["a"], out, state, None, 1, keep_seconds=3600).awaitTermination()
    assert _entries(spark, state)[2] == (1000, 0)
    assert sorted(r["row_no"] for r in spark.read.parquet(out).where("batch_no = 2").collect()) == list(range(1000))


def test_entries_of_quiet_batches_go(spark, tmp_path):
    inbox, out, state, report, marks = (str(tmp_path / x) for x in ("in", "out", "state", "report", "marks"))
    (tmp_path / "in").mkdir()
    for b in (1, 2, 3):
        (tmp_path / "in" / f"{b}.json").write_text("\n".join(
            json.dumps({"batch_no": b, "response": r}) for r in ('{"rows": [{"a": 1}]}', '{"rows": []}')))
        ingest_generated_stream(spark, inbox, ["a"], out, state, None, 1, keep_seconds=0.001).awaitTermination()
        report_generated_stream(spark, inbox, ["a"], report, marks, 1, keep_seconds=0.001).awaitTermination()
    assert set(_entries(spark, state)) <= {3} and spark.read.format("statestore").load(marks).count() <= 1
    assert sorted(r["batch_no"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert sorted(r["batch_no"] for r in spark.read.parquet(report).collect()) == [1, 2, 3]


def test_packed_rows_round_trip():
    import numpy as np

    for taken in ([], [0], [1], [1, 1, 0, 1], [0] * 9 + [1], [1] * 20, [1] * 20 + [0, 0, 1, 0]):
        upto, above = packed_rows(np.array(taken, bool))
        assert list(np.flatnonzero(taken_rows(upto, above))) == list(np.flatnonzero(taken))


def test_registered_queries_match_their_sql(spark, sf):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from check import TABLES, compare

    assert set(oracle_sql()) <= set(queries())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    quick = ["shape_summary", "describe_all", "box_stats", "group_median", "corr_kendall", "impute_auto", "one_hot", "mutual_info_knn",
             "sample_stratified", "balance_report", "minority_profile", "parse_generated", "validate_checkpoint", "metrics", "roc_curve"]
    for name in quick:
        text, ok = compare(spark, con, name, queries()[name], oracle_sql().get(name), sf)
        assert ok, f"{name}: {text}"


def test_entry(spark, sf):
    from __spark_entry__ import entry

    row = entry(spark).first()
    assert row["model"] == "Logistic Regression" and 0 <= row["roc_auc"] <= 1


def test_csv_with_quotes_and_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('t,n\n"x ""y"" z",1\n"line1\nline2",2\n plain ,3\n')
    from evenkeel.sources.tables import read_table

    got = read_table(spark, str(path), "csv").orderBy("n").collect()
    assert [(r["t"], r["n"]) for r in got] == [('x "y" z', 1), ("line1\nline2", 2), (" plain ", 3)]


def test_csv_round_trip_of_awkward_texts(spark, tmp_path):
    from evenkeel.sources.tables import read_table, write_csv

    texts = ['a "b" c', '"', 'x\ny', ' lead', 'trail ', 'c,d', '\\', 'back\\"slash', "é\n\n\"q\""]
    write_csv(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), str(tmp_path / "out"))
    got = read_table(spark, str(tmp_path / "out"), "csv").orderBy("n").collect()
    assert [r["t"] for r in got] == texts


def test_row_ids_of_equal_file_names_in_two_folders_differ(spark, tmp_path):
    from evenkeel.sources.tables import read_table

    for p in ("a", "b"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t" / f"part={p}"))
        written = next((tmp_path / "t" / f"part={p}").glob("part-*.parquet"))
        (tmp_path / "t" / f"part={p}" / "data_0.parquet").write_bytes(written.read_bytes())
        written.unlink()
        for crc in (tmp_path / "t" / f"part={p}").glob(".*.crc"):
            crc.unlink()
    ids = [r["row_id"] for r in read_table(spark, str(tmp_path / "t"), row_id="row_id").collect()]
    assert len(set(ids)) == 6 and "part=a/data_0.parquet#0" in ids
    one = read_table(spark, str(tmp_path / "t" / "part=a" / "data_0.parquet"), row_id="row_id").collect()
    assert {r["row_id"] for r in one} == {f"data_0.parquet#{k}" for k in range(3)}


def test_row_ids_from_keys_with_nulls_and_separators_differ(spark):
    from evenkeel.plans.keys import add_row_id

    rows = [(1, None, 2), (1, 2, None), (None, 1, 2)]
    assert add_row_id(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"]).select("row_id").distinct().count() == 3
    texts = [("a|b", "c"), ("a", "b|c"), ("1:a", "-"), ("1:a", None)]
    assert add_row_id(spark.createDataFrame(texts, "a string, b string"), ["a", "b"]).select("row_id").distinct().count() == 4


def test_fingerprint_follows_content_only(spark, tmp_path):
    from evenkeel.sources.tables import content_fingerprint

    rows = spark.createDataFrame([(k, k / 7, None if k % 3 else "x") for k in range(50)], "a long, d double, t string")
    rows.repartition(5).write.parquet(str(tmp_path / "one"))
    rows.coalesce(1).write.parquet(str(tmp_path / "two"))
    rows.where("a < 49").union(spark.createDataFrame([(49, 7.000000000000001, "x")], rows.schema)).write.parquet(str(tmp_path / "three"))
    marks = [content_fingerprint(spark, str(tmp_path / p)).first()[0] for p in ("one", "two", "three")]
    assert marks[0] == marks[1] != marks[2]


def test_double_text_is_exact(spark):
    import math

    from pyspark.sql import functions as F

    from evenkeel.operators.synth import double_text

    values = [0.1, -0.1, 1.0, 2.0 ** 52, 2.0 ** 53 - 1, 1e308, 5e-324, 3.0, 1 / 3, 4503599627370495.5, 0.0, math.nan, math.inf, -math.inf, None]
    for v, t in spark.createDataFrame([(v,) for v in values], "v double").select("v", double_text(F.col("v"))).collect():
        if v is None or math.isnan(v) or math.isinf(v) or v == 0:
            assert t == {None: None, math.inf: "inf", -math.inf: "-inf", 0.0: "0"}.get(v, "nan")
        else:
            whole, power = t.split("p")
            assert 2 ** 52 <= abs(int(whole)) < 2 ** 53 and math.ldexp(int(whole), int(power) - 52) == v


def test_a_signature_works_out_each_text_once_a_row(spark):
    """The logarithm of a double and the mark of a row stand once each in the plan."""
    from evenkeel.operators.synth import dataset_signature, draw, row_text

    values = [1.0, -0.5, 0.1, 1e-310, 1.7e308, 0.0, float("nan"), float("inf"), float("-inf"), None, 3.0, 3.0]
    df = spark.createDataFrame([(v, i, None if i % 3 == 0 else "a|b") for i, v in enumerate(values)], "v double, k long, s string")
    plan = dataset_signature(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("log2(") == 1 and plan.count("md5(") == 1
    u = [r[0] for r in df.select(draw(0, row_text(df))).collect()]
    x = 0
    for one in u:
        x ^= one
    import hashlib

    want = hashlib.sha256(f"{len(u)}|{sum(u)}|{x}|v:double|k:bigint|s:string".encode()).hexdigest()
    assert dataset_signature(df).first()[0] == want
    assert dataset_signature(df.limit(0)).first()[0] == hashlib.sha256(b"0|0|0|v:double|k:bigint|s:string").hexdigest()

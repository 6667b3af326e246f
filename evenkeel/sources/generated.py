"""Checkpoints of generated rows: Parquet by job and run, with JSON metadata as the commit mark of every write."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

META = ("job_id string, run_id string, seq long, write_id string, status string, generated_rows long, updated_at double, "
        "details string")


def _meta_rows(spark: SparkSession, path: str, job: str) -> DataFrame | None:
    try:
        return spark.read.schema(META).json(f"{path}/meta").where(F.col("job_id") == job)
    except AnalysisException:
        return None


def _latest(spark: SparkSession, path: str, job: str) -> dict | None:
    """The last mark of a job by its number; no clock decides."""
    rows = _meta_rows(spark, path, job)
    last = rows.orderBy(F.desc("seq"), "write_id").limit(1).collect() if rows is not None else []
    return last[0].asDict() if last else None


def _mark(spark: SparkSession, path: str, job: str, run: str, seq: int, write: str, status: str, rows: int, details: dict) -> None:
    row = [(job, run, seq, write, status, rows, time.time(), json.dumps(details, ensure_ascii=False, default=str))]
    spark.createDataFrame(row, META).coalesce(1).write.mode("append").json(f"{path}/meta")


COUNTS = "batch_no long, n long, job_id string, run_id string, write_id string"


def write_generated(df: DataFrame, path: str, job: str, meta: dict, status: str = "in_progress") -> None:
    """Save the batches in `df` (batch_no, row_no, columns); writing a batch again replaces it.

    Rows are appended under the run and the write, whatever their batch; then the write's own rows are counted by
    batch, from its own files alone; the metadata row that names the write and carries the run's total goes last, so
    readers never see half a write. Of several writes of a batch the last one counts. A write costs its own rows and one
    number for each batch written before, never the rows of the run.
    """
    spark = df.sparkSession
    last = _latest(spark, path, job)
    run = last["run_id"] if last and last["status"] != "dropped" else uuid.uuid4().hex
    seq, write = (last["seq"] + 1 if last else 1), uuid.uuid4().hex
    tagged = df.withColumns({"job_id": F.lit(job), "run_id": F.lit(run), "write_id": F.lit(write)})
    tagged.write.mode("append").partitionBy("job_id", "run_id", "write_id").parquet(f"{path}/rows")
    own = _of_run(spark, f"{path}/rows", job, run).where(F.col("write_id") == write)
    counts = own.groupBy(F.col("batch_no").cast("long").alias("batch_no")).agg(F.count(F.lit(1)).alias("n"))
    counts.withColumns({"job_id": F.lit(job), "run_id": F.lit(run), "write_id": F.lit(write)}).write.mode("append").partitionBy(
        "job_id", "run_id").parquet(f"{path}/counts")
    _mark(spark, path, job, run, seq, write, status, _total(spark, path, job, run, write, seq), meta)


def _of_run(spark: SparkSession, path: str, job: str, run: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("partitionColumnTypeInference.enabled", "false")
    found = (reader.schema(schema) if schema else reader).parquet(path)
    return found.where((F.col("job_id").cast("string") == job) & (F.col("run_id").cast("string") == run))


def _total(spark: SparkSession, path: str, job: str, run: str, write: str, seq: int) -> int:
    """Rows of the run: of every batch the count of its last write that is marked, or is this one."""
    counts = _of_run(spark, f"{path}/counts", job, run, COUNTS)
    marked = _writes(spark, path, job, run)
    this = spark.createDataFrame([(write, seq)], "write_id string, _seq long")
    known = counts.join(this if marked is None else marked.unionByName(this), "write_id")
    last = known.groupBy("batch_no").agg(F.max_by("n", "_seq").alias("n"))
    return last.agg(F.sum("n")).first()[0] or 0


def _writes(spark: SparkSession, path: str, job: str, run: str) -> DataFrame | None:
    """(write_id, _seq) of the run's finished writes."""
    marks = _meta_rows(spark, path, job)
    if marks is None:
        return None
    return marks.where((F.col("run_id") == run) & (F.col("write_id") != "")).select("write_id", F.col("seq").alias("_seq"))


def _rows(spark: SparkSession, path: str, job: str, run: str) -> DataFrame:
    """The rows of a run: of every batch those of its last finished write."""
    mine, writes = _of_run(spark, f"{path}/rows", job, run), _writes(spark, path, job, run)
    known = mine.join(writes, "write_id").withColumn("batch_no", F.col("batch_no").cast("bigint"))
    last = known.groupBy("batch_no").agg(F.max("_seq").alias("_seq"))
    return known.join(last, ["batch_no", "_seq"]).drop("job_id", "run_id", "write_id", "_seq")


def read_generated(spark: SparkSession, path: str, job: str) -> tuple[DataFrame, dict] | None:
    """(rows, metadata) of the job's current run, or None where nothing usable is saved."""
    last = _latest(spark, path, job)
    if last is None or last["status"] == "dropped":
        return None
    try:
        rows = _rows(spark, path, job, last["run_id"])
    except AnalysisException:
        return None
    meta = {**json.loads(last["details"]), **{k: last[k] for k in ("job_id", "status", "generated_rows", "updated_at")}}
    return rows, meta


def drop_generated(spark: SparkSession, path: str, job: str) -> None:
    """Start fresh: a tombstone ends the current run; no file is deleted."""
    last = _latest(spark, path, job)
    if last is not None:
        _mark(spark, path, job, last["run_id"], last["seq"] + 1, "", "dropped", 0, {})


def validate_checkpoint(rows: DataFrame | None, meta: dict | None, job: str, cols: Sequence[str],
                        real: DataFrame | None = None, target_rows: int | None = None) -> DataFrame:
    """Check an imported checkpoint, then project, snap and cap it."""
    from evenkeel.operators.synth import first_rows, snap_to_domain

    if rows is None or meta is None:
        raise ValueError("the checkpoint lacks its rows or its metadata")
    if meta.get("job_id") != job:
        raise ValueError("the checkpoint belongs to other data or settings")
    lost = [c for c in cols if c not in rows.columns]
    if lost:
        raise ValueError(f"the checkpoint lacks columns: {lost}")
    order = [c for c in ("batch_no", "row_no") if c in rows.columns]
    out = rows.select(*order, *[F.col(f"`{c}`") for c in cols])
    if real is not None:
        out = snap_to_domain(out, real)
    if target_rows is not None:
        if len(order) < 2:
            raise ValueError("a checkpoint that is to be cut to its target rows needs batch_no and row_no")
        out = first_rows(out, target_rows)
    return out


def resume_generation(spark: SparkSession, path: str, job: str, responses: DataFrame, cols: Sequence[str], target_rows: int,
                      batch: int, real: DataFrame, withheld: Sequence[str] = (), row_id: str | None = None,
                      usage: dict | None = None) -> tuple[DataFrame, dict]:
    """Go on where a run stopped: (all rows now saved, report).

    Saved rows, token totals and the last batch come from the latest checkpoint; the batches still wanted are numbered
    on from there, their responses are parsed (an unusable one is an error), withheld columns are drawn from `real`,
    values are snapped to it, the whole is cut to target_rows and written as a checkpoint of its own. Without a
    checkpoint the run starts at batch 1; with enough rows saved nothing is added.
    """
    from evenkeel.operators.synth import bootstrap_columns, first_rows, parse_generated, pending_batches, snap_to_domain

    found = read_generated(spark, path, job)
    rows, meta = found if found else (None, {})
    saved = meta.get("generated_rows", 0)
    done = rows.agg(F.max("batch_no")).first()[0] or 0 if rows is not None else 0
    wanted = pending_batches(spark, target_rows, batch, saved, done)
    fresh = parse_generated(responses.join(wanted.select("batch_no"), "batch_no"), cols)
    if withheld:
        fresh = bootstrap_columns(fresh, real, withheld, row_id)
    fresh = snap_to_domain(fresh, real)
    tokens = {k: meta.get(k, 0) + (usage or {}).get(k, 0) for k in ("input_tokens", "output_tokens")}
    write_generated(first_rows(fresh, max(0, target_rows - saved)), path, job, tokens)
    out, meta = read_generated(spark, path, job)
    last = out.agg(F.max("batch_no")).first()[0] or 0
    status = "completed" if meta["generated_rows"] >= target_rows else "in_progress"
    return out, {"saved_before": saved, "rows": meta["generated_rows"], "last_batch": last, "status": status, **tokens}

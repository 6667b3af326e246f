"""Continuous intake of generated responses with exactly-once resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.synth import domain_of, response_report, response_rows, snap_columns

RESPONSE_SCHEMA = "batch_no long, response string"
REPORT = "batch_no long, n_rows long, n_valid long, problem string"
DIFFERS = "differs from another text"


def response_stream(spark: SparkSession, path: str, cols: Sequence[str], domain: dict | None = None,
                    files_per_trigger: int = 1_000, keep_seconds: float | None = None) -> DataFrame:
    """Rows of new response files, parsed, snapped and each (batch_no, row_no) taken once.

    Only valid rows use up their number: a retry after an unusable or shorter response gives the rows still missing.
    Of differing texts of a batch each row comes from the first that arrives, any of those in one micro-batch; the
    report names such batches. The state is one entry a batch: up to which row all are taken, and a bit for each row
    above; what arrives again leaves it as it is. With `keep_seconds` the entry goes once nothing of its batch has arrived
    for so long, and what arrives later counts as new; without, entries stay.
    """
    rows = response_rows(_arrivals(spark, path, files_per_trigger), cols)
    kept = rows.groupBy("batch_no").applyInPandasWithState(
        _rows_once(keep_seconds), rows.schema, "upto long, above binary", "append", _timeout(keep_seconds))
    return snap_columns(kept, domain) if domain else kept


def _work_through(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that ends with what has arrived. Entries are timed out in micro-batches with data only: those without
    would go on for ever, since a later time may always time out more."""
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    old = conf.get(name)
    conf.set(name, "false")                               # the query keeps the settings that it is started with
    try:
        return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(name, old)


def _timeout(keep_seconds: float | None) -> str:
    return "NoTimeout" if keep_seconds is None else "ProcessingTimeTimeout"


def taken_rows(upto: int, above: bytes) -> np.ndarray:
    """One flag a row number from an entry of the state: all below `upto`, then the bits of `above`."""
    return np.concatenate([np.ones(upto, bool), np.unpackbits(np.frombuffer(above, np.uint8)).astype(bool)])


def packed_rows(taken: np.ndarray) -> tuple[int, bytes]:
    gaps, last = np.flatnonzero(~taken), np.flatnonzero(taken)
    upto = int(gaps[0]) if len(gaps) else len(taken)
    return upto, np.packbits(taken[upto:last[-1] + 1]).tobytes() if len(last) else b""


def _rows_once(keep_seconds: float | None) -> Callable:
    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = taken_rows(*state.get) if state.exists else np.zeros(0, bool)
        for part in parts:
            part = part.drop_duplicates("row_no")
            at = part["row_no"].to_numpy()
            if len(at) and at.max() >= len(taken):
                taken = np.concatenate([taken, np.zeros(at.max() + 1 - len(taken), bool)])
            fresh = ~taken[at]
            taken[at] = True
            if fresh.any():
                yield part[fresh]
        state.update(packed_rows(taken))
        if keep_seconds is not None:
            state.setTimeoutDuration(max(1, int(keep_seconds * 1_000)))

    return run


def _arrivals(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _report_once(keep_seconds: float | None) -> Callable:
    """A batch's unusable texts, and usable ones that differ from its first usable one, each text once."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, seen = state.get if state.exists else (None, "")
        seen, out = set(seen.split()), []
        for text, n_rows, n_valid, problem in sorted(
                pd.concat(parts)[["text", "n_rows", "n_valid", "problem"]].itertuples(index=False), key=lambda r: r[0]):
            if text in seen:
                continue
            seen.add(text)
            if pd.isna(problem):
                first = first or text
                problem = None if text == first else DIFFERS
            if problem is not None:
                out.append((key[0], n_rows, n_valid, problem))
        state.update((first, " ".join(sorted(seen))))
        if keep_seconds is not None:
            state.setTimeoutDuration(max(1, int(keep_seconds * 1_000)))
        if out:
            yield pd.DataFrame(out, columns=["batch_no", "n_rows", "n_valid", "problem"])

    return run


def report_generated_stream(spark: SparkSession, path: str, cols: Sequence[str], out: str, checkpoint: str,
                            files_per_trigger: int = 1_000, keep_seconds: float | None = None) -> StreamingQuery:
    """A second sink for what the intake cannot use: one row (batch_no, n_rows, n_valid, problem) for every response
    that is malformed, empty, lacks a column, has no valid row or differs from an earlier usable one of its batch. It
    keeps a checkpoint of its own and stops when it has worked through what has arrived; a response that arrives twice
    is reported once for each different text. The state holds a hash of each different text of a batch, until nothing of
    the batch has arrived for `keep_seconds`."""
    text = F.sha2(F.coalesce("response", F.lit("")), 256).alias("text")
    raw = _arrivals(spark, path, files_per_trigger).select(F.struct("batch_no", text).alias("batch_no"), "response")
    told = response_report(raw, cols).select("batch_no.*", "n_rows", "n_valid", "problem").groupBy("batch_no").applyInPandasWithState(
        _report_once(keep_seconds), REPORT, "first string, seen string", "append", _timeout(keep_seconds))
    return _work_through(told, out, checkpoint)


def ingest_generated_stream(spark: SparkSession, path: str, cols: Sequence[str], out: str, checkpoint: str,
                            real: DataFrame | None = None, files_per_trigger: int = 1_000,
                            keep_seconds: float | None = None) -> StreamingQuery:
    """Work through what has arrived and stop; a restart with the same checkpoint goes on from there."""
    domain = domain_of(real, [c for c in cols if c in real.columns]) if real is not None else None
    return _work_through(response_stream(spark, path, cols, domain, files_per_trigger, keep_seconds), out, checkpoint)

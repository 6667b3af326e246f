"""CSV records with line breaks inside quotes, found in the splits of a file.

Whether a line begins inside quotes depends on everything before it. A line is therefore a map of the two states
(outside, inside) at its begin to the state at its end; the maps of a split's lines compose to one map a split, and a
prefix over the splits of a file gives each the state it begins in. Texts stay in the task that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# a quoted value up to its end or the line's; a value that does not begin with a quote keeps its quotes as they are
_QUOTED = r'(?:[^"]++|"")*+'
_VALUES = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = re.compile(rf'{_VALUES}"{_QUOTED}\Z')
_STAYS = re.compile(rf'{_QUOTED}\Z')
_CLOSES = re.compile(rf'{_QUOTED}"[^,]*+(?:,|\Z)')

SPLITS = "file string, block long, from_outside boolean, from_inside boolean, begins_inside boolean"
PARTS = "file string, owner long, block long, head boolean, value string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at a line's end, by its state at the begin."""
    if not inside:
        return _OPENS.match(line) is not None
    if _STAYS.match(line):
        return True
    rest = _CLOSES.match(line).end()
    return _OPENS.match(line, rest) is not None


def _pieces(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.Array]]:
    """The lines of one split that stand in one batch, with the values of `names`, in the order of the file."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(files) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield tuple(batch.column(c)[int(a)].as_py() for c in names), batch.column("value").slice(a, b - a)


def _quoted_lines(lines: pa.Array) -> Iterator[tuple[int, str]]:
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    return zip(at.tolist(), lines.take(pa.array(at)).to_pylist())


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each split, and whether a record begins in it where the split begins inside a value."""
    key, outside, inside, begins = None, False, True, False

    def told():
        return pa.RecordBatch.from_pylist([dict(file=key[0], block=key[1], from_outside=outside, from_inside=inside,
                                                begins_inside=begins)], schema=told.schema)

    told.schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()),
                             ("from_inside", pa.bool_()), ("begins_inside", pa.bool_())])
    for found, lines in _pieces(batches, "file", "block"):
        if found != key:
            if key is not None:
                yield told()
            key, outside, inside, begins = found, False, True, False
        begins = begins or not inside
        for at, line in _quoted_lines(lines):
            same = outside == inside
            outside = ends_inside(line, outside)
            inside = outside if same else ends_inside(line, inside)
            begins = begins or (not inside and at + 1 < len(lines))
    if key is not None:
        yield told()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (owner NULL), and the parts of those that cross splits, which name the split they begin in.

    A file's first record, its header, is left out or marked."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("head", pa.bool_()),
                        ("value", pa.string())])
    key, inside, owner, head, headed, held = None, False, None, False, True, []

    def rest():
        part = dict(file=key[0], owner=owner, block=key[1], head=head, value="\n".join(held))
        return pa.RecordBatch.from_pylist([part], schema=schema)

    for found, lines in _pieces(batches, "file", "block", "inside", "owner"):
        if found[:2] != key:
            if held:
                yield rest()
            key, inside, owner, head, held = found[:2], found[2], found[3], False, []
            headed = key[1] != 0                                   # only a file's first split holds its header
        n, parts = len(lines), []
        before = np.zeros(n + 1, bool)
        at, state = 0, inside
        for i, line in _quoted_lines(lines):
            before[at:i + 1] = state
            state, at = ends_inside(line, state), i + 1
        before[at:] = state
        single = ~before[:-1] & ~before[1:]
        first = -1
        if not headed:
            filled = np.flatnonzero(~np.isin(lines.to_numpy(zero_copy_only=False), ["", "\r"]))
            if len(filled):
                first, headed = int(filled[0]), True
                single[first] = False                              # a header of one line ends here
        many = np.flatnonzero(before[:-1] | before[1:])
        for i, line in zip(many.tolist(), lines.take(pa.array(many)).to_pylist()):
            if not before[i]:                                      # a record of several lines begins
                held, owner, head = [], key[1], i == first
            held.append(line)
            if not before[i + 1]:
                if owner != key[1]:                                # it began in an earlier split
                    yield rest()
                elif not head:
                    parts.append("\n".join(held))
                held = []
        inside = state
        whole = lines.filter(pa.array(single)).cast(pa.string())
        for texts in (whole, pa.array(parts, pa.string())):
            if len(texts):
                none = pa.nulls(len(texts))
                yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64()),
                                                  none.cast(pa.bool_()), texts], schema=schema)
    if held:
        yield rest()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the records of header CSV files without their headers and without empty lines, read in splits.

    Files are read twice, first for the splits' maps. A split needs its lines in order, no others; a record that crosses
    splits is put together from its parts, two a split at most. A quote that is never closed makes the rest of its file
    one record, as it must. A header must begin in its file's first split. The table of splits has one short row for
    `spark.sql.files.maxPartitionBytes` of input, so that a file's splits fit one task."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a split that ends alike from both states sets the state; the others keep or swap it
    fixed = F.col("from_outside") == F.col("from_inside")
    swaps = F.sum(F.when(~fixed & F.col("from_outside"), 1).otherwise(0)).over(order)
    maps = (lines.mapInArrow(_split_maps, SPLITS)
            .withColumn("swaps", F.coalesce(swaps, F.lit(0)))
            .withColumn("total", F.col("swaps") + F.when(~fixed & F.col("from_outside"), 1).otherwise(0)))
    last = F.last(F.when(fixed, F.struct("from_outside", "total")), ignorenulls=True).over(order)
    states = (maps.withColumn("last", last)
              .withColumn("inside", F.when(F.col("last").isNull(), F.col("swaps") % 2 == 1)
                          .otherwise(F.col("last.from_outside") != ((F.col("swaps") - F.col("last.total")) % 2 == 1)))
              .withColumn("owner", F.last(F.when(~F.col("inside") | F.col("begins_inside"), F.col("block")),
                                          ignorenulls=True).over(order))
              .where("inside").select("file", "block", "inside", "owner"))
    placed = (lines.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"], "left")
              .withColumn("inside", F.coalesce("inside", F.lit(False)))
              .sortWithinPartitions("file", "block", "at"))      # nothing moves where the few open splits are broadcast
    found = placed.drop("at").mapInArrow(_records, PARTS)
    part = F.struct("block", "head", "value")
    crossing = (found.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(part)).alias("parts"))
                .where(~F.exists("parts", lambda p: p["head"]))
                .select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return (found.where("owner IS NULL").select("value").unionByName(crossing)
            .select(F.regexp_replace("value", "\r$", "").alias("value")).where("value != ''"))

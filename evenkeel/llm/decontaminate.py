"""Benchmark passages in training documents, found through an FM-index of every shard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import packed_batch, packed_schema, query, table
from evenkeel.llm.fm_index import FIRST, GAP, FMIndex

WINDOW = 13
SHARD_WORDS = 1_500_000
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z lowered; 0-9, a-z and all bytes of longer characters kept; everything else a blank
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of bounded size, so that a block may travel with the tasks whatever their number."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if words:
            block.append((row["i"], words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


class Phrases:
    """The windows of a block of items, as symbols of the words they hold."""

    def __init__(self, block: list[tuple[str, list[bytes]]], window: int):
        self.symbol = {w: FIRST + k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
        self.alphabet = FIRST + len(self.symbol)
        windows: dict[tuple, set] = {}
        for item, words in block:
            ids = [self.symbol[w] for w in words]
            for k in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[k:k + window]), set()).update([] if item is None else [item])
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.table = np.zeros((len(windows), window), np.int64)
        for k, w in enumerate(windows):
            self.table[k, window - len(w):] = w
        self.items = [sorted(v) for v in windows.values()]

    def spans(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each text of the shard its merged word spans and the items that have a window in it."""
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))      # a GAP closes each text
        symbols = np.full(bounds[-1], GAP, np.int64)
        for k, words in enumerate(texts):
            symbols[bounds[k]:bounds[k] + len(words)] = np.fromiter(
                map(self.symbol.get, words, repeat(GAP)), np.int64, len(words))
        stay = np.concatenate(([True], (symbols[1:] != GAP) | (symbols[:-1] != GAP))) if len(symbols) else symbols > 0
        place = np.flatnonzero(stay)                       # a run of gaps is one gap: nothing can match across it
        index = FMIndex(symbols[place], self.alphabet)
        lo, hi = index.search(self.table, self.lengths)
        found = np.flatnonzero(hi > lo)
        times = (hi - lo)[found]
        which = np.repeat(found, times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[found], times)
        start = place[index.locate(rows)]
        cover = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + self.lengths[which], -1)
        hit = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
        opens, ends = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in texts]
        for a, b, k in zip(opens.tolist(), ends.tolist(), (np.searchsorted(bounds, opens, "right") - 1).tolist()):
            out[k][0].append((a - int(bounds[k]), b - int(bounds[k])))
        doc = np.searchsorted(bounds, start, "right") - 1
        for k, w in set(zip(doc.tolist(), which.tolist())):
            out[k][1].update(self.items[w])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, n_hit, items, spans): every row of docs with the benchmark items it holds.

    Words are runs of 0-9, a-z (A-Z lowered) and characters above ASCII. A phrase is each run of `window` words of
    an item, or the whole item if it is shorter; items without words, and NULL texts, hold nothing, and an item
    without an id counts but is not listed. spans are the
    merged removal spans in words of the document (end exclusive); items are the sorted ids, as strings, with a
    phrase in it. Repeated rows are judged one by one, empty tables give empty results.

    Each task cuts its documents into shards of about shard_words words, indexes each shard, searches all phrases
    in it backwards and places what it finds: nothing is shuffled, and memory is that of one shard (or of one
    document that is longer). Items go out in blocks of bounded size, one narrow pass for each.
    """
    context = docs.sparkSession.sparkContext
    full, arrow = packed_schema(docs, FOUND)
    at = docs.columns.index(text)
    out = None
    for block in item_blocks(items, item_id, item_text, block_words) or []:
        sent = context.broadcast(Phrases(block, window))
        out = _pass(docs, sent, full, arrow, at, shard_words) if out is None else _pass(
            out, sent, full, arrow, at, shard_words, again=True)
    if out is None:
        out = _pass(docs, context.broadcast(Phrases([], window)), full, arrow, at, shard_words)
    return out


def _pass(df: DataFrame, sent, full, arrow, at: int, shard_words: int, again: bool = False) -> DataFrame:
    def flush(held: list, texts: list) -> Iterator[pa.RecordBatch]:
        found, k = sent.value.spans(texts), 0
        for batch in held:
            rows = []
            for i in range(batch.num_rows):
                spans, items = found[k]
                if again:
                    spans = merged(spans + [(x["start"], x["end"]) for x in batch.column(4)[i].as_py()])
                    items = items | set(batch.column(3)[i].as_py())
                rows.append((len(texts[k]), sum(b - a for a, b in spans), sorted(items),
                             [{"start": a, "end": b} for a, b in spans]))
                k += 1
            if again:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(
                    zip(*rows), list(arrow)[1:])]], schema=arrow)
            else:
                yield packed_batch(batch, rows, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                column = batch.column(0).field(at) if again else batch.column(at)
                words = [words_of(t) for t in column.to_pylist()]
                held.append(batch)
                texts += words
                size += sum(map(len, words))
                if size >= shard_words:
                    yield from flush(held, texts)
                    held, texts, size = [], [], 0
        if held:
            yield from flush(held, texts)

    return df.mapInArrow(run, full)


def is_contaminated() -> "F.Column":
    """At least a twentieth of the words lie in benchmark passages."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return (find_passages(docs, items, **options).where(~is_contaminated())
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    words = list(WORD.finditer(text))
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:words[a].start()])
        last = words[b - 1].end()
    return "".join(out) + text[last:]


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (_UP, _LOW)
PASSAGE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, grams.n FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM
            (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op6_benchmark_decontamination", PASSAGE_SQL)
def op6_benchmark_decontamination(spark, sf_dir):
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        is_contaminated().alias("contaminated"))

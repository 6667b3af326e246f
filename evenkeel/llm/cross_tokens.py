"""Two tokenizers over the same texts: where their tokens end together, and which tokens correspond corpus-wide."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from evenkeel.llm.common import query, sha, table
from evenkeel.session import cut_lineage

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20          # text of one block; a longer text is a block of its own
ENCODE_BYTES = 256 << 10       # text encoded at once
KNOWN, KNOWN_CHARS = 250_000, 48         # remembered words, and their length at most: memory, not a limit on texts
HELD = re.compile(r"\s(?= )|\s\Z")        # white space that keeps the next space, or the text's end, in its word
JOINED = 1000                  # unknown words encoded as one text
WIDE = 4096                    # links of a group above which ids are counted before they are paired


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Pair:
    """Both tokenizers, and the bytes of every token of either."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        import sentencepiece
        import tokenizers

        with open(byte_level, encoding="utf-8") as f:
            vocabulary = json.load(f)
        alphabet = byte_alphabet()
        entries = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary["model"]["vocab"].items()}
        entries.update({t["id"]: t["content"].encode() for t in vocabulary.get("added_tokens", [])})
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.a = tokenizers.Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

        # neither tokenizer has a token that goes on over a space behind a non-space, so that words can be encoded alone
        split = vocabulary.get("pre_tokenizer") or {}
        self.by_word = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not vocabulary.get("normalizer")
                        and not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())))
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """The ids of each text, space + text for the byte-level one; None where either does not spell space + text."""
        for batch in _batched(texts):
            words = [_words(t) if self.by_word else [t] for t in batch]
            recent, older, new = self.recent, self.older, {}
            for ws in words:
                for w in set(ws).difference(recent):
                    ids = older.get(w)
                    if ids is None:
                        new[w] = None
                    else:
                        recent[w] = ids
            passing = []
            for w, ids in zip(new, self._spelled(list(new))):
                if ids is not None:
                    recent[w] = tuple(ids[0]), tuple(ids[1])        # tuples of numbers are no work for the collector
                    if len(w) > KNOWN_CHARS:
                        passing.append(w)
            for ws in words:
                ids = list(map(recent.get, ws))
                yield None if None in ids else tuple(list(chain.from_iterable(map(itemgetter(k), ids))) for k in (0, 1))
            for w in passing:
                del recent[w]
            if len(recent) > KNOWN:                                # words not met for long are forgotten
                self.recent, self.older = {}, recent

    def _spelled(self, words: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """The ids of each word. Words that may stand one behind the other are encoded as one text and cut apart."""
        if not self.by_word:
            yield from map(self._alone, words)
            return
        for k in range(0, len(words), JOINED):
            part = words[k:k + JOINED]
            lines = [w for w in part if w and not w[-1].isspace()]
            got = self._alone(" ".join(lines)) if lines else None
            if got is None:                                        # one of them is not spelled out, or none is plain
                yield from map(self._alone, part)
                continue
            a, b = got
            to = np.cumsum([len(w.encode()) + 1 for w in lines])
            cut_a, cut_b = (np.searchsorted(np.cumsum(t[x]), to) + 1 for t, x in ((self.a_sizes, a), (self.b_sizes, b)))
            cuts = iter(zip([0, *cut_a.tolist()], cut_a.tolist(), [0, *cut_b.tolist()], cut_b.tolist()))
            for w in part:
                if w and not w[-1].isspace():
                    i, x, j, y = next(cuts)
                    yield a[i:x], b[j:y]
                else:
                    yield self._alone(w)

    def _alone(self, text: str) -> tuple[list[int], list[int]] | None:
        whole = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1) if text else [self.b.piece_to_id("▁")]       # no text, no prefix
        same = (b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole)
        return (a, b) if same else None


def _words(text: str) -> list[str]:
    """The parts of space + text before each space that follows a non-space, without their first space."""
    words = text.split(" ")
    if not text.startswith(" ") and not HELD.search(text):
        return words
    out, held = [], None
    for w in words:
        held = w if held is None else f"{held} {w}"
        if w and not w[-1].isspace():
            out.append(held)
            held = None
    if held is not None:
        out.append(held)
    return out


def _batched(texts: list[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size > ENCODE_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group, how many tokens of a and of b stand up to its end; a and b hold the tokens' ends in bytes.

    While tokens go one to one, a[i] equals b[i + shift]. The length of such a stretch is found by probing: the two
    slices at the current shift are compared at doubling lengths, then at halving ones, and the stretch is jumped
    over. Where it breaks off, the side whose end lies further left steps on until both ends meet, and the shift is taken anew.
    """
    heads, shifts, runs = [], [], []                           # a run of one-to-one groups, or a single other group
    i, shift, n = 0, 0, len(a)
    while i < n:
        j = i + shift
        if a[i] == b[j]:
            run = probe = 1
            while a[i + run:i + run + probe] == b[j + run:j + run + probe] and i + run < n:
                run += probe
                probe += probe
            while probe > 1:
                probe >>= 1
                if a[i + run:i + run + probe] == b[j + run:j + run + probe]:
                    run += probe
            run = min(run, n - i)                              # a last slice may reach beyond both ends
            heads.append(i + 1)
            shifts.append(shift)
            runs.append(run)
            i += run
            continue
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        shift = j - i
        i += 1
        heads.append(i)
        shifts.append(shift)
        runs.append(1)
    runs = np.array(runs, np.int64)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    ends_a = np.repeat(np.array(heads, np.int64), runs) + within
    return ends_a, ends_a + np.repeat(np.array(shifts, np.int64), runs)


class Speller:
    """The ids of groups as text, `a1,a2|b1;a3|b2,b3`: ids with each separator are made once."""

    def __init__(self, model: Pair):
        self.a, self.b = ([np.array([f"{i}{c}" for i in range(len(t))], object) for c in marks]
                          for t, marks in ((model.a_bytes, ",|"), (model.b_bytes, ",;")))

    def spell(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        out = np.empty(len(a) + len(b), object)
        for ids, marked, ends, before in ((a, self.a, ends_a, np.concatenate(([0], ends_b[:-1]))), (b, self.b, ends_b, ends_a)):
            sizes = np.diff(ends, prepend=0)
            to = np.arange(len(ids)) + np.repeat(before, sizes)       # behind what the other side has by then
            out[to] = marked[0][ids]
            out[to[ends - 1]] = marked[1][ids[ends - 1]]
        return "".join(out.tolist())[:-1]


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times): a code a << 32 | b for the token pairs of every group, with how often each is met.

    Ordinary groups give each occurrence, with times 1; in a wide one the ids of either side are counted first, so that
    its occurrences are never put down one by one.
    """
    from_a, from_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    n_a, n_b = ends_a - from_a, ends_b - from_b
    links = n_a * n_b
    one, wide = links == 1, links > WIDE
    some = np.flatnonzero(~one & ~wide)
    g = np.repeat(some, links[some])
    k = np.arange(len(g)) - np.repeat(np.cumsum(links[some]) - links[some], links[some])
    codes = [a[from_a[one]] << 32 | b[from_b[one]], a[from_a[g] + k // n_b[g]] << 32 | b[from_b[g] + k % n_b[g]]]
    times = [np.ones(len(codes[0]) + len(codes[1]), np.int64)]
    for w in np.flatnonzero(wide):
        ids_a, m_a = np.unique(a[from_a[w]:ends_a[w]], return_counts=True)
        ids_b, m_b = np.unique(b[from_b[w]:ends_b[w]], return_counts=True)
        codes.append((ids_a[:, None] << 32 | ids_b[None, :]).ravel())
        times.append((m_a[:, None] * m_b[None, :]).ravel())
    return np.concatenate(codes), np.concatenate(times)


ALIGNED = "a_ids array<int>, b_ids array<int>, ends array<struct<a:int,b:int>>"


def align_tokens(docs: DataFrame, text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(row, a_ids, b_ids, ends): both encodings of every text, and after how many tokens of each a group ends.

    A text that is NULL, empty, or not spelled as space + text by both tokenizers has NULLs. The input travels in
    `row`, so no name can clash; rows are independent, repeated rows give the same answer, no shuffle.
    """
    from evenkeel.llm.common import append_columns

    def work(texts: list) -> list[tuple]:
        model = _model(byte_level, pieces)
        found = iter(model.encode([t for t in texts if t]))
        out = []
        for t in texts:
            got = next(found) if t else None
            if got is None:
                out.append((None, None, None))
                continue
            a, b = got
            ends = common_ends(np.cumsum(model.a_sizes[a]).tolist(), np.cumsum(model.b_sizes[b]).tolist())
            out.append((a, b, [{"a": x, "b": y} for x, y in zip(*(e.tolist() for e in ends))]))
        return out

    return append_columns(docs, text, work, ALIGNED)


_models: dict[tuple[str, str], Pair] = {}


def _model(byte_level: str, pieces: str) -> Pair:
    """One a worker process."""
    if (byte_level, pieces) not in _models:
        _models[byte_level, pieces] = Pair(byte_level, pieces)
    return _models[byte_level, pieces]


BLOCKS = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots array<int>, times array<int>, pairs array<long>, n_docs array<int>"


def _align_blocks(byte_level: str, pieces: str, at: int, keep: list[int], arrow: pa.Schema):
    """Texts in, one row a text out, and one row a block with its distinct linked pairs and their documents."""
    def block_batch(number: int, rows: list[list], figures: list[tuple], codes: list, times: list, sizes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        slot, pairs = pd.factorize(flat)
        where = np.repeat(np.arange(len(sizes)), sizes) * max(len(pairs), 1) + slot        # (text, pair)
        often = np.concatenate(times) if times else np.zeros(0, np.int64)
        single = len(often) == 0 or often.max() == 1
        order = None if single else np.argsort(where)
        where = np.sort(where) if single else where[order]
        first = np.flatnonzero(np.diff(where, prepend=-1))
        met = np.diff(first, append=len(where)) if single else np.add.reduceat(often[order], first)
        doc, slot = np.divmod(where[first], max(len(pairs), 1))
        offsets = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
        n_docs = np.bincount(slot, minlength=len(pairs))
        n, nothing = len(rows), pa.nulls
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (slot, met)]
        own = [pa.array([*[r[k] for r in rows], None], f.type) for k, f in enumerate(arrow.field("row").type)]
        row = pa.StructArray.from_arrays(own, fields=list(arrow.field("row").type))
        columns = [row, pa.array([number] * (n + 1), pa.int64())]
        columns += [pa.array([*c, None], f.type) for c, f in zip(zip(*figures), list(arrow)[2:7])]
        columns += [pa.concat_arrays([x, nothing(1, x.type)]) for x in lists]
        for x, kind in ((pairs, pa.int64()), (n_docs, pa.int32())):
            columns.append(pa.concat_arrays([nothing(n, pa.list_(kind)), pa.array([x], pa.list_(kind))]))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()                          # nothing here refers to itself, and passes over the remembered words cost a third
        try:
            yield from blocks(batches)
        finally:
            gc.enable()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = _model(byte_level, pieces), TaskContext.get().partitionId() << 32
        speller = Speller(model)
        rows, figures, codes, times, sizes, held = [], [], [], [], [], 0
        for batch in batches:
            texts = batch.column(at).to_pylist()
            carried = list(zip(*[batch.column(k).to_pylist() for k in keep])) if keep else [()] * len(texts)
            found = iter(model.encode([t for t in texts if t]))
            for text, own in zip(texts, carried):
                got = next(found) if text else None
                rows.append(own)
                if got is None:
                    figures.append((0, 0, 0, 0, ""))
                    sizes.append(0)
                else:
                    a, b = np.array(got[0], np.int64), np.array(got[1], np.int64)
                    ends_a, ends_b = common_ends(np.cumsum(model.a_sizes[a]).tolist(), np.cumsum(model.b_sizes[b]).tolist())
                    code, time = linked(a, b, ends_a, ends_b)
                    codes.append(code)
                    times.append(time)
                    sizes.append(len(code))
                    figures.append((len(a), len(b), len(ends_a), int(time.sum()), sha(speller.spell(a, b, ends_a, ends_b))))
                    held += len(text)
                if held > BLOCK_BYTES or len(rows) > 50_000:
                    yield block_batch(number, rows, figures, codes, times, sizes)
                    rows, figures, codes, times, sizes, held, number = [], [], [], [], [], 0, number + 1
        if rows:
            yield block_batch(number, rows, figures, codes, times, sizes)

    return run


def linked_documents(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
                     byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    `row` holds the columns named in `keep` (all by default). Links are the pairs of token occurrences that share a
    group. The count of an id pair is the number of rows, corpus-wide, that hold it linked; n_best counts the links whose
    pair has the highest count of its a id (ties included), count_sum adds the counts over all links. A text that
    is NULL, empty, or not spelled as space + text by both tokenizers has zeros and an empty digest. Repeated rows
    count as often as they stand there; an empty table gives an empty result.

    Texts are encoded once, in blocks of bounded size. A text keeps its pairs as slots of its block's distinct pairs; only these
    distinct pairs travel: they are counted by pair (a pair comes once a block, however frequent), and the counts go
    back to their blocks, where each text adds up its slots. The highest counts (one for each a id) are broadcast.
    """
    keep = docs.columns if keep is None else list(keep)
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    row_type = StructType([StructField(c, docs.schema[c].dataType) for c in keep])
    if not keep:
        raise ValueError("keep at least one column")
    schema = StructType([StructField("row", row_type), *StructType.fromDDL(BLOCKS).fields])
    blocks = cut_lineage(docs.mapInArrow(_align_blocks(byte_level, pieces, at, kept, to_arrow_schema(schema)), schema))

    met = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("slot", "x"))
    met = met.select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.n_docs").cast("long").alias("n"))
    counts = cut_lineage(met.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32)))
    top = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("top")))          # one row for each id of the vocabulary
    judged = cut_lineage(counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best")))
    back = (met.select("block", "slot", "pair").join(judged, "pair").groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("slot", "count", "best"))).alias("x"))         # bounded by the block
            .select(F.col("block").alias("of_block"), F.col("x.count").alias("counts"), F.col("x.best").alias("best")))

    out = StructType([StructField("row", row_type), *StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    out_arrow = to_arrow_schema(out)

    def add_up(rows: pa.Table, sums: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        slots, times = (pa.concat_arrays(rows.column(c).chunks) for c in ("slots", "times"))
        offsets = slots.offsets.to_numpy()
        slot, time = slots.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        if sums.num_rows:
            counts, best = (pa.concat_arrays(sums.column(c).chunks).flatten() for c in ("counts", "best"))
            weights = (time * best.to_numpy(zero_copy_only=False)[slot], time * counts.to_numpy()[slot])
        else:
            weights = (time, time)                                                           # no text of the block has a link
        n_best, total = ([int(x) for x in np.diff(np.concatenate(([0], np.cumsum(w)))[offsets])] for w in weights)
        columns = [rows.column(c) for c in ("row", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(n_best), pa.array(total), rows.column("groups_sha256")]
        return pa.table([c.cast(f.type) for c, f in zip(columns, out_arrow)], schema=out_arrow)

    texts = blocks.where("pairs IS NULL").select("block", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    return texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(add_up, out)


@query("op12_cross_tokens")
def op12_cross_tokens(spark, sf_dir):
    found = linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

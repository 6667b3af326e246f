"""Language-model scores from a bigram trie in Elias-Fano form, counted, built and queried shard by shard."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.llm.common import mix64, query, table, to_batch
from evenkeel.llm.elias_fano import TrieShard
from evenkeel.session import cut_lineage

DISCOUNT = 0.75
BLOCK_TOKENS = 1_000_000          # tokens a task counts at once
SHARD_TOKENS = 1_500_000          # tokens whose bigrams meet in a shard
HOT_PART = 0.25                   # a context of more than this part of a shard's tokens is split over shards
LEVELS = 255                      # codes of a probability

#: keys no word has: words hold no blank
END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\t")


def fold(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their narrowest type, compressed."""
    small = [a.astype(np.min_scalar_type(int(a.max()))) if a.dtype.kind in "iu" and len(a) and a.min() >= 0 else a for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, 5))


def _unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def token_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    """(ids, held out, words) of documents, about size tokens together; a longer document is a block of its own."""
    ids, held, words, n = [], [], [], 0
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            for d, h, t in zip(*[c.to_pylist() for c in whole.slice(k, 500).columns]):
                ids.append(d)
                held.append(bool(h))
                words.append(fold(t))
                n += len(words[-1]) + 1
                if n >= size:
                    yield ids, held, words
                    ids, held, words, n = [], [], [], 0
    if ids:
        yield ids, held, words


def frequent_contexts(docs: DataFrame, above: float, block_tokens: int = BLOCK_TOKENS) -> tuple[int, dict[int, tuple[int, int]]]:
    """All tokens, and the contexts (by hash) that more than `above` of them follow, with (followers, followers learned from).

    START opens every document and is a context like any word. Each block counts all its contexts and Spark adds them
    up, so the counts are exact; the contexts that stay whole come back as one sum. There are tokens / above hot ones at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, words in token_blocks(batches, block_tokens):
            learned = Counter(w for t, h in zip(words, held) if not h for w in t)
            count = Counter(w for t, h in zip(words, held) if h for w in t)
            count.update(learned)
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, count), np.uint64, len(count))
            yield pa.RecordBatch.from_arrays([
                pa.array(_signed(np.append(keys, np.uint64(START)))),
                pa.array(np.append(np.fromiter(count.values(), np.int64, len(count)), len(words))),
                pa.array(np.append(np.fromiter((learned[w] for w in count), np.int64, len(count)), len(words) - sum(held)))],
                names=["word", "n", "learned"])

    sums = [F.sum("n").alias("n"), F.sum("learned").alias("learned")]
    found = docs.mapInArrow(run, "word long, n long, learned long").groupBy("word").agg(*sums)
    rows = found.groupBy(F.when(F.col("n") > above, F.col("word")).alias("word")).agg(*sums).collect()
    return (sum(r["n"] for r in rows),
            {r["word"] + (1 << 63): (r["n"], r["learned"]) for r in rows if r["word"] is not None})


class Router:
    """Which shard counts a bigram: that of its context; a hot context's successors go to as many as its count needs."""

    def __init__(self, tokens: int, hot: dict[int, tuple[int, int]], shard_tokens: int):
        self.shards = max(1, -(-tokens // shard_tokens))
        part = max(1, int(HOT_PART * shard_tokens))
        split = {h: min(self.shards, -(-n // part)) for h, (n, _) in hot.items() if n > part}
        split = {h: ways for h, ways in split.items() if ways > 1}
        self.hot = np.array(sorted(split), np.uint64)
        self.ways = np.array([split[int(h)] for h in self.hot], np.uint64)
        self.learned = np.array([hot[int(h)][1] for h in self.hot], np.int64)

    def full(self, contexts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What is learned of each context over all shards, where own is what one shard counts of it."""
        if not len(self.hot):
            return own
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return np.where(self.hot[at] == contexts, self.learned[at], own)

    def split(self, contexts: np.ndarray) -> np.ndarray:
        """How many shards share each context."""
        if not len(self.hot):
            return np.ones(len(contexts), np.uint64)
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return np.where(self.hot[at] == contexts, self.ways[at], np.uint64(1))

    def shard(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        ways = self.split(contexts)
        spread = np.where(ways > 1, np.uint64(1) + mix64(words) % ways, np.uint64(0))
        return (mix64(contexts + spread * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.shards)).astype(np.int64)


def block_messages(block: int, ids: list, held: list, words: list[list[bytes]], router: Router) -> Iterator[tuple]:
    """(shard, kind, block, payload): the block's bigrams for each shard, and its documents."""
    distinct = dict.fromkeys(w for t in words for w in t)
    for k, w in enumerate(distinct):
        distinct[w] = k + 2
    keys = np.concatenate((np.array([START, END], np.uint64),
                           np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))))
    size = np.array([len(t) + 1 for t in words], np.int64)
    total = int(size.sum())
    token = np.empty(total, np.int64)
    end = np.cumsum(size)
    inner = np.ones(total, bool)
    inner[end - 1] = False
    token[inner] = np.fromiter((i for t in words for i in map(distinct.__getitem__, t)), np.int64, total - len(words))
    token[~inner] = 1
    context = np.empty(total, np.int64)
    context[1:] = token[:-1]
    context[end - size] = 0
    doc = np.repeat(np.arange(len(words)), size)
    train = ~np.repeat(np.array(held, bool), size)

    order = np.argsort(context * len(keys) + token, kind="stable")
    context, token, doc, train = context[order], token[order], doc[order], train[order]
    first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (token[1:] != token[:-1]))))
    times = np.diff(np.append(first, total))
    counts = np.add.reduceat(train.astype(np.int64), first)
    left, right = context[first], token[first]
    shard = router.shard(keys[left], keys[right])
    for s in np.unique(shard):
        pick = np.flatnonzero(shard == s)
        a, a_of = np.unique(left[pick], return_inverse=True)
        b, b_of = np.unique(right[pick], return_inverse=True)
        refs = np.repeat(first[pick] - np.concatenate(([0], np.cumsum(times[pick])[:-1])), times[pick]) + np.arange(times[pick].sum())
        yield int(s), 1, block, _pack(keys[a], np.diff(a_of, prepend=0), keys[b], b_of, counts[pick], times[pick], doc[refs])
    yield block % router.shards, 0, block, pickle.dumps((ids, held, size.tolist()))


OUT = ("kind int, block long, doc long, ctx long, word long, n long, types long, payload binary")
MESSAGE = "shard int, kind int, block long, payload binary"
SIGN = np.uint64(1 << 63)


def _signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ SIGN).view(np.int64)


def _rows(arrow: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """Arrays, single values and (left out) nulls as columns."""
    def column(f: pa.Field) -> pa.Array:
        v = columns.get(f.name)
        if v is None:
            return pa.nulls(size, f.type)
        return pa.array(v if isinstance(v, (list, np.ndarray)) else [v] * size, f.type, from_pandas=False)
    return pa.RecordBatch.from_arrays([column(f) for f in arrow], schema=arrow)


def count_and_answer(table: pa.Table, arrow: pa.Schema, tokens: int, router: Router, keep_model: bool) -> Iterator[pa.RecordBatch]:
    """Merge a shard's bigrams, build its trie, search every block's bigrams in it, and give sums per document.

    Kinds of rows: 0 documents of a block, handed on; 1 sums of a block's documents (base, model, known tokens);
    2 tokens whose bigram is not in the trie; 3 a context's count and successor types; 4 the shard's trie.
    """
    blocks, parts = [], []
    for kind, block, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "payload"))):
        if kind == 0:
            yield _rows(arrow, 1, kind=0, block=block, payload=[payload])
        else:
            a, a_step, b, b_of, counts, times, doc = _unpack(payload)
            parts.append((a[np.cumsum(a_step.astype(np.int64))], b[b_of], counts.astype(np.int64), times.astype(np.int64), doc.astype(np.int64)))
            blocks.append(block)
    if not parts:
        return
    left, right, counts, times = (np.concatenate([p[k] for p in parts]) for k in range(4))
    edge = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    contexts, left = np.unique(left, return_inverse=True)
    words, right = np.unique(right, return_inverse=True)
    pair, pair_of = np.unique(left * len(words) + right, return_inverse=True)
    count = np.bincount(pair_of, counts, len(pair)).astype(np.int64)
    pair, count = pair[count > 0], count[count > 0]
    owner = pair // len(words)
    types = np.bincount(owner, minlength=len(contexts))
    whole = router.split(contexts) == 1
    full = router.full(contexts, np.bincount(owner, count, len(contexts)).astype(np.int64))

    worst = np.log10(tokens + 1) + 1                       # no probability of a seen bigram is below 10 ** -worst
    codes = np.rint(np.minimum(-np.log10((count - DISCOUNT) / full[owner]) / worst, 1) * LEVELS).astype(np.uint8)
    kept = np.flatnonzero(types)
    code = np.full(len(left), -1, np.int64)
    if len(pair):
        image = TrieShard.build(contexts[kept], np.concatenate(([0], np.cumsum(types[kept]))), pair % len(words), codes)
        if keep_model:
            yield _rows(arrow, 1, kind=4, payload=[pickle.dumps((words, worst, image))])
        trie = TrieShard(image)
        order = np.argsort(left * len(words) + right)
        number = trie.contexts(contexts)[left[order]]
        there = number >= 0
        code[order[there]] = trie.search(number[there], right[order][there])
    seen = code >= 0
    # an unseen successor backs off: by its context's weight (here if the context is whole) and its own share (later)
    weight = np.log10(np.where(full > 0, DISCOUNT * types / np.maximum(full, 1), 1.0), where=whole, out=np.zeros(len(full)))
    value = np.where(seen, -code * (worst / LEVELS), weight[left])
    base, known = np.log10(full + 1.0)[left], (full > 0)[left]
    for k, p in enumerate(parts):
        each = np.repeat(np.arange(edge[k], edge[k + 1]), p[3])
        size = int(p[4].max()) + 1
        sums = [np.bincount(p[4], v[each], size) for v in (base, value)]
        yield _rows(arrow, 1, kind=1, block=blocks[k],
                    payload=[_pack(*sums, np.bincount(p[4], known[each], size).astype(np.int64))])
        lost = ~seen[each]
        if lost.any():
            at = each[lost]
            word = words[right[at]]
            word[word == np.uint64(END)] = np.uint64(START)          # counted as the context that opens a text
            ctx = pa.array(_signed(contexts[left[at]]), mask=whole[left[at]])
            batch = _rows(arrow, len(at), kind=2, block=blocks[k], doc=p[4][lost], word=_signed(word))
            yield batch.set_column(arrow.get_field_index("ctx"), arrow.field("ctx"), ctx)
    yield _rows(arrow, len(kept), kind=3, ctx=_signed(contexts[kept]), n=full[kept], types=types[kept].astype(np.int64))


SCORED = ("block long, doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")


def _documents(table: pa.Table, arrow: pa.Schema) -> pa.Table:
    """One row per document of a block, with what the shards said added up."""
    ids: list = []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
        if kind == 0:
            ids, held, size = pickle.loads(payload)
    sums = [np.zeros(len(ids)) for _ in range(3)]
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
        if kind == 1:
            for total, part in zip(sums, _unpack(payload)):
                total[:len(part)] += part
    block = table.column("block")[0].as_py()
    return pa.Table.from_batches([_rows(arrow, len(ids), block=block, doc=np.arange(len(ids)), doc_id=ids, held_out=held,
                                        n_tokens=size, n_known=sums[2].astype(np.int64), base=sums[0], score=sums[1])])


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2,
                block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, keep_model: bool = False):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs; with keep_model also the
    table of trie shards (payload).

    The model learns from documents whose crc32(id as text) modulo folds is not held_fold; a NULL id is learned from.
    Tokens are the words between ASCII blanks, A-Z lowered, then one end. score is the log10 probability of the text
    under a bigram model with absolute discounting: a seen bigram has (count - 0.75) / context, as an 8-bit code; an
    unseen one the context's discounted mass times the word's add-one share, so that a context's probabilities never
    sum to more than one. base_score is the add-one unigram score. NULL and empty texts are one end; repeated rows
    are texts of their own; an empty table gives an empty result. Words are told apart by 64-bit hashes.

    Every task counts blocks of documents and sends each shard its bigrams once per block, with the documents they
    stand in; shards grow in number with the tokens. A context, START included, that more than a quarter of a shard's tokens
    follow is split by its successors. Nothing but one shard, or one block, is ever held by a task, and the driver gets two
    totals and the hot contexts, four for each shard at most. One bigram, with its documents, always meets in one shard.
    """
    spark = docs.sparkSession
    fold_of = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(fold_of == held_fold, F.lit(False)).alias("h"), F.col(text).alias("t"))
    tokens, hot = frequent_contexts(texts, HOT_PART * shard_tokens, block_tokens)
    router = spark.sparkContext.broadcast(Router(tokens, hot, shard_tokens))
    arrow, out_arrow, scored_arrow = (to_arrow_schema(StructType.fromDDL(s)) for s in (MESSAGE, OUT, SCORED))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start = TaskContext.get().partitionId() << 32
        for k, (ids, held, words) in enumerate(token_blocks(batches, block_tokens)):
            yield to_batch(list(block_messages(start + k, ids, held, words, router.value)), arrow)

    def answer(shard: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(count_and_answer(shard, out_arrow, tokens, router.value, keep_model)), out_arrow)

    out = cut_lineage(texts.mapInArrow(send, MESSAGE).groupBy("shard").applyInArrow(answer, OUT))
    stats = cut_lineage(out.where("kind = 3").groupBy("ctx").agg(F.max("n").alias("c"), F.sum("types").alias("types")))
    total = stats.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    norm = float(np.log10(total["n"] + total["v"] + 1))
    own = F.log10(F.coalesce("c", F.lit(0)) + 1) - norm
    lost = out.where("kind = 2").join(stats.select(F.col("ctx").alias("word"), "c"), "word", "left")
    lost = lost.select("block", "doc", "ctx", own.alias("value"))
    split = spark.createDataFrame([(h,) for h in _signed(router.value.hot).tolist()], "ctx long")
    shared = lost.where("ctx IS NOT NULL").join(F.broadcast(stats.join(F.broadcast(split), "ctx")), "ctx", "left").select("block", "doc", (
        F.col("value") + F.coalesce(F.log10(DISCOUNT * F.col("types") / F.col("c")), F.lit(0.0))).alias("value"))
    extra = (lost.where("ctx IS NULL").select("block", "doc", "value").unionByName(shared)
             .groupBy("block", "doc").agg(F.sum("value").alias("extra")))
    found = out.where("kind IN (0, 1)").select("kind", "block", "payload").groupBy("block").applyInArrow(
        lambda t: _documents(t, scored_arrow), SCORED)
    result = found.join(extra, ["block", "doc"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return (result, out.where("kind = 4").select("payload")) if keep_model else result


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))

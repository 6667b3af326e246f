"""Near duplicates by a chosen-path join: sets are split on sampled shared tokens, again and again, in several runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.llm.common import local_ids, mix64, query, table, to_batch
from evenkeel.llm.components import connected_components
from evenkeel.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BYTES = 5                       # of a shingle's hash
SKETCH = 128                    # sampled tokens, of each of which one byte is kept to estimate a similarity
RECALL = 0.999999               # of pairs at the threshold: sets the number of runs
BUCKET = 2000                   # larger buckets are split further
DEPTH = 12                      # after so many splits a bucket is compared block by block
SAME = 0.95                     # estimated similarity at which a set leaves an overfull bucket with the bucket's pivot
BLOCK_SETS, BLOCK_SHINGLES = 2000, 4_000_000     # of one exact comparison; larger groups take several

_ODD = mix64(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
_XOR = mix64(np.arange(5001, 6025, dtype=np.uint64))


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met in some first bucket with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold))


def floor_for(threshold: float) -> float:
    """The estimate below which a pair cannot be similar, but for a chance of one in 30,000 at the threshold."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)


def shingles_of(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's k-word shingles; a shorter text with a word is one shingle."""
    return hashed_shingles(text, k)[0]


def hashed_shingles(text: str | None, k: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """The 64-bit hashes of the shingles, sorted, and the set's identity: 128 bits made of two 64-bit hashes of every shingle."""
    ids, distinct = local_ids((text or "").encode("utf-8", "surrogatepass").split())
    if not len(ids):
        return np.zeros(0, np.uint64), b""
    n, both = max(1, len(ids) - k + 1), []
    for seed, factor in ((0, 0x9E3779B97F4A7C15), (1, 0xD6E8FEB86659FD93)):
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))[ids]
        total = np.zeros(n, np.uint64)
        for j in range(min(k, len(h))):
            total = total * np.uint64(factor) + h[j:j + n]
        both.append(mix64(total))
    first, at = np.unique(both[0], return_index=True)
    return first, xxhash.xxh3_128_digest(first.tobytes() + both[1][at].tobytes())


def shortened(shingles: np.ndarray) -> np.ndarray:
    """Forty bits of each hash, for the exact comparison: they keep the sets small where they are written and shuffled.

    In sets of a thousand shingles two different ones share a hash once in a million comparisons, which moves a similarity by
    a thousandth. Which sets are equal is never decided by them, but by the sets' identities."""
    return np.unique(shingles >> np.uint64(64 - 8 * BYTES))


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def least_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """For each of count hash functions the least hash of the set: a token sampled alike from similar sets."""
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = (shingles[a:a + 2048, None] ^ _XOR[:count]) * _ODD[:count]
        np.minimum(out, part.min(0), out=out)
    return out


def set_table(docs: DataFrame, doc_id: str, text: str, runs: int) -> DataFrame:
    """(doc, t1, t2, sig, n, tokens, sketch, shingles) per row: the set's fingerprint, one token per run, its sketch."""
    schema = "doc long, t1 long, t2 long, sig binary, n int, tokens array<long>, sketch binary, shingles binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long"), F.xxhash64(t), F.xxhash64(F.lit(11), t), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                rows = []
                for d, t1, t2, x in zip(*[c.to_pylist() for c in whole.slice(k, 500).columns]):
                    full, sig = hashed_shingles(x)
                    s = shortened(full)
                    if not len(s):
                        rows.append((d, t1, t2, None, 0, [], None, None))
                        continue
                    least = least_hashes(s, runs + SKETCH)
                    data = packed(s)
                    rows.append((d, t1, t2, sig, len(s), least[:runs].view(np.int64).tolist(),
                                 (mix64(least[runs:]) >> np.uint64(56)).astype(np.uint8).tobytes(), data))
                yield to_batch(rows, arrow)

    return narrow.mapInArrow(run, schema)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least label of each of n nodes' component, and which edges (a, b) span the components."""
    label, left, kept = np.arange(n), np.arange(len(a)), []
    while True:
        la, lb = label[a[left]], label[b[left]]
        cross = la != lb
        if not cross.any():
            return label, np.concatenate(kept) if kept else np.zeros(0, np.int64)
        left, high, low = left[cross], np.maximum(la, lb)[cross], np.minimum(la, lb)[cross]
        hooks, first = np.unique(high, return_index=True)
        kept.append(left[first])
        parent = np.arange(n)
        parent[hooks] = low[first]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches, cut again so that no group of equal leading columns is divided; many small groups at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held and held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py():
                change[0] = True
        at = np.flatnonzero(change)
        if len(at) and rows + at[-1] >= 4000 or len(at) and not held and at[-1] > 0 and batch.num_rows > 4000:
            cut = int(at[-1])
            parts = held + ([batch.slice(0, cut)] if cut else [])
            yield pa.Table.from_batches(parts)
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def candidates(sets: DataFrame, floor: float) -> DataFrame:
    """Edges (a, b) between sets that met in a bucket with an estimated similarity of at least floor.

    Of every bucket only edges that span its candidate graph are given, so a bucket of n sets gives less than n.
    """
    edge = to_arrow_schema(StructType.fromDDL("a binary, b binary"))
    step = StructType.fromDDL("a binary, b binary, path long, sig binary, sketch binary")
    arrow = to_arrow_schema(step)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 1):
            path = part.column(0).to_numpy()
            sig = part.column(1).combine_chunks()
            sketch = _sketches(part.column(2))
            left, right = [], []
            live, k = np.arange(len(path)), 1
            while True:
                live = live[live + k < len(path)]
                live = live[path[live] == path[live + k]]
                if not len(live):
                    break
                for c in range(0, len(live), 20_000):
                    i = live[c:c + 20_000]
                    near = i[(sketch[i] == sketch[i + k]).sum(1) >= floor * SKETCH]
                    left.append(near)
                    right.append(near + k)
                k += 1
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                _, kept = spanning(len(path), a, b)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([sig.take(pa.array(a[kept])), sig.take(pa.array(b[kept]))], schema=edge)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            own, pivot = _sketches(batch.column(2)), _sketches(batch.column(4))
            like = (own == pivot).sum(1) / SKETCH
            for k, (path, sig, sketch, first, _) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                if like[k] >= floor and sig != first:
                    rows.append((first, sig, None, None, None))
                if like[k] < SAME or sig == first:
                    for turn in (1, 2):                 # two sampled tokens, so that a similar pair stays together
                        at = xxhash.xxh3_64_intdigest(f"{path}:{turn}")
                        at, value = at % SKETCH, sketch[at % SKETCH]
                        down = xxhash.xxh3_64_intdigest(f"{path}:{turn}:{at}:{value}")
                        rows.append((None, None, down - (1 << 63), sig, sketch))
            if rows:
                yield to_batch(rows, arrow)

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(buckets: DataFrame) -> DataFrame:
        return buckets.repartition(parts, "path").sortWithinPartitions("path", "sig").mapInArrow(compare, "a binary, b binary")

    now = (sets.select(F.posexplode("tokens").alias("run", "token"), "sig", "sketch")
           .select(F.xxhash64("run", "token").alias("path"), "sig", "sketch"))
    edges = None
    for depth in range(DEPTH + 1):
        full = cut_lineage(now.groupBy("path").agg(F.count("*").alias("n"), F.min("sig").alias("pivot"),
                                                   F.min_by("sketch", "sig").alias("pivot_sketch")).where(F.col("n") > BUCKET))
        found = compared(now.join(full, "path", "left_anti").select("path", "sig", "sketch"))
        edges = found if edges is None else edges.unionByName(found)
        if full.isEmpty():
            return edges
        over = now.join(full, "path")
        if depth == DEPTH:
            return edges.unionByName(_all_blocks(over, compare, parts))
        out = cut_lineage(over.select("path", "sig", "sketch", "pivot", "pivot_sketch").mapInArrow(split, step))
        edges = edges.unionByName(out.where("a IS NOT NULL").select("a", "b"))
        now = out.where("a IS NULL").select("path", "sig", "sketch")
    return edges


def _all_blocks(over: DataFrame, compare, parts: int) -> DataFrame:
    """The last resort, exact: an overfull bucket in blocks of half its bound, every two of them side by side."""
    blocks = F.ceil(F.col("n") * 2 / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    pairs = over.select("path", "sig", "sketch", own.alias("own"), other).select(
        F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "sig", "sketch")
    return pairs.repartition(parts, "path").sortWithinPartitions("path", "sig").mapInArrow(compare, "a binary, b binary")


def links(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different sets (sorted hashes) with an exact Jaccard similarity of at least threshold.

    The sets are known to be different: two whose shortened hashes are all alike have at least one shingle each that the
    other has not, and count so."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n <= 24:
        common = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        tokens, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1                   # a token of one set only is in no intersection
        row = np.repeat(np.arange(n), size)
        keep = times[where] > 1
        row, column = row[keep], shared[where[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common, width = np.zeros((n, n), np.float32), 4096
        for a in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            block = np.zeros((n, width), np.float32)
            block[row[lo:hi], column[lo:hi] - a] = 1
            common += block @ block.T
    a, b = np.nonzero(np.triu(common > 0, 1))
    both = common[a, b]
    both = np.where((both == size[a]) & (both == size[b]), both - 1, both)
    # the small margin keeps exact ratios such as 4/5 on the right side of the division
    near = both / (size[a] + size[b] - both) >= threshold - 1e-9
    return a[near], b[near]


def verified(sets: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(sig, root, links): exact classes and numbers of linked documents inside the candidate groups (sig, component).

    Each set is sent to its group once. A group beyond the bound of one comparison is cut into blocks by hash, and
    every two blocks are compared; their spanning edges are then joined into classes.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies are folded before the shuffle, so that a hot group of them is one row for each task
    single = sets.groupBy("sig").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n"), F.count("*").alias("copies"))
    single = cut_lineage(single.join(groups, "sig"))
    size = cut_lineage(single.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
                       .withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES)))
                       .withColumn("blocks", F.when(F.col("blocks") <= 1, 1).otherwise(F.col("blocks") * 2).cast("int"))
                       .select("component", "blocks"))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    dealt = (single.join(size, "component")
             .select("component", "sig", "copies", "shingles", "blocks", own.alias("own"),
                     F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                     "sig", "copies", "shingles", "own", F.col("blocks") == 1, F.col("own") == F.col("other")))
    schema = "sig binary, root binary, links long, whole boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 1):
            task = part.column(0).to_numpy()
            sig, copies, block = part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(4).to_numpy()
            whole, inside = part.column(5).to_pylist(), part.column(6).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
            rows = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                a, b = links([unpacked(x) for x in part.column(3).slice(lo, hi - lo).to_pylist()], threshold)
                root, _ = spanning(hi - lo, a, b)
                if not whole[lo]:                            # two blocks: pairs across them, or one block with itself
                    within = np.array(inside[lo:hi])
                    new = (block[lo + a] != block[lo + b]) | within[a]
                    a, b = a[new], b[new]
                count = np.zeros(hi - lo, np.int64)
                np.add.at(count, a, copies[lo + b])
                np.add.at(count, b, copies[lo + a])
                rows += [(sig[lo + k], sig[lo + int(root[k])], int(count[k]), whole[lo]) for k in range(hi - lo)]
            if rows:
                yield to_batch(rows, arrow)

    found = cut_lineage(dealt.repartition(parts, "task").sortWithinPartitions("task", "sig").mapInArrow(compare, schema))
    cut = found.where("NOT whole")
    done = found.where("whole").select("sig", "root", "links")
    if cut.isEmpty():
        return done
    classes = connected_components(cut, "sig", "root")
    return done.unionByName(cut.groupBy("sig").agg(F.sum("links").alias("links")).join(
        classes.select(F.col("node").alias("sig"), F.col("component").alias("root")), "sig").select("sig", "root", "links"))


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float, recall: float) -> DataFrame:
    """(doc, t1, t2, sig, class, class_size, links) per row of docs; no sig and no class without words."""
    rows = cut_lineage(set_table(docs, doc_id, text, runs_for(threshold, recall)))
    sets = rows.where("sig IS NOT NULL")
    distinct = cut_lineage(sets.groupBy("sig").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    groups = connected_components(cut_lineage(candidates(distinct, floor_for(threshold))), "a", "b").select(
        F.col("node").alias("sig"), "component")
    exact = verified(sets.select("sig", "n", "shingles"), groups, threshold)
    known = (sets.groupBy("sig").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
             .join(exact, "sig", "left")
             .select("sig", "first", "copies", F.coalesce("root", "sig").alias("root"),
                     (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("links")))
    known = cut_lineage(known)
    heads = cut_lineage(known.groupBy("root").agg(F.min("first").alias("class"), F.sum("copies").alias("class_size")))
    classes = cut_lineage(known.join(heads, "root").select("sig", "class", "class_size", "links", "root"))
    return rows.select("doc", "t1", "t2", "sig").join(classes, "sig", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, class_size, n_links): one row per row of docs.

    Two documents are linked if the sets of their 5-word shingles (words between ASCII blanks; a shorter text is one
    shingle) have a Jaccard similarity of at least threshold. A class is a connected component of links, named by its
    least doc_id; n_links counts the rows linked with the row, exact copies among them. A text without words, or NULL,
    is alone in its class and has no links. Repeated rows are copies; empty tables give empty results.

    Equal sets are joined first. In each run the sets meet in buckets by a sampled token; a bucket too large to compare
    is split again on two more sampled tokens, and what nearly equals its pivot leaves it with an edge to the pivot.
    Buckets give only spanning edges of estimated similarity, safely below the threshold; groups so connected are then
    compared exactly, so that no false link is given and a true one is lost only if all runs miss it.
    """
    found = _classes(docs, doc_id, text, threshold, recall)
    return found.select(F.col("doc").alias("doc_id"),
                        F.when(F.col("sig").isNull(), F.col("doc")).otherwise(F.col("class")).alias("class_id"),
                        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
                        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                recall: float = RECALL) -> DataFrame:
    """The documents that stay: of every class the one of least id (then of least text hash), with its columns.

    Of repeated rows one stays. Texts without words are no copies of anything and all stay.
    """
    found = _classes(docs, doc_id, text, threshold, recall)
    heads = (found.where("sig IS NOT NULL").groupBy("root")
             .agg(F.min(F.struct(F.col("doc").isNull(), "doc", "t1", "t2")).alias("head")).select("head.doc", "head.t1", "head.t2"))
    heads = cut_lineage(heads)
    t = F.coalesce(F.col(text), F.lit(""))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("k0"),
                       F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(11), t).alias("k2"))
    on = F.col("k0").eqNullSafe(F.col("doc")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    stays = left.withColumn("blank", F.btrim(F.coalesce(F.col("row").getField(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "")
    kept = stays.where("NOT blank").join(heads, on, "left_semi").dropDuplicates(["k0", "k1", "k2"]).select("row")
    kept = kept.unionByName(stays.where("blank").select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op5_chosen_path_join")
def op5_chosen_path_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Quality rules: a linear-chain CRF labels every line content or boilerplate; the content share decides."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import append_columns, local_ids, map_rows, query, table
from evenkeel.session import cut_lineage

SAMPLE_DOCS = 600              # labelled documents of each class the model is fitted on
MIN_CONTENT = 0.5              # share of a document's words that must stand in content lines
MIN_WORDS = 50
CELLS = 1 << 17                # lines, padding included, that are worked on side by side; a longer document is alone
FIT_LINES = 500_000            # labelled lines that the driver fits by itself; beyond, tasks sum the gradients
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ["bias", "symbols", "bangs", "capitals", "digits", "dots", "few_words", "long_words", "distinct_words",
            "closed", "seen_before", "empty"]

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(["", SYMBOLS, "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", SPACES]):
    for _c in _chars:
        _CLASS[ord(_c)] = _k


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and words of every line, and how many lines with a word equal an earlier line."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    n = len(lines)
    size = np.fromiter(map(len, lines), np.int64, n)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    kinds = _CLASS[np.frombuffer(data + b"\n", np.uint8)]
    words, distinct, seen, before = np.empty(n), np.empty(n), np.zeros(n), set()
    for k, line in enumerate(lines):
        found = line.split()
        words[k] = len(found)
        distinct[k] = len(set(found))
        if found:
            if line in before:
                seen[k] = 1
            before.add(line)
    share = np.zeros((n, 5))
    chars = np.maximum(size, 1)
    for k in range(1, 6):
        share[:, k - 1] = np.add.reduceat((kinds == k).astype(np.int64), start) / chars
    last = kinds[np.maximum(start + size - 1, 0)]
    x = np.column_stack([
        np.ones(n), np.minimum(share[:, 0] * 10, 1), np.minimum(share[:, 1] * 10, 1), share[:, 2], share[:, 3],
        np.minimum(share[:, 4] * 5, 1), 1 / (1 + words), np.minimum(chars / (1 + words) / 20, 1),
        distinct / np.maximum(words, 1), (last == 5) & (size > 0), seen, words == 0])
    return x, words, int(seen.sum())


def base_counts(text: str) -> tuple[int, int, int, int]:
    """Words, their code points, symbols, and words in 3-word windows found twice or more in the text."""
    ids, _ = local_ids(text.encode("utf-8", "surrogatepass").split())
    n = len(ids)
    repeated = 0
    if n > 3:
        v = np.int64(ids.max() + 1)
        pairs = ids[:-1] * v + ids[1:]
        if v > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated


def side_by_side(sizes: list[int], cells: int = CELLS) -> Iterator[list[int]]:
    """Which documents to work on together: of like length, 256 at most, padded to the longest (the last) within `cells` lines."""
    part: list[int] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (len(part) == 256 or (len(part) + 1) * sizes[k] > cells):
            yield part
            part = []
        part.append(k)
    if part:
        yield part


class LineCrf:
    """Two labels (0 boilerplate, 1 content): weights of a line's features for content, and label transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequence of each document (Viterbi), documents of like length side by side; a tie is content."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
        for part in side_by_side([len(x) for x in sequences]):
            steps = len(sequences[part[-1]])
            gain = np.zeros((len(part), steps))
            size = np.array([len(sequences[k]) for k in part])
            for r, k in enumerate(part):
                gain[r, :size[r]] = sequences[k] @ self.weights
            best = np.stack([np.zeros(len(part)), gain[:, 0]], 1)
            came = np.zeros((len(part), steps, 2), np.int8)
            for t in range(1, steps):
                paths = best[:, :, None] + self.moves
                came[:, t] = paths[:, 1] >= paths[:, 0]
                ahead = np.maximum(paths[:, 0], paths[:, 1])
                ahead[:, 1] += gain[:, t]
                best = np.where((t < size)[:, None], ahead, best)
            now = (best[:, 1] >= best[:, 0]).astype(np.int8)
            labels = np.zeros((len(part), steps), np.int8)
            rows = np.arange(len(part))
            for t in range(steps - 1, -1, -1):
                inside = t < size
                labels[inside, t] = now[inside]
                now = np.where(inside & (t > 0), came[rows, t, now], now).astype(np.int8)
            for r, k in enumerate(part):
                out[k] = labels[r, :size[r]] == 1
        return out


Docs = list[tuple[np.ndarray, int]]


def line_gradient(docs: Docs, p: np.ndarray, share: float) -> np.ndarray:
    """Sum over documents of the logistic regression's gradient; a document weighs 1, each class half of all."""
    out = np.zeros(len(p))
    for x, y in docs:
        out += x.T @ (y - _sigmoid(x @ p)) * (0.5 / (share if y else 1 - share) / len(x))
    return out


def chain_gradient(docs: Docs, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over documents of what the chain's labels hold less what the model expects, from forward and backward sums."""
    width = len(FEATURES)
    w, moves = p[:width], p[width:].reshape(2, 2)
    out = np.zeros(len(p))
    for part in side_by_side([len(x) for x, _ in docs]):
        part = part[::-1]
        size = np.array([len(docs[k][0]) for k in part])
        steps = int(size[0])
        inside = np.arange(steps)[None] < size[:, None]
        alive = inside.sum(0)                                # sorted by length: a prefix of the rows at each step
        gain, labels = np.zeros((len(part), steps, 2)), np.zeros((len(part), steps), np.int8)
        for r, k in enumerate(part):
            x, good = docs[k]
            gain[r, :size[r], 1] = x @ w
            labels[r, :size[r]] = 1 if good else x @ first > 0
        fore, back = np.zeros_like(gain), np.zeros_like(gain)
        fore[:, 0] = gain[:, 0]
        for t in range(1, steps):
            n = alive[t]
            fore[:n, t] = gain[:n, t] + np.logaddexp(fore[:n, t - 1, :1] + moves[0], fore[:n, t - 1, 1:] + moves[1])
        for t in range(steps - 2, -1, -1):
            n = alive[t + 1]
            ahead = gain[:n, t + 1] + back[:n, t + 1]
            back[:n, t] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        total = np.logaddexp(fore[:, 0, 0] + back[:, 0, 0], fore[:, 0, 1] + back[:, 0, 1])
        for r, k in enumerate(part):
            n = size[r]
            out[:width] += docs[k][0].T @ (labels[r, :n] - np.exp(fore[r, :n, 1] + back[r, :n, 1] - total[r]))
        both = inside[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                seen = ((labels[:, :-1] == i) & (labels[:, 1:] == j) & both).sum()
                pair = np.exp(fore[:, :-1, i] + moves[i, j] + gain[:, 1:, j] + back[:, 1:, j] - total[:, None])
                out[width + 2 * i + j] += seen - pair[both].sum()
    return out


def fit_crf(docs: Docs, rounds: int = 300, decay: float = 1e-4) -> LineCrf:
    """Fit on documents (line features, quality 0 or 1).

    A good document's lines are content. Of a bad document's lines those count as boilerplate that a logistic
    regression of lines on the document's label does not hold for content. The chain is then fitted on those
    label sequences by the likelihood's gradient, from forward and backward sums. Without documents of both kinds
    all weights are zero, and every line is content.
    """
    return fit_by(lambda gradient, *given: gradient(docs, *given), len(docs), sum(y for _, y in docs), sum(len(x) for x, _ in docs),
                  rounds, decay)


def fit_by(summed: Callable[..., np.ndarray], n_docs: int, n_good: int, n_lines: int, rounds: int = 300, decay: float = 1e-4) -> LineCrf:
    """fit_crf, where summed(gradient, ...) is gradient(docs, ...) of all documents, wherever they are."""
    width = len(FEATURES)
    if n_good in (0, n_docs):
        return LineCrf(np.zeros(width), np.zeros((2, 2)))
    w = _ascend(lambda p: summed(line_gradient, p, n_good / n_docs) / n_docs - decay * p, np.zeros(width), rounds)
    p = _ascend(lambda p: summed(chain_gradient, p, w) / n_lines - decay * p, np.concatenate([w, np.zeros(4)]), rounds)
    return LineCrf(p[:width], p[width:].reshape(2, 2))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ascend(gradient, p: np.ndarray, rounds: int, rate: float = 0.2) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        g = gradient(p)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          sample_docs: int = SAMPLE_DOCS, fit_lines: int = FIT_LINES, rounds: int = 300) -> LineCrf:
    """Fit on at most sample_docs labelled documents of each class, those of the least hash of their id.

    Up to fit_lines lines come to the driver; of more, the features stay in a table and each round's gradient is
    summed in tasks, so that the driver holds one vector a task, however long a document is."""
    marked = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("d"), F.col(quality).cast("int").alias("y"), F.xxhash64(F.col(doc_id)).alias("h"))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy("h", "d").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
             .join(F.broadcast(chosen), "d").select("d", "y", "t"))

    def featured(ids, ys, ts):
        return [(d, y, len(x), x.astype(np.float32).tobytes()) for d, y, x in ((d, y, line_features(t)[0]) for d, y, t in zip(ids, ys, ts))]

    found = cut_lineage(map_rows(texts, featured, "d long, y int, n long, x binary").withColumn("rid", F.monotonically_increasing_id()))
    light = found.select("d", "y", "n", F.xxhash64("x").alias("h"), "rid").orderBy("d", "y", "h", "rid").limit(4 * sample_docs).collect()
    place = {r["rid"]: k for k, r in enumerate(light)}
    n_lines, n_good = sum(r["n"] for r in light), sum(r["y"] for r in light)
    picked = found.where(F.col("rid").isin(list(place))).select("rid", "y", "x")
    if n_lines <= fit_lines:
        rows = sorted(picked.collect(), key=lambda r: place[r["rid"]])
        docs_here = [(_features(r["x"]), r["y"]) for r in rows]
        return fit_crf(docs_here, rounds)

    def summed(gradient: Callable, *given) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                here = [(_features(x), y) for y, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                if here:
                    part = gradient(here, *given)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

        return np.sum([r["g"] for r in picked.mapInArrow(run, "g array<double>").collect()], axis=0)

    return fit_by(summed, len(light), n_good, n_lines, rounds)


def _features(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, len(FEATURES)).astype(float)


VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_lines long, n_content_words long")


def judge(docs: DataFrame, model: LineCrf, text: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """(row, counts..., base_failed, kept): every row of docs with its verdict.

    A document is kept if it passes the base rules and at least min_content of its words stand in lines that the
    model labels content. A NULL or empty text has no words and fails. Repeated rows are judged alike, an empty
    table gives an empty result; nothing is shuffled, and a task holds one batch of documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> list[tuple]:
        out, part, cells = [], [], 0
        for k, t in enumerate(texts):
            part.append(line_features(t or ""))
            cells += len(part[-1][1])
            if cells < CELLS and k + 1 < len(texts):
                continue
            labels = sent.value.label([x for x, _, _ in part])
            for t, (x, words, dup), content in zip(texts[len(out):], part, labels):
                n, chars, symbols, repeated = base_counts(t or "")
                failed = n < MIN_WORDS or 100 * repeated > 50 * n
                good = int(words[content].sum())
                out.append((n, chars, symbols, dup, repeated, failed, not failed and good >= min_content * n, len(words), good))
            part, cells = [], 0
        return out

    return append_columns(docs, text, work, VERDICT)


def keep_good(docs: DataFrame, model: LineCrf, **options) -> DataFrame:
    """The kept documents with their columns."""
    return judge(docs, model, **options).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_words")

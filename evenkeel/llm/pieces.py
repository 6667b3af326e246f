"""SentencePiece ids by a streaming Viterbi search, and texts back from ids."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import packed_schema, query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED_CHARS, CACHED_SEGMENTS = 64, 1_000_000       # memory of the memo, not a limit on texts


class PieceModel:
    """The vocabulary of a model file: pieces, scores, byte pieces, and which pieces may follow each other.

    Unigram models score a path by the sum of its pieces. In a BPE model the scores rank merges: the path that the
    merges produce is the only one in which each two neighbours, merged on their own, stay as they are. Both are
    found by the same search; a BPE path simply may only use such neighbours.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, norm.add_dummy_prefix
        kind = {k: p.type for k, p in enumerate(proto.pieces)}
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if kind[k] in (1, 4)}
        self.score = [p.score for p in proto.pieces]
        self.unknown = next((k for k, t in kind.items() if t == 2), 0)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if kind[k] == 6}
        self.text = [b"" if kind[k] in (2, 3) else bytes([int(p.piece[3:5], 16)]) if kind[k] == 6
                     else p.piece.replace(SPACE, " ").encode() for k, p in enumerate(proto.pieces)]
        self.piece = [p.piece for p in proto.pieces]
        self.longest = max(map(len, self.id))
        # every ending of a piece, with the piece's id, or -1 where it is no piece itself
        self.ending = {p[k:]: -1 for p in self.id for k in range(len(p))} | self.id
        self.none = len(self.score)                       # stands before the first piece and for a character of no piece
        joined = {c for p in self.id if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.alone = "".join(c for c in "\n\r\t" if c not in joined)
        # nothing spans a boundary between these segments, so every path converges there
        rest = f"[^{SPACE}{re.escape(self.alone)}]"
        self.segments = re.compile(f"{SPACE}+{rest}*|{rest}+" + (f"|[{re.escape(self.alone)}]" if self.alone else "")) if not inner else None
        self.follows: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by its merges, best first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.id.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, piece: int) -> bool:
        left = "" if before == self.none else self.piece[before]
        right = self.piece[piece]
        answer = self.merge(left + right) == ([left, right] if left else [right])
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[before << 32 | piece] = answer
        return answer

    def ids_of(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        if found is not None:
            return [found]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Characters in, ids out: a window of backpointers, committed wherever all surviving paths share a boundary.

    Only paths that end in the last `longest` positions can still grow. Their backpointers are followed to the
    latest boundary that all of them pass; what lies before it is final, is given out, and leaves the window.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.window, self.start, self.last, self.score = "", [0], [model.none], [0.0]

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        step = 8 * self.model.longest
        for k in range(0, len(chars), step):
            self._advance(chars[k:k + step])
            out += self._commit()
        return out

    def finish(self) -> list[int]:
        out = self._spell(len(self.window))
        self.__init__(self.model)
        return out

    def _advance(self, chars: str) -> None:
        begin = len(self.window)
        self.window += chars
        if self.model.bpe:
            self._allowed(begin)
        else:
            self._best(begin)

    def _allowed(self, begin: int) -> None:
        """BPE: the one piece that may end at a position and follow what ends where it begins."""
        model, text, start, last = self.model, self.window, self.start, self.last
        ending, follows, none = model.ending, model.follows, model.none
        for end in range(begin + 1, len(text) + 1):
            a = end - 1
            while a >= 0:
                piece = ending.get(text[a:end])
                if piece is None:
                    a = -1
                    break
                if piece >= 0:
                    ok = follows.get(last[a] << 32 | piece)
                    if ok or (ok is None and model.may_follow(last[a], piece)):
                        break
                a -= 1
            if a >= 0:
                start.append(a)
                last.append(piece)
            else:
                start.append(end - 1)
                last.append(none)

    def _best(self, begin: int) -> None:
        """Unigram: the piece that ends the best path to a position; of equals the longest."""
        model, text, start, last, score = self.model, self.window, self.start, self.last, self.score
        lost = min(model.score) - 10
        for end in range(begin + 1, len(text) + 1):
            best, at, chosen = score[end - 1] + lost, end - 1, model.none
            for a in range(end - 1, -1, -1):
                piece = model.ending.get(text[a:end])
                if piece is None:
                    break
                if piece >= 0 and score[a] + model.score[piece] >= best:
                    best, at, chosen = score[a] + model.score[piece], a, piece
            start.append(at)
            last.append(chosen)
            score.append(best)

    def _commit(self) -> list[int]:
        end = len(self.window)
        alive = {max(0, end - k) for k in range(self.model.longest)}
        while len(alive) > 1:                             # step the furthest path back until one boundary is left
            far = max(alive)
            alive.remove(far)
            alive.add(self.start[far])
        cut = alive.pop()
        out = self._spell(cut)
        if cut:
            self.window = self.window[cut:]
            self.start = [max(0, s - cut) for s in self.start[cut:]]
            self.last = self.last[cut:]
            self.score = [s - self.score[cut] for s in self.score[cut:]]
        return out

    def _spell(self, end: int) -> list[int]:
        ids, start, last, none = [], self.start, self.last, self.model.none
        while end > 0:
            if last[end] == none:
                ids += reversed(self.model.ids_of(self.window[end - 1]))
            else:
                ids.append(last[end])
            end = start[end]
        ids.reverse()
        return ids


class Encoder(dict):
    """Texts to ids as int32 bytes; segments between sure boundaries are remembered."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        search = StreamingViterbi(self.model)
        if len(segment) <= 8 * self.model.longest:
            search._advance(segment)
            ids = search._spell(len(segment))
        else:
            ids = search.feed(segment) + search.finish()
        packed = array("i", ids).tobytes()
        if len(segment) <= CACHED_CHARS:
            if len(self) >= CACHED_SEGMENTS:
                self.clear()
            self[segment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.model.prefix:
            text = SPACE + text
        if self.model.segments is None:
            return self[text]
        return b"".join(map(self.__getitem__, self.model.segments.findall(text)))


def decode(model: PieceModel, ids: Iterable[int]) -> str:
    """The text of ids: pieces joined, byte pieces as the bytes they are, the leading blank taken off."""
    data = b"".join(map(model.text.__getitem__, ids))
    text = data.decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def _on_executors(df: DataFrame, column: str, model: str, extra: str, work) -> DataFrame:
    full, arrow = packed_schema(df, extra)
    sent = df.sparkSession.sparkContext.broadcast(PieceModel(model))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Encoder(sent.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                row = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow.field("row").type)],
                                                 fields=list(arrow.field("row").type))
                yield pa.RecordBatch.from_arrays([row, *work(state, batch.column(at))], schema=arrow)

    return df.mapInArrow(run, full)


def encode_texts(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """(row, n_ids, ids[, round_trip]): every row of docs with the ids of its whole text.

    Equal to the model library's own ids. A NULL or empty text has no ids. Repeated rows are encoded alike, an empty
    table gives an empty result; nothing is shuffled. round_trip says that decoding gives the text back; it is false
    only where a text holds the blank mark U+2581 itself, which the vocabulary cannot tell from a blank.
    """
    def work(state: Encoder, column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        packed = [state.encode(t) for t in texts]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        kind = pa.list_(pa.field("element", pa.int32()))
        out = [pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), type=kind)]
        if check:
            out.append(pa.array([decode(state.model, ids[a:b].tolist()) == t
                                 for t, a, b in zip(texts, ends[:-1], ends[1:])], pa.bool_()))
        return out

    return _on_executors(docs, text, model, "n_ids long, ids array<int>" + ", round_trip boolean" * check, work)


def decode_ids(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(row, decoded): every row with the text of its ids; NULL ids give an empty text."""
    return _on_executors(rows, ids, model, "decoded string",
                         lambda state, column: [pa.array([decode(state.model, i or []) for i in column.to_pylist()], pa.string())])


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    found = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_ids", "ids", "round_trip")

import os
import random

import numpy as np
import pytest

from evenkeel.llm import pieces as p
from evenkeel.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.exists(p.MODEL), reason="the vocabulary file is not here")


@pytest.fixture(scope="module")
def model():
    return p.PieceModel(p.MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=p.MODEL)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_ids_equal_the_librarys(model, library):
    rng, encoder = random.Random(1), p.Encoder(model)
    texts = ["", " ", "  Hello  ﬁ½ world \n", "a" * 3000, "ab" * 700 + "\n\n\t x    y", "日本\U0001F600 é\x00z", "return" * 100 + " " * 40 + "public static"]
    texts += ["".join(rng.choice("aeinrst ▁the\n.-_é日") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    for t in texts:
        assert ids(encoder, t) == library.encode(t)
        if p.SPACE not in t:
            assert p.decode(model, ids(encoder, t)) == t


def test_stream_gives_the_same_ids_however_it_is_cut(model, library):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aeinrst the.é") for _ in range(rng.randint(1, 400)))
        search, got, k = p.StreamingViterbi(model), [], 0
        marked = p.SPACE + text.replace(" ", p.SPACE)
        while k < len(marked):
            n = rng.randint(1, 50)
            got += search.feed(marked[k:k + n])
            k += n
            assert len(search.window) <= 64 * model.longest
        assert got + search.finish() == library.encode(text)


def test_unigram_search_is_the_best_path(model):
    class Small(p.PieceModel):
        def __init__(self):
            rng = random.Random(3)
            self.piece = ["?"] + [*"abc", "ab", "bc", "abc", "ca", "bcab", "aa", "cab"]
            self.score = [-9.0] + [-rng.random() * len(x) - 1 for x in self.piece[1:]]
            self.id = {x: k for k, x in enumerate(self.piece) if k}
            self.bytes, self.unknown, self.bpe = {}, 0, False
            self.longest = 4
            self.ending = {x[k:]: -1 for x in self.id for k in range(len(x))} | self.id
            self.none = len(self.score)

    small, rng = Small(), random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        best = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            best[end] = max((best[a][0] + small.score[small.id[text[a:end]]], best[a][1] + [small.id[text[a:end]]])
                            for a in range(max(0, end - 4), end) if text[a:end] in small.id)
        search = p.StreamingViterbi(small)
        got = search.feed(text) + search.finish()
        assert abs(sum(small.score[i] for i in got) - best[len(text)][0]) < 1e-9


def test_tables(spark, sf, docs_of, odd_texts, library):
    found = p.encode_texts(docs_of(odd_texts), check=True).select("row.doc_id", "row.text", "n_ids", "ids", "round_trip").collect()
    assert len(found) == len(odd_texts)
    for r in found:
        assert r["ids"] == library.encode(r["text"] or "") and r["n_ids"] == len(r["ids"]) and r["round_trip"]
    back = p.decode_ids(p.encode_texts(table(spark, sf, "documents")).select("row.text", "ids")).select("row.text", "decoded").collect()
    assert back and all(r["text"] == r["decoded"] for r in back)
    assert p.encode_texts(docs_of([])).count() == 0

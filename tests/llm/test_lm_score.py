import math
import zlib
from collections import Counter

import numpy as np
import pytest

from evenkeel.llm import lm_score as m
from evenkeel.llm.common import table
from evenkeel.llm.elias_fano import EliasFano, TrieShard


def brute(rows):
    uni, pairs, context, types = Counter(), Counter(), Counter(), Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            before = b"\t"
            for w in m.fold(t) + [b"\n"]:
                uni[w] += 1
                pairs[before, w] += 1
                context[before] += 1
                before = w
    for a, _ in pairs:
        types[a] += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for d, t in rows:
        words, before, base, score = m.fold(t) + [b"\n"], b"\t", 0.0, 0.0
        for w in words:
            own = math.log10((uni[w] + 1) / (n + v + 1))
            base += own
            if pairs[before, w]:
                score += math.log10((pairs[before, w] - m.DISCOUNT) / context[before])
            else:
                score += own + (math.log10(m.DISCOUNT * types[before] / context[before]) if context[before] else 0)
            before = w
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        out.append((d, held, len(words), sum(uni[w] > 0 for w in words), n, base, score))
    return out


def same(got, want, step):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5]))
        assert abs(a[6] - b[6]) <= step * a[2]


@pytest.mark.parametrize("options", [{}, {"block_tokens": 300, "shard_tokens": 500}, {"block_tokens": 5000, "shard_tokens": 100}])
def test_scores_agree_with_brute_force(docs_of, odd_texts, options):
    rows = odd_texts + [(k, f"The hot word the {k % 5} and the {k} hot the " * (k % 4)) for k in range(20, 120)]
    n = sum(len(m.fold(t)) + 1 for _, t in rows)
    same(m.score_texts(docs_of(rows), **options).collect(), brute(rows), (math.log10(n + 1) + 1) / m.LEVELS / 2 + 1e-9)


def test_scores_of_the_test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    same(m.score_texts(docs, block_tokens=20_000, shard_tokens=30_000).collect(), want, 0.02)
    assert sum(r[6] for r in want if r[1]) > sum(r[5] for r in want if r[1])      # better than single words on held-out texts


def test_empty_table_and_only_held_out(docs_of):
    assert m.score_texts(docs_of([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    same(m.score_texts(docs_of([(held, "a b")])).collect(), brute([(held, "a b")]), 1e-9)


def test_model_shards_can_be_mapped_and_searched(docs_of):
    rows = [(k, "a b c a b") for k in range(10)]
    _, shards = m.score_texts(docs_of(rows), keep_model=True)
    import pickle

    words, worst, image = pickle.loads(shards.first()["payload"])
    trie = TrieShard(image)
    key = lambda w: m.xxhash.xxh3_64_intdigest(w)
    context = trie.contexts(np.array([key(b"a")], np.uint64))
    code = trie.search(context, np.searchsorted(words, np.array([key(b"b")], np.uint64)))
    n = sum(zlib.crc32(str(k).encode()) % 7 != 2 for k in range(10))
    assert abs(-code[0] * worst / m.LEVELS - math.log10((2 * n - m.DISCOUNT) / (2 * n))) <= worst / m.LEVELS


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 2 ** 62), (1000, 50), (1000, 2 ** 63), (200_000, 10 ** 9)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.of(values)
        assert (e.slice(0, n) == values).all() and (e.slice(n // 3, n // 2) == values[n // 3:n // 2]).all()
        wanted = np.sort(np.concatenate((values[: n // 2], rng.integers(0, top, 500, dtype=np.uint64))))
        index, equal = e.next_geq(wanted)
        assert (index == np.searchsorted(values, wanted)).all()
        assert (equal == np.isin(wanted, values)).all()


def test_successors_are_searched_in_their_own_context_only():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
    lists = [np.unique(rng.integers(0, 60 if k % 3 else 5, rng.integers(1, 9))) for k in range(len(keys))]
    flat = np.concatenate(lists)
    codes = rng.integers(0, 256, len(flat))
    pointers = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    trie = TrieShard(TrieShard.build(keys, pointers, flat, codes))
    assert (trie.contexts(keys) == np.arange(len(keys))).all() and (trie.contexts(np.sort(keys + np.uint64(1))) == -1).all()
    context, successor = np.repeat(np.arange(len(keys)), 64), np.tile(np.arange(64), len(keys))
    want = {(c, s): int(codes[pointers[c] + k]) for c, x in enumerate(lists) for k, s in enumerate(x)}
    got = trie.search(context, successor)
    assert [want.get((c, s), -1) for c, s in zip(context.tolist(), successor.tolist())] == got.tolist()


def test_a_context_too_large_for_a_shard_is_split_however_small_its_share(docs_of):
    def loads(rows, shard_tokens):
        texts = docs_of(rows).selectExpr("doc_id", "crc32(string(doc_id)) % 7 = 2", "text")
        tokens, hot = m.frequent_contexts(texts, m.HOT_PART * shard_tokens, 400)
        router = m.Router(tokens, hot, shard_tokens)
        pairs = [(a, b) for _, t in rows for a, b in zip([b"\t"] + m.fold(t), m.fold(t) + [b"\n"])]
        left, right = (np.array([m.xxhash.xxh3_64_intdigest(p[k]) for p in pairs], np.uint64) for k in (0, 1))
        assert tokens == len(pairs)
        return np.bincount(router.shard(left, right), minlength=router.shards), router, hot, left

    short = [(k, f"w{k}") for k in range(4000)]                      # START has half of all bigrams
    load, router, hot, left = loads(short, 400)
    assert hot[m.START] == (4000, sum(zlib.crc32(str(k).encode()) % 7 != 2 for k in range(4000)))
    assert router.split(np.array([m.START], np.uint64))[0] > 1 and load.max() < 1600
    # a word of 0.125% of the tokens, but of more than a shard's quarter
    rare = [(k, " ".join(f"v{k}-{j}" for j in range(39)) + (" rare" if k % 20 == 0 else " v")) for k in range(1000)]
    _, router, hot, left = loads(rare, 100)
    key = m.xxhash.xxh3_64_intdigest(b"rare")
    assert hot[key][0] == 50 and router.split(np.array([key], np.uint64))[0] == 2
    rows = short[:400] + rare[:60]
    n = sum(len(m.fold(t)) + 1 for _, t in rows)
    same(m.score_texts(docs_of(rows), block_tokens=300, shard_tokens=100).collect(), brute(rows), (math.log10(n + 1) + 1) / m.LEVELS / 2 + 1e-9)

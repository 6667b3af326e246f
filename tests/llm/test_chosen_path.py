import itertools
import random

import numpy as np
import pytest

from evenkeel.llm import chosen_path as c
from evenkeel.llm.common import table


def brute(rows, threshold=0.8):
    """Class (least id) and number of linked rows of every row, by comparing all pairs."""
    sets = [set(c.shingles_of(t).tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    return sorted(((d, min(x for x in members[find(k)] if x is not None) if any(x is not None for x in members[find(k)]) else None,
                    len(members[find(k)]), links[k]) for k, (d, _) in enumerate(rows)), key=str)


def near_rows(groups=6, copies=8, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([40, 200, 400]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5, 12])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows


def found(docs, **options):
    return sorted([tuple(r) for r in c.near_duplicates(docs, **options).collect()], key=str)


def test_classes_and_links_agree_with_all_pairs(docs_of):
    rows = near_rows()
    assert found(docs_of(rows)) == brute(rows)


def test_odd_documents(docs_of, odd_texts):
    assert found(docs_of(odd_texts)) == brute(odd_texts)
    assert found(docs_of([])) == []
    assert found(docs_of([(1, None), (2, "")])) == [(1, 1, 1, 0), (2, 2, 1, 0)]


@pytest.mark.parametrize("depth", [12, 1])
def test_overfull_buckets_and_large_groups(docs_of, monkeypatch, depth):
    """Small bounds force further splits, pivots, block by block comparison and groups of several blocks."""
    rows = near_rows(groups=2, copies=30, seed=5) + [(1000 + k, "same text of seven or more words here") for k in range(40)]
    monkeypatch.setattr(c, "BUCKET", 6)
    monkeypatch.setattr(c, "DEPTH", depth)
    monkeypatch.setattr(c, "BLOCK_SETS", 10)
    assert found(docs_of(rows)) == brute(rows)


def test_recall_on_the_test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == brute(rows)


def test_one_document_of_each_class_stays(docs_of):
    rows = near_rows(groups=4) + [(None, "a b c d e f"), (None, "a b c d e f"), (900, ""), (901, None), (902, "x y"), (902, "x y")]
    docs = docs_of(rows)
    kept = c.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {(cls, d if cls is None else None) for d, cls, _, _ in brute(rows) if cls not in (None, 900, 901)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([cls for cls, _ in classes] + [None, 900, 901], key=str)
    assert c.one_of_each(docs_of([])).count() == 0


def test_spanning_edges_keep_components():
    rng = np.random.default_rng(0)
    for n in (1, 2, 10, 60):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        label, kept = c.spanning(n, a, b)
        want, _ = c.spanning(n, a[kept], b[kept])
        assert (label == want).all() and len(kept) == n - len(set(label))
        assert all(label[x] == label[y] for x, y in zip(a, b))


def test_exact_links_of_many_sets_equal_those_of_few():
    rng = random.Random(3)
    base = [rng.getrandbits(60) for _ in range(90)]
    sets = [np.unique(np.array(rng.sample(base, rng.randint(70, 90)), np.uint64)) for _ in range(40)]
    want = {(i, j) for i, j in itertools.combinations(range(40), 2)
            if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8 - 1e-9}
    assert set(zip(*[x.tolist() for x in c.links(sets, 0.8)])) == want and want


def test_short_texts_whose_shortened_hashes_collide_stay_apart(spark):
    """Found among four million one-word texts: one pair of many that share forty bits of their only shingle."""
    words = [b"w%d" % k for k in range(4_000_000)]
    hashes = c.mix64(c.np.fromiter(map(c.xxhash.xxh3_64_intdigest, words), c.np.uint64, len(words))) >> c.np.uint64(24)
    order = c.np.argsort(hashes, kind="stable")
    at = c.np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    assert len(at)
    a, b = (words[order[at[0] + k]].decode() for k in (0, 1))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (5, "other")], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in c.near_duplicates(docs).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 1, 0), 3: (1, 2, 1), 4: (4, 1, 0), 5: (5, 1, 0)}
    assert sorted(r["doc_id"] for r in c.one_of_each(docs).collect()) == [1, 2, 4, 5]

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evenkeel.llm import cross_tokens as ct


@pytest.fixture(scope="module")
def model():
    return ct.Pair()


def plain(ends):
    return ends[0].tolist(), ends[1].tolist()


def brute_ends(a, b):
    both = sorted(set(a) & set(b))
    return [a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 80)), st.sets(st.integers(1, 80)), st.integers(81, 83))
def test_common_ends(a, b, last):
    a, b = sorted(a | {last}), sorted(b | {last})
    assert plain(ct.common_ends(a, b)) == brute_ends(a, b)


def test_common_ends_on_long_stretches():
    a = list(range(1, 5001))
    b = [x for x in a if x not in (17, 18, 900, 4000)]
    assert plain(ct.common_ends(a, b)) == brute_ends(a, b)
    assert plain(ct.common_ends(b, a)) == brute_ends(b, a)


def test_wide_groups_count_ids_before_pairing(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 300)
    ends = np.array([150, 151, 200]), np.array([1, 299, 300])

    def totals():
        out = Counter()
        for c, n in zip(*ct.linked(a, b, *ends)):
            out[int(c)] += int(n)
        return out
    first = totals()
    monkeypatch.setattr(ct, "WIDE", 10)
    assert totals() == first and sum(first.values()) == 150 + 298 + 49


def brute(model, rows):
    whole = []
    for doc, text in rows:
        got = None
        if text:
            a = model.a.encode(" " + text, add_special_tokens=False).ids
            b = model.b.encode(text)
            if b"".join(model.a_bytes[i] for i in a) == b"".join(model.b_bytes[i] for i in b) == (" " + text).encode():
                got = a, b, []
                cut_a, cut_b = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((model.a_bytes, a), (model.b_bytes, b)))
                both, i, j = set(cut_a) & set(cut_b), 0, 0
                for end in sorted(both):
                    x, y = cut_a.index(end, i) + 1, cut_b.index(end, j) + 1
                    got[2].append((a[i:x], b[j:y]))
                    i, j = x, y
        whole.append((doc, got))
    count = Counter()
    for _, got in whole:
        count.update({(x, y) for g in (got[2] if got else []) for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc, got in whole:
        if got is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in got[2] for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in got[2])
        out.append((doc, len(got[0]), len(got[1]), len(got[2]), len(links), sum(count[x] == top[x[0]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r["row"]["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                   for r in ct.linked_documents(df).collect()], key=repr)


MORE = [(11, "<|endoftext|> <s></s><unk> plain"), (12, "has ▁ in it"), (13, "  two  spaces\r\n\ttabs "), (14, "日本語と한국어 ünïcödé 😀😀"),
        (15, "same text"), (16, "same text"), (16, "same text"), (17, "<0x41> A"), (18, "\x00\x01"), (19, "x")]


def test_documents_equal_brute_force(spark, docs_of, odd_texts, model, monkeypatch):
    rows = [(d, t) for d, t in odd_texts + MORE if not t or len(t) < 20_000]
    assert found(docs_of(rows)) == brute(model, rows)
    monkeypatch.setattr(ct, "BLOCK_BYTES", 200)               # many blocks, the same answers
    assert found(docs_of(rows)) == brute(model, rows)


def test_very_long_texts(spark, docs_of, odd_texts, model):
    rows = [(d, t) for d, t in odd_texts if t and len(t) >= 20_000]
    got = {r[0]: r for r in found(docs_of(rows))}
    for d, t in rows:
        a, b = next(model.encode([t]))
        assert got[d][1:3] == (len(a), len(b)) and got[d][5] == got[d][4] >= got[d][3]    # one text: all pairs count once... and are best
        assert got[d][6] == got[d][4]


def test_table(spark, sf, model):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert found(df) == brute(model, [tuple(r) for r in df.collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab, 1\n\t\r\u00a0\u3000\x1cé日'▁", max_size=30), max_size=4))
def test_words_encoded_alone_give_the_ids_of_whole_texts(texts):
    pair, whole = ct._model(ct.BYTE_LEVEL, ct.PIECES), ct.Pair()
    whole.by_word = False
    assert pair.by_word and list(pair.encode(texts)) == list(whole.encode(texts))


def test_empty(spark, docs_of):
    assert found(docs_of([(1, "x")]).where("doc_id = 2")) == []


def test_alignment_spells_the_text(spark, docs_of, model):
    rows = [(k, t) for k, t in enumerate(["Some words, and some more.", "日本語", "", None])]
    for r in ct.align_tokens(docs_of(rows)).collect():
        text = rows[r["row"]["doc_id"]][1]
        if not text:
            assert r["a_ids"] is None and r["ends"] is None
            continue
        i = j = 0
        for e in r["ends"]:
            left, right = (b"".join(t[x] for x in ids) for t, ids in ((model.a_bytes, r["a_ids"][i:e["a"]]), (model.b_bytes, r["b_ids"][j:e["b"]])))
            assert left == right
            i, j = e["a"], e["b"]
        assert (i, j) == (len(r["a_ids"]), len(r["b_ids"]))

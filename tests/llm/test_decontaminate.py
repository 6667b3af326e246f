import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate as d
from evenkeel.llm.fm_index import FMIndex, suffix_order


def brute(text, items, window=13):
    words, hit, named = [w.decode("utf-8", "surrogatepass") for w in d.words_of(text)], set(), set()
    for item, t in items:
        own = [w.decode() for w in d.words_of(t)]
        for k in range(max(0, len(own) - window) + 1) if own else ():
            part = own[k:k + window]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    named.add(item)
    return len(words), len(hit), sorted(i for i in named if i is not None)


WORDS = [f"w{k}" for k in range(30)]
ITEMS = [("1", " ".join(WORDS)), ("2", "Short Item, here"), ("10", " ".join(WORDS[5:20])), ("3", ""), ("4", None), (None, "nameless one"), ("5", "w1")]
TEXTS = [" ".join(WORDS), "x " * 50 + " ".join(WORDS[3:18]).upper() + " y", "a short, item HERE short item here", " ".join(WORDS[:12]), None, "",
         "w1 w1 w1", "the nameless-one", " ".join(WORDS[:13]) + " gap " + " ".join(WORDS[13:29]), "w1 " * 5000, "é short é item"]


@pytest.mark.parametrize("options", [{}, {"shard_words": 10}, {"block_words": 1}, {"shard_words": 40, "block_words": 20}])
def test_passages_agree_with_brute_force(spark, docs_of, options):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = docs_of([(k, t) for k, t in enumerate(TEXTS)] * 2)
    got = d.find_passages(docs, items, **options).select("row.doc_id", "n_words", "n_hit", "items", "spans").collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(TEXTS[r["doc_id"]], ITEMS), r
        assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_contaminated_documents_go(spark, docs_of):
    items = spark.createDataFrame([("1", "alpha beta gamma")], "item_id string, text string")
    docs = docs_of([(1, "alpha beta gamma " + "x " * 57), (2, "alpha beta gamma " + "x " * 58), (3, "x"), (4, None)])
    kept = d.drop_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert d.drop_contaminated(docs, nothing).count() == 4
    assert d.find_passages(docs_of([]), items).count() == 0


def test_cutting_spans():
    assert d.cut_spans("One, two three. four", [(1, 3)]) == "One, . four"
    assert d.cut_spans(None, []) is None and d.cut_spans("a b", [(0, 2)]) == ""


def test_index_against_plain_search():
    rng = np.random.default_rng(4)
    for n, alphabet in ((1, 3), (50, 4), (400, 5), (3000, 200), (500, 3)):
        s = rng.integers(1, alphabet, n)
        full = np.concatenate((s, [0]))
        order = suffix_order(full, max(1, int(alphabet - 1).bit_length()))
        assert sorted(order) == list(range(n + 1))
        assert all(tuple(full[a:]) < tuple(full[b:]) for a, b in zip(order[:200], order[1:201]))
        index = FMIndex(s, alphabet)
        for size in (1, 2, 5):
            phrases = np.array([s[k:k + size] for k in range(max(0, n - size))][:50] + [rng.integers(1, alphabet, size)])
            lo, hi = index.search(phrases, np.full(len(phrases), size))
            for p, a, b in zip(phrases, lo, hi):
                want = [k for k in range(n - size + 1) if (s[k:k + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want

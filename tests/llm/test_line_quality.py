import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np

from evenkeel.llm import line_quality as q
from evenkeel.llm.common import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for k, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def counts(text):
    text = text or ""
    n, chars, symbols, repeated = q.base_counts(text)
    return n, chars, symbols, q.line_features(text)[2], repeated


def test_base_counts_agree_with_brute_force(spark, sf, odd_texts):
    texts = [t for _, t in odd_texts] + ["a b c a b c", "a a a a", "x\u00a0y \x1c z\x85", "# b\n# b\n \n"]
    texts += [r["text"] for r in table(spark, sf, "documents").collect()]
    for t in texts:
        assert counts(t) == brute(t)


def test_viterbi_finds_the_best_path_of_all():
    rng = np.random.default_rng(1)
    model = q.LineCrf(rng.normal(size=len(q.FEATURES)), rng.normal(size=(2, 2)))
    seqs = [rng.normal(size=(n, len(q.FEATURES))) for n in (1, 2, 5, 8, 1, 7)]
    for x, got in zip(seqs, model.label(seqs)):
        gain = x @ model.weights
        best = max(itertools.product((0, 1), repeat=len(x)),
                   key=lambda y: sum(g for g, v in zip(gain, y) if v) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got.astype(int)) == best


def test_rare_bad_lines_do_not_cost_a_good_document_its_place(spark, sf):
    docs, labels = table(spark, sf.replace("0.001", "0.01"), "documents"), table(spark, sf.replace("0.001", "0.01"), "labels")
    model = q.train(docs, labels)
    found = q.judge(docs, model).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").collect()
    good = [r for r in found if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in found if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad)


def test_odd_documents_and_empty_tables(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)                       # nothing to learn from: every line is content
    assert not model.weights.any()
    found = q.judge(docs, model).select("row.doc_id", "n_words", "kept", "base_failed").collect()
    assert len(found) == len(odd_texts)
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)
    assert q.keep_good(docs, model).columns == docs.columns
    assert q.judge(docs_of([]), model).count() == 0
    labelled = spark.createDataFrame([(9, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert np.isfinite(q.train(docs, labelled).weights).all()


def test_one_long_document_does_not_pad_the_others():
    rng = np.random.default_rng(2)
    docs = [(rng.normal(size=(n, len(q.FEATURES))), k % 2) for k, n in enumerate([20_000] + [3] * 255)]
    model = q.LineCrf(rng.normal(size=len(q.FEATURES)), rng.normal(size=(2, 2)))
    for run in (lambda: model.label([x for x, _ in docs]), lambda: q.fit_crf(docs, rounds=1)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10_000_000                     # padded to the longest: 256 x 20,000 lines, 41 MB of doubles at least


def test_gradients_summed_in_tasks_give_the_same_model(spark, docs_of):
    rows = [(k, "\n".join(f"line {j} of words, that end." if (j + k) % 3 else "## !! || 12" for j in range(2 + k % 7))) for k in range(40)]
    rows += [(3, rows[3][1]), (40, None), (41, "\n" * 3000)]
    labels = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(42)], "doc_id long, quality int")
    here, spread = (q.train(docs_of(rows), labels, fit_lines=n, rounds=5) for n in (10 ** 6, 0))
    assert here.weights.any() and np.allclose(here.weights, spread.weights) and np.allclose(here.moves, spread.moves)


def test_the_chain_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    docs = [(rng.normal(size=(n, len(q.FEATURES))), k % 2) for k, n in enumerate((1, 4, 6, 3))]
    first, p = rng.normal(size=len(q.FEATURES)), rng.normal(size=len(q.FEATURES) + 4)

    def likelihood(p):
        out, moves = 0.0, p[-4:].reshape(2, 2)
        for x, y in docs:
            score = lambda z: sum(g for g, v in zip(x @ p[:-4], z) if v) + sum(moves[a, b] for a, b in zip(z, z[1:]))
            seen = [1] * len(x) if y else (x @ first > 0).astype(int).tolist()
            out += score(seen) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=len(x))])
        return out

    step = 1e-5 * np.eye(len(p))
    assert np.allclose(q.chain_gradient(docs, p, first), [(likelihood(p + e) - likelihood(p - e)) / 2e-5 for e in step], atol=1e-6)

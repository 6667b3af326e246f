from collections import defaultdict

from pyspark.sql import functions as F

from evenkeel.llm import line_dedup as d


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(d.BLANK))


def brute(rows, min_docs, first=False):
    docs = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            docs[key(line)].add(r)
    out = {}
    for r in rows:
        kept = []
        for line in (r[1] or "").split("\n"):
            if not key(line) or len(docs[key(line)]) < min_docs:
                kept.append(line)
        out[r] = None if r[1] is None else "\n".join(kept)
    return out


def rows_of():
    rows = [(k, f"Shared LINE \nown {k}\n\n  shared line\nÉtÉ {k % 3}") for k in range(12)]
    return rows + [(None, "shared line"), (50, None), (51, ""), (52, "SHARED line"), (52, "SHARED line"), (53, "\n".join(["shared line"] * 500 + ["x"]))]


def test_shared_lines_go_everywhere(docs_of):
    rows = rows_of()
    docs = docs_of(rows)
    got = d.drop_shared_lines(docs, min_docs=10)
    assert got.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = brute(rows, 10)
    assert sorted(found, key=str) == sorted([(r[0], want[r]) for r in rows], key=str)


def test_the_first_occurrence_may_stay(docs_of):
    rows = [(k, f"passage\nown {k}") for k in range(20)]
    texts = [r["text"] for r in d.drop_shared_lines(docs_of(rows), min_docs=10, keep="first").orderBy("doc_id").collect()]
    assert texts[0] == "passage\nown 0" and texts[1:] == [f"own {k}" for k in range(1, 20)]


def test_bitmaps_are_sparse_and_exact(docs_of):
    rows = [(k, "\n".join(["a"] + [f"{k} {j}" for j in range(200)] + ["b"])) for k in range(10)]
    maps = d.keep_bitmaps(docs_of(rows), min_docs=10).collect()
    assert len(maps) == 10
    for m in maps:
        words = {w["word"]: w["bits"] for w in m["dropped"]}
        assert words == {0: 1, 3: 1 << (201 - 192)}           # only the words that drop a line


def test_empty_and_odd_tables(docs_of, odd_texts):
    assert d.drop_shared_lines(docs_of([])).count() == 0
    assert d.drop_shared_lines(docs_of(odd_texts), min_docs=2).count() == len(odd_texts)
    n = d.drop_shared_lines(docs_of([(1, "a\nb")] * 30).withColumn("n_chars", F.lit(3)), n_chars="n_chars")
    assert {(r["text"], r["n_chars"]) for r in n.collect()} == {("a\nb", 3)}       # repeated rows are one document


def test_time_grows_with_the_lines_of_a_long_document(spark):
    """Ten documents with the same lines, all shared: twice the lines take at most two and a half times as long."""
    import time

    took = {}
    for n in (100_000, 200_000):
        body = "\n".join(f"line {k} here" for k in range(n))
        docs = spark.createDataFrame([(k, body) for k in range(10)], "doc_id long, text string")
        start = time.time()
        got = d.drop_shared_lines(docs, min_docs=10, keep="first").agg({"doc_id": "count"}).first()
        lengths = sorted(len(r["text"]) for r in d.drop_shared_lines(docs, min_docs=10, keep="first").collect())
        took[n] = time.time() - start
        assert got[0] == 10 and lengths == [0] * 9 + [len(body)]
    assert took[200_000] < 2.5 * max(took[100_000], 4.0)

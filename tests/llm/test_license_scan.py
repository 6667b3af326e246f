import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from evenkeel.llm import license_scan as ls

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, out = words(text), []
    for phrase, label in ls.PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(w)) if w[k:k + len(p)] == p]
    at = [k for k, _ in out]
    return len(w), len(out), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in out}))


def distance_inside(text, notice):
    """Least edits between the notice and any stretch of the text (a full table, column by column)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for k, d in enumerate(notice, 1):
            diagonal, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diagonal + (c != d))
        best = min(best, row[-1])
    return best


def edits_of(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for k, d in enumerate(b, 1):
            diagonal, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diagonal + (c != d))
    return row[-1]


def damaged(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.pop(k), lambda: out.insert(k, rng.choice("xyz q")), lambda: out.__setitem__(k, rng.choice("xyz "))])()
    return "".join(out)


SEARCH = ls.NoticeSearch()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9))
def test_found_if_and_only_if_within_the_edits(seed):
    """One notice at a time, so that no other takes its place, against the full table of edits."""
    rng = random.Random(seed)
    n = rng.randrange(len(ls.NOTICES))
    only = ls.NoticeSearch([ls.NOTICES[n]])
    notice, k = only.notices[0][1], only.errors[0]
    text = " ".join(words("in the wood " + damaged(rng, notice, rng.randrange(2 * k + 2)) + " lies under cc by the license"))
    hits = only.find(text)
    assert bool(hits) == (distance_inside(text, notice) <= k)
    for a, b, _, edits in hits:
        assert edits_of(text[a:b], notice) <= edits <= k


def test_every_repetition_is_found_and_the_best_notice_wins():
    text = " and ".join(["licensed under cc by nc 4 0"] * 50)
    hits = SEARCH.find(text)
    assert len(hits) == 50 and {SEARCH.notices[h[2]][0] for h in hits} == {"cc-by-nc"} and all(h[3] == 0 for h in hits)
    assert [SEARCH.notices[h[2]][0] for h in SEARCH.find("licensed under the gnu lesser general public license")] == ["lgpl"]


def test_odd_texts(spark, docs_of, odd_texts):
    more = [(21, "the MIT  License, mit-license! MIT license mit license"), (22, "GNU General Public License"), (23, "mitlicense"),
            (24, "Relesed under the MTI Licence."), (25, "mit license " * 20_000), (26, "Licensed under CC BY-NC 4.0."), (27, "İ MIT LICENSE ﬁ")]
    got = {}
    for r in ls.scan_licenses(docs_of(odd_texts + more)).collect():
        got.setdefault((r["row"]["doc_id"], r["n_words"]), []).append(r)
    for d, t in odd_texts + more:
        r = got[d, base(t)[0]][0]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t)
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert all(t[s["start"]:s["end"]].strip() == t[s["start"]:s["end"]] != "" for s in r["found"])
    assert sum(map(len, got.values())) == len(odd_texts + more)
    fuzzy = got[24, 5][0]
    assert fuzzy["labels"] == "" or fuzzy["labels"] == "mit"
    nc = got[26, 7][0]
    assert nc["labels"] == "cc-by-nc" and nc["score"] == 1.0 and [(s["start"], s["end"]) for s in nc["found"]] == [(0, 27)]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["row"]["doc_id"]: r for r in ls.scan_licenses(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        r, whole = got[d], " ".join(words(t))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t)
        if "licen" in whole or r["found"]:
            near = {label for (label, n), k in zip(SEARCH.notices, SEARCH.errors) for part in re.findall(".{0,80}licen.{0,80}", whole) or [whole[:400]]
                    if distance_inside(part, n) <= k}
            assert {s["label"] for s in r["found"]} <= near and bool(r["found"]) == bool(near)


def test_empty_table_and_no_notice(spark, docs_of):
    assert ls.scan_licenses(docs_of([(1, "x")]).where("doc_id = 2")).collect() == []
    [r] = ls.scan_licenses(docs_of([(1, "under the MIT license")]), notices=[]).collect()
    assert (r["labels"], r["score"], r["found"]) == ("mit", 1.0, [])
    with pytest.raises(ValueError):
        ls.NoticeSearch([("x", "...")])

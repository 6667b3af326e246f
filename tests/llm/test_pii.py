import random
import re

from pyspark.sql import functions as F

from evenkeel.llm import pii
from evenkeel.llm import pii as p
from evenkeel.llm.spans import digest, ordered

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = [c for c in m.group() if c in "0123456789"]
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and p.luhn("".join(digits)))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_spans_agree_with_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1234567890@@..++-- ()_%é\n") for _ in range(rng.randint(0, 40)))
        assert sorted(p.base_spans(t)) == brute(t), t
    for t in ("x" * 500_000, "1" * 300_000, "@" * 100_000, "1." * 100_000, "+1" * 100_000, "a@b" * 50_000, "+1" + "(" * 200_000):
        p.base_spans(t)                     # time in proportion to the text


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [(k, f"{word()} please write to a{k}.b@mail{k}.org for help {word()}") for k in range(8)]
    out += [(20, f"{word()} please write to someone@localhost for help {word()}"), (21, f"{word()} {word()} 20240101 {word()}"),
            (22, "call +1 (499) 555-6503 or 10.1.2.3"), (23, "version 2024 of 12 words")]
    return out


def test_contexts_of_seeds_find_unseen_identifiers(docs_of):
    got = {r["doc_id"]: r for r in p.find_personal_data(docs_of(texts())).select("row.doc_id", "found", "n_phone", "n_ip", "n_email", "base_sha256").collect()}
    text = dict(texts())
    assert [(f["kind"], text[20][f["start"]:f["end"]]) for f in got[20]["found"]] == [("like_email", "someone@localhost")]
    assert all(not r["found"] for d, r in got.items() if d != 20)
    assert (got[22]["n_phone"], got[22]["n_ip"]) == (1, 1)
    for d, r in got.items():
        assert r["base_sha256"] == digest(ordered(brute(text[d]), p.KINDS)) and r["n_email"] == sum(k == "email" for k, _, _ in brute(text[d]))


def test_weak_patterns_find_nothing(docs_of):
    rows = texts() + [(k, f"please write to {k}{k} for help") for k in range(100, 110)]     # now most instances are no addresses
    found = p.find_personal_data(docs_of(rows)).select("row.doc_id", "found").collect()
    assert all(not r["found"] for r in found)


def test_odd_documents(docs_of, odd_texts):
    found = p.find_personal_data(docs_of(odd_texts))
    assert found.select("row.doc_id").count() == len(odd_texts)
    assert found.where((F.size("found") > 0) | (F.col("n_email") > 0)).count() == 0
    assert p.find_personal_data(docs_of([])).count() == 0
    spelled = p.find_personal_data(docs_of([(1, "a@b.c 10.0.0.1 a@b.c")])).select(p.spelled_spans("base", "found").alias("s")).first()
    assert spelled["s"] == "email:0:5,ip:6:14,email:15:20"


def test_few_seeds_find_many_identifiers_of_any_form(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    mails = ["john at mail", "john_doe", "@anna", "kim77", "x@intern"]
    calls = ["030 123 456", "(555) 867-5309", "12345", "AB 12 34", "0171-22"]
    rows = [(k, f"{word()} please write to a{k}.b@mail{k}.org for help {word()}") for k in range(4)]
    rows += [(10 + k, f"{word()} please write to {x} for help {word()}") for k, x in enumerate(mails)]
    rows += [(20 + k, f"{word()} ring us on +1 (499) 555-65{k:02} before noon {word()}") for k in range(4)]
    rows += [(30 + k, f"{word()} ring us on {x} before noon {word()}") for k, x in enumerate(calls)]
    rows += [(40 + k, f"{word()} see page on 10.0.0.{k} or {word()}") for k in range(4)]
    rows += [(50 + k, f"{word()} see page on {word()} or {word()}") for k in range(9)] + [(60, "abcde see page on 77 or abcde")]
    found = {r["doc_id"]: r["found"] for r in p.find_personal_data(docs_of(rows)).select("row.doc_id", "found").collect()}
    text = dict(rows)
    got = {d: [(f["kind"], text[d][f["start"]:f["end"]]) for f in fs] for d, fs in found.items() if fs}
    assert got == {**{10 + k: [("like_email", x)] for k, x in enumerate(mails)}, **{30 + k: [("like_phone", x)] for k, x in enumerate(calls)}}


def plain_bootstrap(edges, most, rounds, min_seeds, min_score):
    """score_patterns with dictionaries."""
    cells = {}
    for p, i, kind, can, n in edges:
        old = cells.get((p, i), (None, 0, 0))
        cells[p, i] = (max(filter(None, (old[0], kind)), default=None), old[1] | can, max(old[2], n))
    seeds = {(i, c[0]): 1.0 for (p, i), c in cells.items() if c[0]}
    known, trust, accepted = {i for i, _ in seeds}, dict(seeds), {}
    for _ in range(rounds):
        accepted = {}
        for p in {p for p, _ in cells}:
            for b, kind in enumerate(pii.KINDS):
                can = {i: trust[i, kind] for (q, i), c in cells.items() if q == p and i is not None and c[1] >> b & 1 and (i, kind) in trust}
                against = sum(c[2] for (q, i), c in cells.items() if q == p and not c[1] >> b & 1)
                total = min(sum(can.values()), most.get((p, kind), 0))
                if can and total + against and total / (total + against) >= min_score and sum(t >= min_score for t in can.values()) >= min_seeds:
                    accepted[p, kind] = total / (total + against)
        wrong = {}
        for (p, i), c in cells.items():
            for b, kind in enumerate(pii.KINDS):
                if c[0] is None and i is not None and (p, kind) in accepted and c[1] >> b & 1 and i not in known:
                    wrong[i, kind] = wrong.get((i, kind), 1.0) * (1 - 0.9 * accepted[p, kind])
        trust = seeds | {k: 1 - w for k, w in wrong.items()}
    return accepted


def test_scores_equal_a_plain_bootstrap(spark):
    rng = random.Random(4)
    edges = []
    for k in range(400):
        j = rng.randrange(25)
        i = rng.randrange(15) * 4 + (j % 4 if rng.random() < 0.9 else rng.randrange(4))     # mostly of the pattern's kind
        kind = pii.KINDS[i % 4] if i < 25 else None
        edges.append((f"p{j} x _", f"i{i}", kind, 1 << i % 4 if kind else rng.choice([1, 14, 15]), 1))
    edges += [(f"p{k} x _", None, None, 0, rng.randrange(1, 4)) for k in range(0, 25, 3)]
    most = {(f"p{k} x _", kind): rng.randrange(2, 20) for k in range(25) for kind in pii.KINDS}
    for rounds in (1, 3):
        want = plain_bootstrap(edges, most, rounds, 2, 0.6)
        got = {(r["pattern"], r["kind"]): r["score"] for r in pii.score_patterns(
            spark.createDataFrame(edges, "pattern string, instance string, kind string, fits int, n long"), rounds, 2, 0.6,
            spark.createDataFrame([(*k, n) for k, n in most.items()], "pattern string, kind string, most long")).collect()}
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_early_refutation_changes_nothing(spark, sf, docs_of):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = []
    for k in range(400):
        said = " ".join(rng.choices(words, k=30))
        if k % 4 == 0:
            said += f" please write to user{k}@mail{k % 7}.example.org about it "
        if k % 9 == 0:
            said += f" please write to nick_{k} at home{k} about it "
        if k % 5 == 0:
            said = f"{words[k % 3]} {words[k % 4]} +49 30 {1000000 + k} " + said
        rows.append((k, said))
    for docs in (docs_of(rows), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        answers = [sorted((r["doc_id"], str(r["found"])) for r in pii.find_personal_data(docs, early=e).select("row.doc_id", "found").collect())
                   for e in (True, False)]
        assert answers[0] == answers[1]



def test_a_task_holds_no_more_plain_words_than_it_takes_to_refute():
    found = pii.Standing({"call me _": 0, "reach him _": 1}, {"call me _": 2, "reach him _": 2})
    for k in range(1000):
        found.add(f"call me word{chr(97 + k % 26)}{'x' * (k % 40)} now and reach him a{k}@here")
    rows = list(found.rows())
    assert (0, None, -1, None) in rows and not found.plain.get("call me _") and "call me _" not in found.find.patterns
    assert sum(r[0] == 0 for r in rows) == 1

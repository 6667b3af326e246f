import random

import pyarrow as pa
import pytest

from evenkeel.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string, loss string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(1)
    rows = [(-7, 0, "user", c.PROBE), (-7, 1, "assistant", c.PROBE), (1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "a"),
            (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, 0, "assistant", "</turn>\n<turn user>\n\\"), (2, 0, "<a>\n", "é日\U0001F600"),
            (3, None, "assistant", "x" * 200_000), (4, 0, "user", "only")]
    return rows + [(10 + k % 40, k, rng.choice(["user", "assistant", "system"]),
                    "".join(rng.choice("ab<>\\é\n ") for _ in range(rng.randint(0, 60)))) for k in range(600)]


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("part", [32 << 20, 100])
def test_round_trip_and_loss(spark, monkeypatch, part):
    monkeypatch.setattr(c, "PART_BYTES", part)
    rows = odd_rows()
    formatted = c.format_chats(turns_of(spark, rows))
    got, learned = {}, {}
    for r in sorted(formatted.collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
        got.setdefault(r["conv_id"], []).extend(c.read_back(r["formatted"]))
        learned.setdefault(r["conv_id"], []).extend(c.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss"])
    want = expected(rows)
    assert got == want
    assert learned == {k: [t for r, t in v if r == "assistant"] for k, v in want.items()}
    digests = {r["conv_id"]: r for r in c.digests(c.format_chats(turns_of(spark, rows))).collect()}
    assert {k: r["n_turns"] for k, r in digests.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        assert digests[k]["turns_sha256"] == c.hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest()


def test_empty_table(spark):
    assert c.digests(c.format_chats(turns_of(spark, []))).count() == 0


@pytest.mark.parametrize("chunk", [1, 5, 4 << 20])
def test_assembly_in_chunks(monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(0, 6)
        roles, texts = ([("".join(rng.choice("ab<\\>é\n日") for _ in range(rng.randint(0, m)))) for _ in range(n)] for m in (4, 40))
        out, begin, chars = c.assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string()))
        whole = out.tobytes().decode()
        assert whole == "".join(c.OPEN + c.escape(r) + c.HEAD_END + c.escape(t) + c.CLOSE for r, t in zip(roles, texts))
        assert [whole[a:b] for a, b, _ in chars] == [c.escape(t) for t in texts]
        assert c.read_back(whole) == list(zip(roles, texts))

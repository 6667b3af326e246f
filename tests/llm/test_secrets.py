import base64
import json
import random
import re
import string

from evenkeel.llm import secrets as s
from evenkeel.llm.spans import digest, ordered, spelled

PLAIN = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
ENOUGH = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}
RANDOM = "kX9vQ2mZ8tR4wL7pB3nH6yJ1"


def brute(text):
    return sorted((k, m.start(), m.end()) for k, x in PLAIN for m in re.finditer(x, text or "") if ENOUGH[k](m))


def test_base_spans_agree_with_the_plain_patterns():
    rng = random.Random(1)
    bits = ["token", "Secret", "API_key", "apikey", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJ0", "0123456789abcdef", "xyz", "ſecret", "toKen", "abcdef", "PASSWD"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert sorted(s.base_spans(t)) == brute(t), t
    for t in ("a" * 500_000, "token " * 50_000, "token" + " " * 300_000, "AKIA" * 100_000):
        list(s.candidates(t, s.base_spans(t)))


def rows():
    plain = [(k, f"the secret parameter_name_of_user_2 and token parameter_name_of_user_{k % 3} stay in config_file_path") for k in range(60)]
    return plain + [(100, f"our secret is {RANDOM} keep it"), (101, f"{RANDOM} is no such word"), (102, 'token = "0123456789abcdef0123456789"')]


def test_novel_strings_near_sensitive_words_are_reported(docs_of):
    docs = docs_of(rows())
    got = {r["doc_id"]: r for r in s.find_secrets(docs, s.train_dictionary(docs)).select("row.doc_id", "row.text", "found", "base_sha256", "spans", "n_hex", "n_assign").collect()}
    assert [got[100]["text"][f["start"]:f["end"]] for f in got[100]["found"]] == [RANDOM]
    assert all(not r["found"] for d, r in got.items() if d != 100)
    for r in got.values():
        assert r["base_sha256"] == digest(ordered(brute(r["text"]), s.KINDS))
    assert got[102]["spans"] == spelled(ordered(brute(got[102]["text"]), s.KINDS)) and got[102]["n_hex"] == 1
    assert got[100]["spans"] == f"novel:14:{14 + len(RANDOM)}"


def test_odd_documents(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    assert s.train_dictionary(docs) == b""
    found = s.find_secrets(docs, b"").select("found", "n_assign", "n_access").collect()
    assert len(found) == len(odd_texts) and not any(r["found"] or r["n_assign"] or r["n_access"] for r in found)
    assert s.find_secrets(docs_of([]), b"").count() == 0


def test_random_strings_are_reported_whatever_their_alphabet_and_length(docs_of):
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(1500)]
    names = ["_".join(rng.sample(words, 3)) + f"_v{k % 10}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    draw = lambda letters, n: "a7" + "".join(rng.choices(letters, k=n - 2))
    url64 = lambda data: base64.urlsafe_b64encode(data).decode().rstrip("=")

    def jwt():
        body = json.dumps({"sub": draw(string.digits, 10), "name": prose(2), "iat": rng.randint(10 ** 9, 2 * 10 ** 9)}).encode()
        return ".".join((url64(b'{"alg":"HS256","typ":"JWT"}'), url64(body), url64(rng.randbytes(32))))

    kinds = {f"{name} {n}": [draw(letters, n) for _ in range(30)]
             for name, letters, sizes in (("base36", string.ascii_lowercase + string.digits, (16, 24, 64, 256, 800)),
                                          ("hex", "0123456789abcdef", (16, 20, 23)),
                                          ("base64", string.ascii_letters + string.digits + "+/", (16, 24, 64, 256, 400, 1600)))
             for n in sizes} | {"jwt": [jwt() for _ in range(30)]}
    plain = [f"{prose(20)} token {rng.choice(names)} {prose(20)}" for _ in range(900)]
    planted = [(kind, x, f"{prose(20)} secret {x} {prose(20)}") for kind, of in kinds.items() for x in of]
    dictionary = s.train_dictionary(docs_of(list(enumerate(plain))))
    rows = [(k, t) for k, t in enumerate([t for _, _, t in planted] + plain[:300])]
    for given in (dictionary, b""):
        got = {r["doc_id"]: r["found"] for r in s.find_secrets(docs_of(rows), given).select("row.doc_id", "found").collect()}
        for kind, of in kinds.items():
            hit = [any(f["start"] == t.index(x) for f in got[k]) for k, (name, x, t) in enumerate(planted) if name == kind]
            assert sum(hit) >= 0.8 * len(of), (kind, sum(hit), bool(given))
    found = {r["doc_id"]: r["found"] for r in s.find_secrets(docs_of(rows), dictionary).select("row.doc_id", "found").collect()}
    assert not any(found[k] for k in range(len(planted), len(rows)))          # the corpus's own names


def test_copied_secrets_are_reported_in_every_copy_and_of_any_characters(docs_of):
    rng = random.Random(5)
    letters = "".join(rng.choices(string.ascii_lowercase, k=30))
    digits = "".join(rng.choices(string.digits, k=20))
    dashed = "-".join("".join(rng.choices("0123456789abcdefxyz", k=8)) for _ in range(4))
    planted = {1: [f"{RANDOM}"], 3: [letters, dashed], 50: [digits, RANDOM[::-1]]}
    texts, k = rows(), 1000
    for copies, secrets in planted.items():
        for secret in secrets:
            texts += [(k + j, f"our secret is {secret} and so on {j}") for j in range(copies)]
            k += copies
    docs = docs_of(texts)
    got = {r["doc_id"]: [r["text"][f["start"]:f["end"]] for f in r["found"]]
           for r in s.find_secrets(docs, s.train_dictionary(docs)).select("row.doc_id", "row.text", "found").collect()}
    k = 1000
    for copies, secrets in planted.items():
        for secret in secrets:
            assert all(got[k + j] == [secret] for j in range(copies)), secret
            k += copies
    assert not any(got[d] for d in range(60))


def test_novelty_equals_a_direct_recomputation(docs_of):
    """Marginal sizes by plain compressions of the three texts, without and with a dictionary."""
    import zstandard

    primed = s.train_dictionary(docs_of(rows()))
    for data in (b"", primed):
        given = zstandard.ZstdCompressionDict(data) if data else None
        def size(t):  # noqa: E306
            return len(zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_dict_id=False).compress(t.encode()))
        text = f"a token, then {RANDOM} and the rest"
        a, b = text.index("kX9"), text.index("kX9") + len(RANDOM)
        draw = random.Random(RANDOM.encode())
        letters = s.alphabet(RANDOM).encode()
        likes = [bytes(draw.choices(letters, k=len(RANDOM))).decode() for _ in range(s.DRAWS)]
        rest = size(text[:a] + text[b:])
        want = (size(text) - rest) * s.DRAWS / sum(size(text[:a] + x + text[b:]) - rest for x in likes)
        pack = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_dict_id=False)
        assert abs(s.novelty(pack, text, a, b) - want) < 1e-12

"""Secrets in texts: fixed patterns, and strings near a sensitive word that a primed compressor finds nothing old in."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import append_columns, map_rows, query, table
from evenkeel.llm.spans import Covered, digest, ordered, spelled
from evenkeel.session import cut_lineage

KINDS = ["assign", "access", "hex"]
NEAR = 48                       # code points before a candidate in which the sensitive word must stand
AROUND = 200                    # code points of surrounding text on each side that prime the compressor
MIN_CHARS = 16
MIN_NOVELTY = 0.8              # marginal compressed bytes, as a share of what a random string of the same characters adds
DRAWS = 3                       # random strings a candidate is compared with; one if it is long
LONG = 256
DICTIONARY_BYTES = 32_768
SAMPLE_TEXTS = 2000             # contexts that the dictionary's entropy tables are trained on
IDENTIFIERS = 4000              # most frequent identifiers in the dictionary
MIN_USES = 3                    # of an identifier in the dictionary

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api_?key|credential|bearer|auth|private[ _]key|access[ _]key", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CHARS)
DIGIT = re.compile(r"[0-9]")
JOINT = re.compile(r"[_./=+-]+")
NAME = re.compile(r"[a-z]{1,12}(?:[A-Z][a-z]{2,11})*|(?:[A-Z][a-z]{2,11})+|[A-Z]{1,12}|[A-Za-z]{0,4}[0-9]{1,3}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its test is dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def named(run: str) -> bool:
    """Whether a string is put together as names are: of words of up to twelve letters and short numbers. Only such
    strings may stand in the dictionary, however often others are copied, so that no secret primes its own measure."""
    return all(NAME.fullmatch(part) for part in JOINT.split(run) if part)


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Long strings without a blank soon after a sensitive word that meet no base span."""
    covered, done = Covered((a, b) for _, a, b in base), 0
    for word in SENSITIVE.finditer(text):
        at = max(done, word.end())
        while m := RUN.search(text, at, word.end() + NEAR + MIN_CHARS):     # begins near enough; may go on far beyond
            a, b = RUN.match(text, m.start()).span()
            at = done = b
            if not covered.meets(a, b):
                yield a, b


def alphabet(own: str) -> str:
    """The characters a random string like this one is drawn from: whole classes of letters (those of hexadecimal digits,
    if no other occurs) and digits, and the signs it has."""
    out = ""
    for hexadecimal, whole in (("abcdef", "abcdefghijklmnopqrstuvwxyz"), ("ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        has = set(own) & set(whole)
        out += "" if not has else hexadecimal if has <= set(hexadecimal) else whole
    return out + ("0123456789" if DIGIT.search(own) else "") + "".join(sorted(c for c in set(own) if not c.isalnum()))


def novelty(pack: zstandard.ZstdCompressor, text: str, a: int, b: int, least: float = 0.0) -> float:
    """Compressed bytes the candidate adds to its surroundings, as a share of what random strings of its length and
    characters add in the same place. 0 if it adds less than `least` of their entropy, which they cannot fall below."""
    before, own, after = (t.encode("utf-8", "surrogatepass") for t in (text[max(0, a - AROUND):a], text[a:b], text[b:b + AROUND]))
    rest = len(pack.compress(before + after))
    added = len(pack.compress(before + own + after)) - rest
    letters = alphabet(text[a:b]).encode()
    if added < least * 0.9 * len(own) * math.log2(len(letters)) / 8:
        return 0.0
    draw = random.Random(own)
    draws = DRAWS if len(own) < LONG else 1
    like = sum(len(pack.compress(before + bytes(draw.choices(letters, k=len(own))) + after)) - rest for _ in range(draws))
    return added * draws / max(like, 1)


def sensitive_contexts(docs: DataFrame, text: str) -> DataFrame:
    """(context): the surroundings of every sensitive word of every text; whatever may be a secret is blank."""
    def work(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            if not t:
                continue
            spans, last = Covered((a, b) for _, a, b in base_spans(t)), 0
            for m in SENSITIVE.finditer(t):
                if m.start() >= last:
                    last = m.end() + AROUND
                    part = t[max(0, m.start() - AROUND):last]
                    shift = max(0, m.start() - AROUND)
                    out.append((RUN.sub(lambda r: r.group() if named(r.group()) and not spans.meets(shift + r.start(), shift + r.end())
                                        else " ", part),))
        return out

    return map_rows(docs.select(text), work, "context string")


def train_dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS,
                     identifiers: int = IDENTIFIERS) -> bytes:
    """A zstandard dictionary of the corpus's own code: its most frequent identifiers and its contexts.

    Identifiers are counted over the contexts of all sensitive words in all documents; the most frequent, of at least
    MIN_USES uses, go into the dictionary, its bounded size being a parameter. Strings that are not put together as names
    are never counted, nor stand in a sample: a secret must not prime its own measure, however often it is copied. Entropy
    tables come from a bounded sample of contexts (those of the least hash). Contexts are written once. Without contexts the dictionary is empty and every candidate is measured on its own text.
    """
    found = cut_lineage(sensitive_contexts(docs, text))
    words = map_rows(found, lambda rows: [(w,) for c in rows for w in IDENTIFIER.findall(c) if named(w)], "word string")
    top = words.groupBy("word").count().where(F.col("count") >= MIN_USES).orderBy(F.desc("count"), "word").limit(identifiers).collect()
    sample = [r["context"].encode("utf-8", "surrogatepass") for r in found.groupBy("context").count().orderBy(
        F.xxhash64("context"), "context").limit(sample_texts).collect()]
    common = " ".join(r["word"] for r in reversed(top)).encode()
    try:
        tail = common[-(size // 2):]                # the trainer leaves out what its samples hold once: it goes behind
        trained = zstandard.train_dictionary(size - len(tail), [*sample, *[common[k:k + 400] for k in range(0, len(common), 400)]])
        return trained.as_bytes() + tail
    except zstandard.ZstdError:                    # too few contexts to learn entropy tables from
        return common[-size:]


FOUND = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
         "found array<struct<start:long,end:long,novelty:double>>")


def find_secrets(docs: DataFrame, dictionary: bytes, text: str = "text", min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """(row, n_assign, n_access, n_hex, base_sha256, spans, found): every row of docs.

    Base matches are counted and digested; `found` holds strings of at least 16 characters without a blank, of whatever
    characters, within 48 characters after a sensitive word, that meet no base match and whose marginal compressed size,
    against their surroundings and the dictionary, is at least min_novelty of that of random strings of the same length
    and characters there, so that neither a small alphabet nor length hides a secret. spans names them `novel`
    beside the base spans. Offsets are code points, end exclusive. NULL and empty texts have none, repeated rows get
    the same answer, an empty table gives an empty result; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def work(texts: list) -> list[tuple]:
        given = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_dict_id=False)
        out = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            new = [{"start": a, "end": b, "novelty": n} for a, b in candidates(t, base)
                   if (n := novelty(pack, t, a, b, min_novelty)) >= min_novelty]
            every = ordered(base + [("novel", s["start"], s["end"]) for s in new], KINDS)
            out.append((*[sum(k == kind for k, _, _ in base) for kind in KINDS], digest(ordered(base, KINDS)),
                        spelled(every), new))
        return out

    return append_columns(docs, text, work, FOUND)


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_dictionary(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")

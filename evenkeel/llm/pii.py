"""Personal data: fixed patterns, and identifiers found by the contexts that the fixed patterns' matches stand in."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.llm.common import append_columns, map_rows, query, table, to_batch
from evenkeel.llm.spans import Covered, digest, ordered
from evenkeel.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3                      # of scoring patterns by instances and instances by patterns
MIN_SEEDS = 3                   # distinct trusted instances a pattern needs
MIN_SCORE = 0.8                 # trusted against contradicting instances of a pattern, and trust an instance needs
MAX_WORDS = 4                   # of an unseen identifier
FIRST_PART = 16                 # one text in so many is looked at first, to refute the common patterns early

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
SPOKEN = re.compile(r"\S +(?:at|\(at\)|\[at\]) +\S", re.I)
TRIM = ".,;:!?\"'()[]{}<>#*$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its test is dropped, with no second try.

    A mail address has one @, and what may stand before it is one run of characters, so that it is found from the @
    backwards; an ip begins where a run of digits begins. Both cost time in proportion to the text, whatever it is.
    """
    out = []
    done = 0
    for m in AT.finditer(text) if "@" in text else ():
        a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append(("email", a, m.end()))
            done = m.end()
    if MARK.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@lru_cache(100_000)
def _plain(word: str) -> str:
    return DIGIT.sub("0", word.lower().strip(TRIM))


def contexts(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around a slot: two words before, one on each side, two words after."""
    left = [_plain(w) for w in WORD.findall(text[max(0, a - 80):a])[-2:]]
    right = [_plain(w) for w in WORD.findall(text[b:b + 80])[:2]]
    out = []
    if len(left) == 2 and any(left):
        out.append(f"{left[0]} {left[1]} _")
    if left and right and left[-1] and right[0]:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2 and any(right):
        out.append(f"_ {right[0]} {right[1]}")
    return out


@lru_cache(100_000)
def fits(s: str) -> int:
    """The kinds (as bits) that an unseen identifier may be of; 0 for plain words."""
    digit = bool(DIGIT.search(s))
    named = "@" in s or "_" in s or bool(SPOKEN.search(s)) or (digit and any(map(str.isalpha, s)))
    return int(named) | (0b1110 if digit and "@" not in s else 0)


def seeds_and_marked(text: str) -> list[tuple]:
    """(pattern, instance, kind or NULL, fits): base matches as seeds, and other words with a digit or @, in their contexts."""
    if not MARK.search(text):
        return []
    base = base_spans(text)
    covered = Covered((a, b) for _, a, b in base)
    slots = [(a, b, kind, 1 << KINDS.index(kind)) for kind, a, b in base]
    for m in WORD.finditer(text):
        if MARK.search(m.group()) and not covered.meets(m.start(), m.end()):
            a, b = _bare(text, m.start(), m.end())
            slots.append((a, b, None, fits(text[a:b])))
    return [(p, text[a:b].lower(), kind, can) for a, b, kind, can in slots for p in contexts(text, a, b)]


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation around it; a bracket that is closed inside stays."""
    while a < b and text[a] in TRIM and not (text[a] == "(" and ")" in text[a:b]):
        a += 1
    while a < b and text[b - 1] in TRIM and not (text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


class Stretches:
    """Finds what stands in given patterns: between the words of two sides up to MAX_WORDS words, beside a one-sided
    context a word, and on from it the words with digits."""

    def __init__(self, patterns):
        self.patterns = set(patterns)
        self.number = {p: k for k, p in enumerate(sorted(self.patterns))}
        sides = [p.split(" ") for p in self.patterns]
        self.before = {(x, y) for x, y, z in sides if z == "_"}
        self.around = {(x, z) for x, y, z in sides if y == "_"}
        self.after = {(y, z) for x, y, z in sides if x == "_"}
        self.left = Counter(x for x, _ in self.around)

    def drop(self, pattern: str) -> None:
        """Look for it no more."""
        x, y, z = pattern.split(" ")
        self.patterns.discard(pattern)
        if y != "_":
            (self.before if z == "_" else self.after).discard((x, y) if z == "_" else (y, z))
        elif (x, z) in self.around:
            self.around.discard((x, z))
            self.left[x] -= 1
            if not self.left[x]:
                del self.left[x]

    def of(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str]]]:
        """(start, end, patterns) of every stretch that meets no base span."""
        if not self.patterns:
            return []
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        plain = [_plain(text[a:b]) for a, b in words]
        pairs = set(zip(plain, plain[1:]))
        if not (not self.left.keys().isdisjoint(plain) or pairs & self.before or pairs & self.after):
            return []
        n, marked = len(words), [bool(DIGIT.search(p)) for p in plain]
        found = set()
        for i in range(n):
            if i and plain[i - 1] in self.left:
                j = next((j for j in range(i + 1, min(i + MAX_WORDS, n - 1) + 1) if (plain[i - 1], plain[j]) in self.around), None)
                if j:
                    found.add((i, j))
            if i > 1 and (plain[i - 2], plain[i - 1]) in self.before:
                j = i + 1
                while marked[i] and j < n and j < i + MAX_WORDS and marked[j]:
                    j += 1
                found.add((i, j))
            if i + 2 < n and (plain[i + 1], plain[i + 2]) in self.after:
                h = i
                while marked[i] and h and i - h + 1 < MAX_WORDS and marked[h - 1]:
                    h -= 1
                found.add((h, i + 1))
        covered, out = Covered((a, b) for _, a, b in base), []
        for i, j in sorted(found):
            a, b = _bare(text, words[i][0], words[j - 1][1])
            if a < b and not covered.meets(a, b) and (here := [p for p in contexts(text, a, b) if p in self.patterns]):
                out.append((a, b, here))
        return out


EDGES = "pattern string, instance string, kind string, fits int"


def reachable(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern): those that could be accepted within the rounds: with min_seeds instances, each a seed or in such a pattern."""
    known, patterns = edges.where("kind IS NOT NULL").select("instance").distinct(), None
    for _ in range(rounds):
        patterns = cut_lineage(edges.where("fits > 0").join(known, "instance").groupBy("pattern").agg(
            F.countDistinct("instance").alias("n")).where(F.col("n") >= min_seeds).select("pattern"))
        known = cut_lineage(edges.where("fits > 0").join(patterns, "pattern").select("instance").unionByName(known).distinct())
    return patterns


def most_trust(edges: DataFrame) -> DataFrame:
    """(pattern, kind, most): how many different words that can be of the kind stand in the pattern."""
    words = edges.groupBy("pattern", "instance").agg(F.bit_or("fits").alias("fits"))
    counts = words.groupBy("pattern").agg(*[F.count_if(F.col("fits").bitwiseAND(F.lit(1 << i)) != 0).alias(k) for i, k in enumerate(KINDS)])
    return counts.select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("most")) for k in KINDS])).alias("x")).select(
        "pattern", "x.kind", "x.most")


class Standing:
    """What stands in patterns, collected over a task's texts; a pattern that is refuted is looked for no more.

    A pattern's trust is bounded by `most` (see score_patterns), so it is refuted for good as soon as it has met
    more than most * (1 - min_score) / min_score different plain words, in whichever texts. Until then that many plain
    words are held at most, and nothing of a refuted pattern leaves the task but its number.
    """

    def __init__(self, patterns: dict[str, int], allowed: dict[str, int]):
        self.find, self.allowed, self.number = Stretches(patterns), allowed, patterns
        self.plain: dict[str, set[int]] = {}
        self.able: dict[str, set[tuple[str, int]]] = {}
        self.refuted: list[str] = []

    def add(self, text: str) -> None:
        for a, b, here in self.find.of(text, base_spans(text)):
            word = text[a:b].lower()
            can = fits(text[a:b])
            for p in here:
                if p not in self.find.patterns:                 # refuted by this very text
                    continue
                if can:
                    self.able.setdefault(p, set()).add((word, can))
                    continue
                met = self.plain.setdefault(p, set())
                met.add(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63))
                if len(met) > self.allowed[p]:
                    self.refuted.append(p)
                    self.find.drop(p)
                    self.plain.pop(p)
                    self.able.pop(p, None)

    def rows(self) -> Iterator[tuple]:
        """(at, instance, fits, plain): instances, hashes of plain words, and -1 for a refuted pattern."""
        for p in self.refuted:
            yield self.number[p], None, -1, None
        for p, words in self.able.items():
            for word, can in words:
                yield self.number[p], word, can, None
        for p, words in self.plain.items():
            for h in words:
                yield self.number[p], None, 0, h


STAND = "at int, instance string, fits int, plain long"


def stand_in(texts: DataFrame, patterns, allowed) -> DataFrame:
    """The rows of Standing for all texts; patterns and allowed are broadcast dictionaries by pattern."""
    arrow = to_arrow_schema(StructType.fromDDL(STAND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Standing(patterns.value, allowed.value)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    found.add(t)
        rows = found.rows()
        while part := list(islice(rows, 20_000)):
            yield to_batch(part, arrow)

    return texts.mapInArrow(run, STAND)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                   min_score: float = MIN_SCORE, most: DataFrame | None = None) -> DataFrame:
    """(pattern, kind, score) of the accepted patterns, from rows (pattern, instance, kind or NULL, fits, n).

    A row without instance stands for n plain words.

    The graph has an edge for each pattern and instance that occur together, whatever how often. A pattern's score for
    a kind is the trust of its instances against that and its contradicting instances (seeds of other kinds, plain
    words, strings that cannot be of the kind); unseen ones that can be are left out. It is accepted with min_score and
    min_seeds trusted instances. A seed's trust in its kind is 1; another instance is trusted as much as one of its
    accepted patterns would have to be wrong together for it not to be one (noisy or, each pattern at nine tenths of
    its score). With `most` (pattern, kind, most) the trust in a pattern adds up to no more than that: several stretches
    of words around one marked word say no more than the word.
    """
    edges = cut_lineage(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"), F.bit_or("fits").alias("fits"), F.max("n").alias("n")))
    seeds = cut_lineage(edges.where("seed IS NOT NULL").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("trust")))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(1 << i).alias("bit")) for i, k in enumerate(KINDS)]))
    against = cut_lineage(edges.select("pattern", "fits", "n", kinds.alias("k")).groupBy("pattern", "k.kind").agg(
        F.sum(F.when(F.col("fits").bitwiseAND(F.col("k.bit")) == 0, F.col("n")).otherwise(0)).alias("against")))
    can = F.lit(False)
    for i, k in enumerate(KINDS):
        can = can | ((F.col("kind") == k) & (F.col("fits").bitwiseAND(F.lit(1 << i)) != 0))
    trust, accepted = seeds, None
    for _ in range(rounds):
        votes = edges.join(trust, "instance").where(can).groupBy("pattern", "kind").agg(
            F.sum("trust").alias("total"), F.sum((F.col("trust") >= min_score).cast("int")).alias("support"))
        if most is not None:
            votes = votes.join(most, ["pattern", "kind"]).withColumn("total", F.least("total", F.col("most").cast("double")))
        accepted = cut_lineage(votes.join(against, ["pattern", "kind"]).withColumn("score", F.col("total") / (F.col("total") + F.col("against")))
                               .where((F.col("score") >= min_score) & (F.col("support") >= min_seeds))
                               .select("pattern", "kind", "score"))
        fresh = (edges.where("seed IS NULL").join(accepted, "pattern").where(can).groupBy("instance", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - 0.9 * F.col("score"))))).alias("trust")))
        known = seeds.select("instance").distinct()
        trust = cut_lineage(seeds.unionByName(fresh.join(known, "instance", "left_anti")))
    return accepted


FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "base array<struct<start:long,kind:string,end:long>>, found array<struct<start:long,kind:string,end:long>>")


def find_personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                       min_score: float = MIN_SCORE, early: bool = True) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base_sha256, base, found): every row of docs.

    base are the matches of the fixed patterns; found are further spans (start, kind, end), kind `like_<kind>`:
    up to four words that stand in an accepted pattern of that kind, can be of it and meet no base span; of those that
    overlap the best scored stays. Offsets are code points, end exclusive. NULL and empty texts have no spans; repeated
    rows get the same answer and count as one instance; with no seeds nothing is learned; empty tables give empty results.

    Texts are scanned for seeds; then for all that stands in the patterns that could be accepted, first in a small part of
    the texts, which refutes the common ones, then in all of them; then for the answer. Refuting needs no more texts
    than it takes and is exact (early=False goes without and gives the same answer). Only patterns and instances are shuffled. The driver and each task hold the patterns that
    three seeds reach, later those not refuted; their number grows with the seeds of the corpus.
    """
    spark = docs.sparkSession
    edges = cut_lineage(map_rows(docs.select(text), lambda texts: [e for t in texts for e in seeds_and_marked(t or "")], EDGES).distinct())
    most = cut_lineage(most_trust(edges).join(reachable(edges, rounds, min_seeds), "pattern"))
    bound = {r["pattern"]: r["most"] for r in most.groupBy("pattern").agg(F.max("most").alias("most")).collect()}
    allowed = {p: math.floor(n * (1 - min_score) / min_score + 1e-9) if early else 1 << 60 for p, n in bound.items()}
    number = {p: k for k, p in enumerate(sorted(allowed))}

    def standing(texts: DataFrame) -> DataFrame:
        return stand_in(texts, spark.sparkContext.broadcast(number), spark.sparkContext.broadcast(allowed))

    accepted: list = []
    if number:
        texts = docs.select(F.col(f"`{text}`").alias("text"))
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(FIRST_PART)) == 0)
        part = part.coalesce(max(1, part.rdd.getNumPartitions() // FIRST_PART))
        gone = {r["at"] for r in standing(part).where("fits < 0").select("at").distinct().collect()}
        number = {p: k for p, k in number.items() if k not in gone}
    if number:
        stand = cut_lineage(standing(texts))
        gone = stand.where("fits < 0").select("at").distinct()
        names = spark.createDataFrame([(k, p) for p, k in number.items()], "at int, pattern string")
        # words with digits alone and as part of a stretch are not two instances: what stands there now counts
        # plain words are told apart by their hash and only counted, a row for each pattern
        stand = (stand.where("fits >= 0").join(gone, "at", "left_anti").distinct()
                 .groupBy("at", "instance", "fits").agg(F.greatest(F.count("plain"), F.lit(1)).alias("n")))
        stand = stand.join(names, "at").select("pattern", "instance", F.lit(None).cast("string").alias("kind"), "fits", "n")
        left = names.join(gone, "at", "left_anti").select("pattern")
        seeds = edges.where("kind IS NOT NULL").join(left, "pattern").select("pattern", "instance", "kind", "fits", F.lit(1).cast("long").alias("n"))
        accepted = score_patterns(seeds.unionByName(stand), rounds, min_seeds, min_score, most).collect()
    scores: dict = {}
    for r in accepted:
        scores.setdefault(r["pattern"], []).append((r["score"], r["kind"]))
    chosen = spark.sparkContext.broadcast((Stretches(scores), scores))

    def work(texts: list) -> list[tuple]:
        stretches, scores = chosen.value
        out = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            spans, found = ordered(base, KINDS), []
            best = []
            for a, b, here in stretches.of(t, base):
                can = fits(t[a:b])
                best += [(-s, a - b, a, b, k) for p in here for s, k in scores[p] if can >> KINDS.index(k) & 1]
            for _, _, a, b, kind in sorted(best):
                if all(b <= f["start"] or f["end"] <= a for f in found):
                    found.append({"start": a, "kind": f"like_{kind}", "end": b})
            out.append((*[sum(k == kind for k, _, _ in base) for kind in KINDS], digest(spans),
                        [{"start": a, "kind": k, "end": b} for a, _, k, b in spans], sorted(found, key=lambda f: f["start"])))
        return out

    return _without_text(append_columns(docs, text, work, FOUND), docs, text)


def _without_text(scanned: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The row without its text."""
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c != text]
    return scanned.withColumn("row", F.struct(*rest) if rest else F.struct(F.lit(0).alias("none")))


def spelled_spans(*columns: str):
    """Span arrays joined by start, then kind as listed, as kind:start:end, comma-joined."""
    keyed = F.transform(F.concat(*columns), lambda s: F.struct(
        s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _rank(kind):
    out = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        out = F.when(kind == name, F.lit(k)).otherwise(out)
    return out


@query("op2_personal_data")
def op2_personal_data(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                        spelled_spans("base", "found").alias("spans"))

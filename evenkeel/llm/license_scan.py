"""License notices in texts, spelled right or nearly so: exact seeds by the pigeonhole principle, bounded-error checks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import ahocorasick
import regex
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import append_columns, query, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
CHARS_PER_ERROR = 12            # one edit is allowed for so many characters of a notice

#: (words, label) looked for exactly, at word borders
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: (label, words of a short notice) looked for with edits
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
]


def words_of(text: str) -> str:
    """The text's words, A-Z lowered, one space between two."""
    return " ".join(WORD.findall(text.translate(LOWER)))


class NoticeSearch:
    """Finds every stretch of a text's words within k edits of a notice, k = characters // CHARS_PER_ERROR.

    A notice is cut into k + 1 parts. k edits leave at least one of them as it is, so every true place holds one
    part exactly, not further than k characters from where it stands in the notice. One automaton finds the parts of all
    notices; around each the regex library looks for the notice with at most k insertions, deletions and
    substitutions. Places that share a seed's reach are checked together, so a repeated notice is found each time.
    """

    def __init__(self, notices: Sequence[tuple[str, str]] = tuple(NOTICES), chars_per_error: int = CHARS_PER_ERROR):
        self.notices = [(label, words_of(words)) for label, words in notices]
        if any(not words for _, words in self.notices):
            raise ValueError("a notice needs a word")
        self.errors = [len(words) // chars_per_error for _, words in self.notices]
        self.checks = [regex.compile(f"(?e)(?:{regex.escape(words)}){{e<={k}}}") for (_, words), k in zip(self.notices, self.errors)]
        parts: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, words), k) in enumerate(zip(self.notices, self.errors)):
            cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                parts.setdefault(words[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for part, places in parts.items():
            self.seeds.add_word(part, (len(part), places))
        if parts:
            self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the stretches, in order and apart, in which it may stand."""
        out: dict[int, list[list[int]]] = {}
        if not self.notices:
            return out
        for end, (size, places) in self.seeds.iter(text):
            for n, offset in places:
                begin, k = end + 1 - size - offset, self.errors[n]
                found = out.setdefault(n, [])
                found.append([max(0, begin - k), begin + len(self.notices[n][1]) + k])
        for n, found in out.items():
            found.sort()
            apart = [found[0]]
            for w in found[1:]:
                if w[0] <= apart[-1][1]:
                    apart[-1][1] = max(apart[-1][1], w[1])
                else:
                    apart.append(w)
            out[n] = apart
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(begin, end, notice, edits) in the words' text, leftmost first; of places that overlap, that with the least edits
        a character, then the longest, leftmost and first notice."""
        hits = []
        for n, stretches in self.windows(text).items():
            for a, b in stretches:
                for m in self.checks[n].finditer(text, a, min(b, len(text))):
                    if m.end() > m.start():
                        hits.append((m.start(), m.end(), n, sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, int, int]] = []
        begins: list[int] = []
        for hit in sorted(hits, key=lambda h: (h[3] / len(self.notices[h[2]][1]), -(h[1] - h[0]), h[0], h[2])):
            at = bisect_right(begins, hit[0])
            if (at and kept[at - 1][1] > hit[0]) or (at < len(kept) and kept[at][0] < hit[1]):
                continue
            kept.insert(at, hit)
            begins.insert(at, hit[0])
        return kept


def phrase_places(text: str, phrases: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of every phrase in the words' text."""
    padded, out = f" {text} ", []
    for phrase, label in phrases:
        wanted, at, words, counted = f" {phrase} ", -1, 0, 0
        while (at := padded.find(wanted, at + 1)) >= 0:
            words += padded.count(" ", counted, at)               # spaces before it are words before it
            counted = at
            out.append((words, label))
    return out


FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "found array<struct<label:string,start:long,end:long,edits:int>>")


def scan_licenses(docs: DataFrame, text: str = "text", notices: Sequence[tuple[str, str]] = tuple(NOTICES),
                  phrases: Sequence[tuple[str, str]] = tuple(PHRASES), chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score, found): every row of docs.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. n_base counts the places of `phrases`,
    first_word and last_word are the least and greatest word they begin at. `found` holds the notices met with at most
    one edit for chars_per_error characters, as whole words in code points of the text (end exclusive) with the edits.
    labels are those of both; score is 1 with a phrase, else the best 1 - edits / characters of a notice, else 0. NULL and empty
    texts have no words; repeated rows get the same answer; an empty table gives an empty result. Work is linear in a
    text's length; nothing is shuffled.
    """
    phrases = [(words_of(p), label) for p, label in phrases]
    notices = tuple(notices)

    def work(texts: list) -> list[tuple]:
        search = _search(notices, chars_per_error)
        out = []
        for t in texts:
            whole = words_of(t or "")
            base = phrase_places(whole, phrases)
            hits = search.find(whole)
            at = [w for w, _ in base]
            spans = []
            if hits:
                marks = [m.span() for m in WORD.finditer(t.translate(LOWER))]      # lowering moves no character
                starts = [0]
                for a, b in marks[:-1]:
                    starts.append(starts[-1] + b - a + 1)
                for a, b, n, edits in hits:
                    # a space at either end belongs to no word
                    first, last = bisect_right(starts, a + (whole[a] == " ")) - 1, bisect_right(starts, b - 1 - (whole[b - 1] == " ")) - 1
                    spans.append({"label": search.notices[n][0], "start": marks[first][0], "end": marks[last][1], "edits": edits})
            best = max((1 - h[3] / len(search.notices[h[2]][1]) for h in hits), default=0.0)
            labels = {x for _, x in base}
            out.append((whole.count(" ") + 1 if whole else 0, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
                        ",".join(sorted(labels | {s["label"] for s in spans})), 1.0 if base else best, spans))
        return out

    return append_columns(docs, text, work, FOUND)


_searches: dict[tuple, NoticeSearch] = {}


def _search(notices: tuple, chars_per_error: int) -> NoticeSearch:
    """One a worker process."""
    if (notices, chars_per_error) not in _searches:
        _searches[notices, chars_per_error] = NoticeSearch(notices, chars_per_error)
    return _searches[notices, chars_per_error]


@query("op13_license_scan")
def op13_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""Spans of text: leftmost matches per kind, their order, their text form."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from evenkeel.llm.common import sha

Span = tuple[int, int, str, int]           # start, rank of the kind, kind, end


def ordered(spans: Iterable[tuple[str, int, int]], kinds: list[str]) -> list[Span]:
    """By start, then by the kind's place in the list; kinds that are not listed come after, by name."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted((a, rank.get(kind, len(kinds)), kind, b) for kind, a, b in spans)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def digest(spans: list[Span]) -> str:
    return sha(spelled(spans))


class Covered:
    """Whether a stretch meets one of the spans."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends, reach = [], [], 0
        for a, b in sorted(spans):
            reach = max(reach, b)
            self.starts.append(a)
            self.ends.append(reach)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

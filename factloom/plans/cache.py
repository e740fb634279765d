"""Results of earlier queries, on the driver: by the query's text, and by the words it shares with another.

A result counts while nothing has been compiled or curated since, and for some
seconds. As tables, the two are ``search.exact_lookup`` and ``search.fuzzy_lookup``.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


def fingerprint(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"[^\W_]+", text.lower()))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


@dataclass
class Exact:
    """By the text alone; the options don't count."""

    seconds: float = 60
    clock: Callable[[], float] = time.monotonic
    _held: dict[str, tuple[Any, int, float]] = field(default_factory=dict)

    def get(self, text: str, generation: int, dirty: bool) -> Any:
        result, of, at = self._held.get(fingerprint(text), (None, -1, 0.0))
        return None if dirty or of != generation or self.clock() - at > self.seconds else result

    def put(self, text: str, result: Any, generation: int) -> None:
        self._held[fingerprint(text)] = result, generation, self.clock()


@dataclass
class Fuzzy:
    """By the Jaccard similarity of the words: the most similar result, of equals the newest. The oldest goes when there are too many."""

    most: int = 100
    clock: Callable[[], float] = time.monotonic
    _held: list[tuple[frozenset, Any, int, float]] = field(default_factory=list)

    def get(self, text: str, least: float, generation: int, dirty: bool, seconds: float) -> Any:
        if dirty:
            return None
        own, best = words(text), (least, -1.0, None)
        for known, result, of, at in self._held:
            if of == generation and self.clock() - at <= seconds and (jaccard(own, known), at) >= best[:2]:
                best = jaccard(own, known), at, result
        return best[2]

    def put(self, text: str, result: Any, generation: int) -> None:
        if len(self._held) >= self.most:
            self._held.remove(min(self._held, key=lambda x: x[3]))
        self._held.append((words(text), result, generation, self.clock()))

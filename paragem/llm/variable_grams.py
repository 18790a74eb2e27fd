"""Variable-length grams of a word, and how many of them one edit can change.

A word's grams start at each of its places and are as long as the dictionary allows:
the longest of its grams that stands there, or the ``SHORTEST`` symbols at that place.
A gram that lies inside an earlier one is left out. The dictionary holds grams of up to
``LONGEST`` symbols that lengthen a frequent gram.
"""

from __future__ import annotations

from collections.abc import Iterable

SHORTEST, LONGEST = 2, 3
#: Words from this length on keep a gram whatever one edit does: the grams it can change lie within
#: ``2 * LONGEST - 1`` symbols, and a gram begins with the word's first symbol and one ends with its last.
LEAST_WORD = 2 * LONGEST


class GramDictionary:
    """The grams that lengthen others, with what the bound on affected grams looks up."""

    def __init__(self, grams: Iterable[str]):
        self.grams = frozenset(grams)
        self.beginnings = frozenset(g[:k] for g in self.grams for k in range(1, len(g)))
        self.endings = frozenset(g[k:] for g in self.grams for k in range(1, len(g)))

    def spans(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of ``word``; both increase along the list."""
        out, reach, length = [], 0, len(word)
        for start in range(length - SHORTEST + 1):
            end = min(length, start + LONGEST)
            while end - start > SHORTEST and word[start:end] not in self.grams:
                end -= 1
            if end > reach:
                out.append((start, end))
                reach = end
        return out

    def _first_reaching(self, word: str, place: int) -> int:
        """The first start from which a gram of the dictionary may come to reach over ``place``."""
        for start in range(max(0, place - LONGEST + 1), place):
            if word[start:place] in self.beginnings:
                return start
        return place

    def _last_reached(self, word: str, place: int) -> int:
        """The last end up to which a gram that begins before ``place`` may come to reach."""
        for end in range(min(len(word), place + LONGEST - 1), place, -1):
            if word[place:end] in self.endings:
                return end
        return place

    def most_affected(self, word: str, spans: list[tuple[int, int]]) -> int:
        """At most so many of ``spans`` go when one symbol is inserted, deleted or replaced.

        An edit replaces ``word[a:b]``, one symbol or none. It changes the grams that reach
        into it or over it, those before it that a longer gram could now swallow, and those
        behind it that a gram from before could.
        """
        most, first = 0, 0
        for a in range(len(word) + 1):
            while first < len(spans) and spans[first][1] <= a - LONGEST:
                first += 1
            before = self._first_reaching(word, a)
            for b in (a, a + 1):
                if b > len(word):
                    continue
                behind, hit = self._last_reached(word, b), 0
                for k in range(first, len(spans)):
                    start, end = spans[k]
                    if start >= b + LONGEST:
                        break
                    if end <= a:
                        hit += start >= before
                    elif start >= b:
                        hit += end <= behind
                    else:
                        hit += 1
                most = max(most, hit)
        return most

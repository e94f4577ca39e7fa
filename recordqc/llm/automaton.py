"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """All substrings of the sequences added; ``longest`` is a state's length, ``link`` its suffix link."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.longest: list[int] = [0]

    def _clone(self, p: int, c: Hashable, q: int) -> int:
        """The part of state ``q`` that ends ``p``'s longest string and ``c``."""
        made = len(self.next)
        self.next.append(dict(self.next[q]))
        self.longest.append(self.longest[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = made
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def extend(self, last: int, c: Hashable) -> int:
        """The state of ``last``'s longest string followed by ``c``; ``last`` is 0 at the start of a sequence."""
        q = self.next[last].get(c)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, c, q)
        made = len(self.next)
        self.next.append({})
        self.longest.append(self.longest[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[made] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, c, q)
        return made

    def add(self, sequence: Iterable[Hashable]) -> int:
        """Adds a sequence; returns the state of all of it, which later sequences may split."""
        last = 0
        for c in sequence:
            last = self.extend(last, c)
        return last

    def walk(self, sequence: Iterable[Hashable]):
        """(state, matching length) after each symbol: the longest suffix read so far that some sequence holds."""
        nxt, link, longest = self.next, self.link, self.longest
        state = length = 0
        for c in sequence:
            q = nxt[state].get(c)
            while q is None and state:
                state = link[state]
                length = longest[state]
                q = nxt[state].get(c)
            if q is not None:
                state = q
                length += 1
            yield state, length

    def by_length(self) -> list[int]:
        """States from the longest to the shortest: each before its suffix link."""
        return sorted(range(1, len(self.next)), key=self.longest.__getitem__, reverse=True)

"""Generalised suffix automaton of token sequences.

Its states are the classes of substrings of all sequences that end at the
same places. Reading a text through it gives, at every token, the longest
suffix read that stands in some sequence (the matching statistics), in time
linear in the text whatever the sequences' number.
"""

from __future__ import annotations


class SuffixAutomaton:
    def __init__(self, sequences):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        #: for each state (sequence, end) of all places where its strings end
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, tokens in enumerate(sequences):
            state = 0
            for i, token in enumerate(tokens):
                state = self._grow(state, token)
                self.ends[state].append((k, i + 1))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _add(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, token, q: int) -> int:
        """The state of the string of ``p`` and ``token``, cut off from ``q``
        where ``q`` also has longer strings."""
        if self.length[q] == self.length[p] + 1:
            return q
        shorter = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = shorter
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = shorter
            p = self.link[p]
        return shorter

    def _grow(self, last: int, token) -> int:
        if token in self.next[last]:  # an earlier sequence holds this string
            return self._split(last, token, self.next[last][token])
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def read(self, state: int, matched: int, token) -> tuple[int, int]:
        """State and length of the longest match after one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], matched + 1
        return 0, 0

    def state_of(self, tokens) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state

    def suffixes(self, state: int) -> list[int]:
        """The state and those of its strings' shorter suffixes."""
        found = []
        while state > 0:
            found.append(state)
            state = self.link[state]
        return found

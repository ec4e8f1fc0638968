"""A suffix automaton over words, for matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of some sequences of small integers, each with the smallest owner of a sequence that has it.

    Transitions are one table keyed by state and word, which takes a third of the memory of a table for each state.
    """

    def __init__(self, words: int):
        self.width = max(1, words)
        self.next: dict[int, int] = {}
        self.out: list[int | list[int]] = [[]]  # the words that lead on from a state
        self.link, self.len, self.owner = [-1], [0], [None]

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.len.append(length)
        self.owner.append(None)
        self.out.append([])
        return len(self.len) - 1

    def _extend(self, last: int, word: int) -> int:
        table, width, link, length = self.next, self.width, self.link, self.len
        q = table.get(last * width + word)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0:
            key = p * width + word
            if key in table:
                break
            table[key] = new
            self.out[p].append(word)
            p = link[p]
        if p >= 0:
            q = table[p * width + word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of state q for its substrings of up to p's length plus one."""
        table, width = self.next, self.width
        copy = self._state(self.len[p] + 1, self.link[q])
        self.link[q] = copy
        self.out[copy] = list(self.out[q])
        for w in self.out[q]:
            table[copy * width + w] = table[q * width + w]
        while p >= 0 and table.get(p * width + word) == q:
            table[p * width + word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)
            known = self.owner[last]
            if known is None or owner < known:
                self.owner[last] = owner

    def finish(self) -> None:
        """Hands owners down from longer substrings to the suffixes they end with."""
        owner, link = self.owner, self.link
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and owner[state] is not None and (owner[up] is None or owner[state] < owner[up]):
                owner[up] = owner[state]

    def matches(self, sequence: list[int], least: int, below: int) -> list[int]:
        """The ends (exclusive) of the windows of ``least`` words that a sequence of an owner under ``below`` has too.

        ``length`` is the matching statistic: how long a suffix of what was read is a substring. Where it reaches
        ``least``, the state of the last ``least`` words is the one up the suffix links that still holds so many.
        """
        table, width, link, lens, owner = self.next, self.width, self.link, self.len, self.owner
        state, length, ends = 0, 0, []
        for at, word in enumerate(sequence, 1):
            to = table.get(state * width + word)
            while to is None and state:
                state = link[state]
                length = lens[state]
                to = table.get(state * width + word)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= least:
                while lens[link[state]] >= least:  # a shorter suffix may do, and its owner is no larger
                    state = link[state]
                    length = lens[state]
                if owner[state] is not None and owner[state] < below:
                    ends.append(at)
        return ends

"""Suffix automaton over words: which stretches of a reference a text repeats, and who holds them first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

NOBODY = (1 << 63) - 1


class SuffixAutomaton:
    """All stretches of the texts added, each state with the least holder of its stretches.

    A state stands for the stretches of more than ``length[link]`` and at most
    ``length`` words that end at the same places.  States, and words in their
    transitions, are linear in the words added.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [NOBODY]

    def _state(self, length: int, onward: dict, link: int) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NOBODY)
        return len(self.link) - 1

    def _split(self, before: int, state: int, word) -> int:
        """A state for the stretches of ``state`` that end ``before`` and the word, cut off from its longer ones."""
        part = self._state(self.length[before] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = part
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = part
            before = self.link[before]
        return part

    def _extended(self, last: int, word) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        state, before = self._state(self.length[last] + 1, {}, 0), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = state
            before = self.link[before]
        if before >= 0:
            shorter = self.next[before][word]
            if self.length[shorter] != self.length[before] + 1:
                shorter = self._split(before, shorter, word)
            self.link[state] = shorter
        return state

    def add(self, words: Sequence, holder: int) -> None:
        last, least = 0, self.least
        for word in words:
            last = self._extended(last, word)
            if holder < least[last]:
                least[last] = holder

    def settle(self) -> None:
        """Give every state the least holder of all stretches it is a suffix of; call once, after the last text."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.least[state] < self.least[above]:
                self.least[above] = self.least[state]

    def matches(self, words: Sequence, span: int) -> Iterator[tuple[int, int]]:
        """Matching statistics, cut at ``span``: at each word the state and the length of the longest known stretch that ends there."""
        state, matched = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            onward = self.next[state].get(word)
            if onward is None:
                matched = 0
            else:
                state, matched = onward, matched + 1
                while self.length[self.link[state]] >= span:
                    state = self.link[state]
                    matched = self.length[state]
            yield state, min(matched, span)

    def first_holders(self, words: Sequence, span: int) -> list[int]:
        """For each window of ``span`` words the least holder of the same words, ``NOBODY`` where the reference lacks them."""
        found = [self.least[state] if matched >= span else NOBODY for state, matched in self.matches(words, span)]
        return found[span - 1 :]

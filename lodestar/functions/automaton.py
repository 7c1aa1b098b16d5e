"""Multi-pattern matching: one pass over a text finds all aliases; longest non-overlapping matches win."""

from __future__ import annotations

from typing import Any

import ahocorasick


class AliasAutomaton:
    """Aho-Corasick automaton over lower-case aliases, each with a payload.

    A match that begins or ends with a letter or digit must stand on a word boundary there, except next
    to scripts written without spaces. Overlaps go to the longer match, then to the earlier one.
    """

    def __init__(self, aliases: dict[str, Any], whole_words: bool = True):
        self.whole_words = whole_words
        self.automaton = ahocorasick.Automaton()
        for alias, payload in aliases.items():
            if alias:
                self.automaton.add_word(alias, (alias, payload))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _joins(a: str, b: str) -> bool:
        """Whether two neighbouring characters belong to one word."""
        if not (a.isalnum() and b.isalnum()):
            return False
        return a.isdigit() == b.isdigit() and ord(a) < 0x2E80 and ord(b) < 0x2E80

    def find(self, text: str) -> list[tuple[int, int, str, Any]]:
        """(start, end, alias, payload) of the chosen matches, in text order."""
        if not len(self.automaton) or not text:
            return []
        found = []
        for last, (alias, payload) in self.automaton.iter(text):
            end, start = last + 1, last + 1 - len(alias)
            if self.whole_words and (start > 0 and self._joins(text[start - 1], text[start]) or end < len(text) and self._joins(text[last], text[end])):
                continue
            found.append((start, end, alias, payload))
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str, Any]] = []
        used: set[int] = set()
        for m in found:
            if not used.intersection(range(m[0], m[1])):
                used.update(range(m[0], m[1]))
                taken.append(m)
        return sorted(taken, key=lambda m: m[0])

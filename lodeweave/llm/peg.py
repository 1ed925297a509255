"""A packrat matcher for parsing-expression grammars over strings of one character per token.

Notation: ``name <- alternatives`` with ``/`` ordered choice, ``* + ?``, ``& !`` look-ahead, ``( )``,
``'word'`` for a token, CAPITALS for a class of tokens and ``paren:Args`` for a bracket group whose
content is known to match the rule ``Args``. ``NL`` succeeds before a line break or at the end without
consuming it, ``NONL`` where there is no line break, ``END`` at the end. Tokens skip line breaks.
Nesting is limited by memory alone.

Brackets are matched from the inside: a group's content is matched against every rule that may
stand in such a bracket, and the group becomes one character that tells which of them matched it. What
a content matched is remembered by its text, so that the memo serves all positions and files alike.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: Group characters: from here so many for each kind of bracket, a bit for each rule that its content matches and one more (``MARK``) for use by the checkers.
GROUP, GROUP_SIZE, MARK = 0xF0000, 2048, 1024
MOST_MEMO = 300_000
#: Calls that matching nests for a token, at most: a rule takes up to five, and no rule comes back to itself without a token.
DEPTH = 400

_NOTATION = re.compile(r"\s*(?:(<-)|'([^']*)'|(\w+):(\w+)|(\w+)|(.))")

Match = Callable[[int], int]


class Grammar:
    """A compiled grammar. ``tokens``: word -> character; ``classes``: NAME -> characters; ``groups``: bracket -> rules of its content."""

    def __init__(self, text: str, tokens: dict[str, str], classes: dict[str, str], groups: dict[str, list[str]]) -> None:
        self.tokens, self.classes, self.groups = tokens, classes, groups
        self.kinds = {g: k for k, g in enumerate(groups)}
        self.rules: dict[str, Match] = {}
        self.text, self.memo, self.far = "", {}, 0
        self.known: dict[tuple[str, str], bool] = {}
        for line in re.split(r"\n(?=\w+\s*<-)", text.strip()):
            name, _, body = line.partition("<-")
            parts = [m for m in _NOTATION.finditer(body.strip()) if m[0].strip()]
            self.rules[name.strip()] = self._remembered(name.strip(), self._choice(parts, [0]))

    # compiling

    def _remembered(self, name: str, match: Match) -> Match:
        def run(i: int) -> int:
            key = (name, i)
            memo = self.memo
            if key in memo:
                return memo[key]
            out = memo[key] = match(i)
            return out

        return run

    def _choice(self, parts: list, at: list[int]) -> Match:
        options = [self._sequence(parts, at)]
        while at[0] < len(parts) and parts[at[0]][6] == "/":
            at[0] += 1
            options.append(self._sequence(parts, at))
        if len(options) == 1:
            return options[0]

        def run(i: int) -> int:
            for option in options:
                if (j := option(i)) >= 0:
                    return j
            return -1

        return run

    def _sequence(self, parts: list, at: list[int]) -> Match:
        items = []
        while at[0] < len(parts) and parts[at[0]][6] not in ("/", ")"):
            items.append(self._item(parts, at))
        if len(items) == 1:
            return items[0]

        def run(i: int) -> int:
            for item in items:
                if (i := item(i)) < 0:
                    return -1
            return i

        return run

    def _item(self, parts: list, at: list[int]) -> Match:
        m = parts[at[0]]
        at[0] += 1
        if m[6] in ("&", "!"):
            inner, wanted = self._item(parts, at), m[6] == "&"

            def look(i: int) -> int:
                far = self.far
                j = inner(i)
                self.far = far if not wanted else self.far
                return i if (j >= 0) == wanted else -1

            return look
        if m[6] == "(":
            match = self._choice(parts, at)
            at[0] += 1
        elif m[2] is not None:
            match = self._one_of(self.tokens[m[2]])
        elif m[3]:
            match = self._group(m[3], m[4])
        else:
            match = self._named(m[5])
        if at[0] < len(parts) and (sign := parts[at[0]][6]) in ("*", "+", "?"):
            at[0] += 1
            return self._repeated(match, sign)
        return match

    @staticmethod
    def _repeated(match: Match, sign: str) -> Match:
        if sign == "?":
            return lambda i: j if (j := match(i)) >= 0 else i

        def run(i: int) -> int:
            n = 0
            while (j := match(i)) > i:
                i, n = j, n + 1
            return i if n or sign == "*" else -1

        return run

    def _one_of(self, chars: str) -> Match:
        def run(i: int) -> int:
            text = self.text
            while text[i] == "\n":
                i += 1
            if text[i] in chars:
                return i + 1
            if i > self.far:
                self.far = i
            return -1

        return run

    def _group(self, bracket: str, rule: str) -> Match:
        low = GROUP + self.kinds[bracket] * GROUP_SIZE
        bit = 1 << self.groups[bracket].index(rule)

        def run(i: int) -> int:
            text = self.text
            while text[i] == "\n":
                i += 1
            o = ord(text[i]) - low
            if 0 <= o < GROUP_SIZE and o & bit:
                return i + 1
            if i > self.far:
                self.far = i
            return -1

        return run

    def _named(self, name: str) -> Match:
        if name == "NL":
            return lambda i: i if self.text[i] in "\n\0" else -1
        if name == "NONL":
            return lambda i: i if self.text[i] not in "\n\0" else -1
        if name == "END":
            end = self._one_of("\0")
            return lambda i: i if end(i) >= 0 else -1
        if name == "NEVER":
            return lambda i: -1
        if name in self.classes:
            return self._one_of(self.classes[name])
        return lambda i: self.rules[name](i)

    # matching

    def matches(self, rule: str, text: str) -> bool:
        """Does the rule match the whole text? Remembered by text."""
        key = (rule, text)
        if (out := self.known.get(key)) is None:
            if len(self.known) > MOST_MEMO:
                self.known.clear()
            out = self.known[key] = self.furthest(rule, text) is None
        return out

    def furthest(self, rule: str, text: str) -> int | None:
        """None if the rule matches the whole text, else the furthest position at which it failed."""
        self.text, self.memo, self.far = text + "\0", {}, 0
        if sys.getrecursionlimit() < (need := DEPTH * (len(text) + 10)):
            sys.setrecursionlimit(need)  # calls of Python functions don't nest on the stack of the process
        i = self.rules[rule](0)
        while i >= 0 and self.text[i] == "\n":
            i += 1
        return None if i == len(text) else min(max(self.far, i, 0), len(text))

    def group(self, bracket: str, content: str) -> str:
        """The character that stands for a group with this content, or an empty text if no rule matches it."""
        bits = 0
        for k, rule in enumerate(self.groups[bracket]):
            if self.whole(rule, content):
                bits |= 1 << k
        return chr(GROUP + self.kinds[bracket] * GROUP_SIZE + bits) if bits else ""

    def whole(self, rule: str, content: str) -> bool:
        return self.matches(rule, content)

"""Source files whose content the language of their extension does not accept.

Texts become tokens, and grammars of ``grammars`` are matched against all of them by the packrat matcher
of ``peg``. Brackets are resolved from the inside; statements and, in Python, lines and blocks are
matched as units, so that a shape of code that occurred before costs one look-up. For what fails, the
furthest position of failure is worked out, and whether an unresolved merge is the cause.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import grammars as g
from ..functions.paths import extension as extension_of
from ..sources.tables import spread
from .peg import GROUP, GROUP_SIZE, MARK, Grammar
from .shared_spans import text_of

#: Tokens whose kinds a task remembers.
TOKENS = 300_000
#: The character of the first indent of Python's lines, and how many are kept from one text to the next; a text may have 800,000.
INDENT, MOST_INDENTS = 0x20000, 10_000
_CONFLICT = re.compile(r"^[ \t]*(?:(?:<{7}|>{7}|\|{7})(?: |$)|={7}$)", re.M)
_OPEN = {"(": ("paren", ")"), "[": ("brack", "]"), "{": ("brace", "}"), "\x05": ("subst", "\x06")}
_INNER = re.compile(r"\(([^()\[\]{}\x05\x06]*)\)|\[([^()\[\]{}\x05\x06]*)\]|\{([^()\[\]{}\x05\x06]*)\}|\x05([^()\[\]{}\x05\x06]*)\x06")
_LEFT = re.compile(r"[()\[\]{}\x05\x06\x01]")
_BRACKETS = (None, "paren", "brack", "brace", "subst")
#: An element that a list repeats many times is as good as one or two of them.
_REPEATED = re.compile(r"((?:(?<=,)|^)[^,]{1,40},)\1+")


class Kinds(dict):
    """The character of each token text."""

    def __init__(self, classify: Callable[[str], str], fixed: dict[str, str]) -> None:
        super().__init__(fixed)
        self.classify, self.fixed = classify, fixed

    def __missing__(self, token: str) -> str:
        if len(self) > TOKENS:
            self.clear()
            self.update(self.fixed)
        kind = self[token] = self.classify(token)
        return kind


class Checker:
    """Checks texts of a language. ``units``: rules of statement lists -> where a list may be cut."""

    lex: re.Pattern
    root = ""
    units: dict[str, tuple[re.Pattern, str]] = {}

    def __init__(self, grammar: Grammar, fixed: dict[str, str]) -> None:
        self.grammar = grammar
        self.kinds = Kinds(self.classify, fixed)
        self.groups: dict[tuple[str, str], str] = {}
        self.grammar.whole = self.whole

    def classify(self, token: str) -> str:
        raise NotImplementedError

    def tokens(self, text: str) -> list[tuple[str, int]]:
        """(kind, offset) of every token."""
        return [(c, m.start(1)) for m in self.lex.finditer(text) for c in self.kinds[m[1]]]

    def shape(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.lex.findall(text)))

    def tidy(self, bracket: str, content: str) -> str:
        return content

    def whole(self, rule: str, content: str) -> bool:
        """Does the rule match the content? Lists of statements are cut into parts that are looked up on their own."""
        if rule in self.units and len(content) > 12:
            cut, probe = self.units[rule]
            parts = cut.split(content)
            if len(parts) > 1 and all(self.grammar.matches(rule, p if p[-1:] in ";\n" or k == len(parts) - 1 else p + probe) for k, p in enumerate(parts)):
                return True
        return self.grammar.matches(rule, content)

    def group(self, bracket: str, content: str) -> str:
        content = self.tidy(bracket, content)
        if len(content) > 80:
            content = _REPEATED.sub(r"\1", content)
        key = (bracket, content)
        if (out := self.groups.get(key)) is None:
            if len(self.groups) > TOKENS:
                self.groups.clear()
            out = self.groups[key] = self.marked(content, self.grammar.group(bracket, content)) or g.ERROR
        return out

    def marked(self, content: str, group: str) -> str:
        return group

    def reduced(self, shape: str) -> str:
        """The shape with every bracket group replaced, from the inside."""

        def replace(m: re.Match) -> str:
            return self.group(_BRACKETS[m.lastindex], m[m.lastindex])

        while True:
            after = _INNER.sub(replace, shape)
            if after == shape:
                return shape
            shape = after

    def accepts(self, text: str) -> bool:
        shape = self.reduced(self.shape(text))
        return not _LEFT.search(shape) and self.whole(self.root, shape)

    def failure(self, text: str) -> int:
        """The furthest offset at which a text that isn't accepted fails."""
        tokens = self.tokens(text)
        stack: list[tuple[str, int, list[tuple[str, int]]]] = [("", 0, [])]
        for c, at in tokens:
            if c in _OPEN:
                stack.append((c, at, []))
            elif c in ")]}\x06":
                opened, start, inside = stack.pop()
                if not stack or _OPEN.get(opened, ("", ""))[1] != c:
                    return at
                content = self.tidy(_OPEN[opened][0], "".join(k for k, _ in inside))
                kind = self.group(_OPEN[opened][0], content)
                if kind == g.ERROR:
                    kept = inside if len(content) == len(inside) else [x for x in inside if x[0] in content]
                    far = max(self.grammar.furthest(r, content) or 0 for r in self.grammar.groups[_OPEN[opened][0]])
                    return kept[far][1] if far < len(kept) else at
                stack[-1][2].append((kind, start))
            elif c == g.ERROR:
                return at
            else:
                stack[-1][2].append((c, at))
        if len(stack) > 1:
            return len(text)
        return self.at_root(stack[0][2], text)

    def at_root(self, items: list[tuple[str, int]], text: str) -> int:
        far = self.grammar.furthest(self.root, "".join(k for k, _ in items))
        return len(text) if far is None or far >= len(items) else items[far][1]


class Python(Checker):
    lex = g.PY_LEX

    def __init__(self) -> None:
        self.indents: dict[str, str] = {}
        self.widths: dict[str, tuple[int, int]] = {}
        self.lines: dict[str, str] = {}
        self.blocks = g.python_block()
        super().__init__(g.python(), {**g.PY_TOKENS, "": ""})

    def classify(self, token: str) -> str:
        if token[0] == "\n":
            blank = token[token.rfind("\n") + 1 :]
            if blank not in self.indents:
                if len(self.indents) > 850_000:
                    return g.ERROR
                mark = self.indents[blank] = chr(INDENT + len(self.indents))
                self.widths[mark] = (len(blank.expandtabs(8)), len(blank.expandtabs(1)))
            return "\n" + self.indents[blank]
        if token[-1] in "\"'" and len(token) > 1:
            return g.STRING
        if token.isidentifier():
            return g.NUMBER if token in ("None", "True", "False") else g.NAME
        return g.NUMBER if len(token) > 1 and (token[0].isdigit() or token[0] == ".") or token.isdigit() else g.ERROR

    def tidy(self, bracket: str, content: str) -> str:
        return re.sub("\n.", "", content, flags=re.S) if "\n" in content else content

    def line(self, body: str) -> str:
        """The kind of a logical line; with B if its body follows on it, or + if a block must; empty if it isn't right."""
        if (out := self.lines.get(body)) is None:
            if self.grammar.matches("Stmts", body):
                out = "s"
            elif self.grammar.matches("Header", body):
                head = body[1:] if body[0] == g.PY_TOKENS["async"] else body
                out = next(k for w, k in g.PY_KINDS.items() if g.PY_TOKENS[w] == head[0])
                out += "" if out == "@" else "+" if body[-1] == g.PY_TOKENS[":"] else "B"
            else:
                out = ""
            if len(self.lines) > TOKENS:
                self.lines.clear()
            self.lines[body] = out
        return out

    _string = re.compile(r"#[^\n]*|([A-Za-z]{0,2})(\"\"\"|'''|\"|')", re.S)

    @classmethod
    def flat(cls, text: str) -> str:
        """The text with formatted strings, whatever nests in them, as plain ones of the same length."""
        parts, at, i = [], 0, 0
        while m := cls._string.search(text, i):
            i = m.end()
            if m[2] is None or i > 1 and m.start() and text[m.start() - 1].isalnum():
                continue
            end = cls._end(text, i, m[2], bool(set(m[1]) & set("fFtT")))
            if end < 0:
                break
            if set(m[1]) & set("fFtT"):
                parts += [text[at:i], "x" * (end - i - len(m[2])), m[2]]
                at = end
            i = end
        return "".join([*parts, text[at:]])

    @classmethod
    def _end(cls, text: str, i: int, quote: str, formatted: bool) -> int:
        """The place after a string whose content begins at ``i``, or -1. ``stack``: quotes of strings and brackets of expressions that are open."""
        stack = [quote] if formatted else [quote + "."]
        while i < len(text) and stack:
            top, c = stack[-1], text[i]
            if top[0] in "\"'":  # in a string; a plain one ends with a dot
                mark = top.removesuffix(".")
                if text.startswith(mark, i):
                    stack.pop()
                    i += len(mark)
                elif c == "\n" and len(mark) == 1:
                    return -1
                elif c == "{" and top == mark and text[i + 1 : i + 2] != "{":
                    stack.append("{")
                    i += 1
                else:
                    i += 2 if c == "\\" or c == "{" and top == mark else 1
            elif top == ":":  # in the format of an expression
                if c == "{":
                    stack.append("{")
                elif c == "}":
                    del stack[-2:]
                i += 1
            elif c in "([{":
                stack.append(c)
                i += 1
            elif c in ")]}":
                stack.pop()
                i += 1
            elif c == ":" and top == "{" and stack[-2][0] in "\"':":
                stack.append(":")
                i += 1
            elif c in "\"'":
                mark = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
                prefix = re.search(r"[A-Za-z]{0,2}\Z", text[max(0, i - 2) : i])[0]
                stack.append(mark if set(prefix) & set("fFtT") else mark + ".")
                i += len(mark)
            else:
                i += 1
        return -1 if stack else i

    def _begin(self) -> None:
        """Marks of indents hold within a text; they are given anew before there are too many."""
        if len(self.indents) > MOST_INDENTS:
            self.indents.clear()
            self.widths.clear()
            self.kinds.clear()
            self.kinds.update(self.kinds.fixed)

    def accepts(self, text: str) -> bool:
        if self._accepts(text):
            return True
        flat = self.flat(text)  # quotes within quotes are rare; only what fails is read so
        return flat != text and self._accepts(flat)

    def _accepts(self, text: str) -> bool:
        self._begin()
        shape = self.reduced(self.shape("\n" + text))
        return not _LEFT.search(shape) and self.nested(shape.split("\n")[1:]) is None

    def nested(self, lines: list[str]) -> int | None:
        """The number of the first line that stands wrong, or None."""
        stack: list[tuple[tuple[int, int], list[str]]] = [((0, 0), [])]
        awaited, number = False, 0

        def close() -> bool:
            _, kinds = stack.pop()
            block = re.sub("s+", "s", "".join(kinds))
            if self.blocks.matches("Block", block):
                stack[-1][1].append("B")
            elif self.blocks.matches("Cases", block):
                stack[-1][1].append("C")
            else:
                return False
            return True

        for number, line in enumerate(lines):
            if len(line) < 2:
                continue
            width = self.widths[line[0]]
            if awaited:
                if not (width[0] > stack[-1][0][0] and width[1] > stack[-1][0][1]):
                    return number
                stack.append((width, []))
                awaited = False
            while width != stack[-1][0]:
                if width[0] >= stack[-1][0][0] or len(stack) == 1 or not close():
                    return number
            kind = self.line(line[1:])
            if not kind:
                return number
            awaited = kind[-1] == "+"
            stack[-1][1].append(kind[:-1] if awaited else kind)
        if awaited:
            return number
        while len(stack) > 1:
            if not close():
                return number
        block = re.sub("s+", "s", "".join(stack[0][1]))
        return None if not block or self.blocks.matches("Block", block) else number

    def failure(self, text: str) -> int:
        return max(super().failure("\n" + self.flat(text)) - 1, 0)

    def at_root(self, items: list[tuple[str, int]], text: str) -> int:
        lines: list[list[tuple[str, int]]] = []
        for k, (c, at) in enumerate(items):
            if c == "\n":
                lines.append([])
            elif lines:
                lines[-1].append((c, at))
        number = self.nested(["".join(k for k, _ in line) for line in lines])
        if number is None or number >= len(lines) or not lines[number]:
            return len(text)
        body = "".join(k for k, _ in lines[number][1:])
        far = 0 if self.line(body) else max(self.grammar.furthest("Line", body) or 0, 0)
        return lines[number][min(far + 1, len(lines[number]) - 1)][1]


class Go(Checker):
    lex, root = g.GO_LEX, "File"
    units = {"Block": (re.compile("(?<=;)"), ""), "File": (re.compile("(?<=;)(?!$)"), ""), "Cases": (re.compile("(?=[%s%s])" % (g.GO_TOKENS["case"], g.GO_TOKENS["default"])), ";")}
    _break = re.compile("(?<=[%s])\n+" % re.escape(g.GO_ENDS))

    def __init__(self) -> None:
        super().__init__(g.go(), {**g.GO_TOKENS, "": ""})

    def classify(self, token: str) -> str:
        c = token[0]
        if c == "\n" or token[:2] == "/*":
            return "\n"
        if c in "\"'`" and len(token) > 1:
            return g.STRING
        if c.isalpha() or c == "_":
            return g.NAME
        return g.NUMBER if c.isdigit() or c == "." and len(token) > 1 else g.ERROR

    def shape(self, text: str) -> str:
        return self._break.sub(";", super().shape(text) + "\n").replace("\n", "")

    def tokens(self, text: str) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        for c, at in [*super().tokens(text), ("\n", len(text))]:
            if c != "\n":
                out.append((c, at))
            elif out and out[-1][0] in g.GO_ENDS:
                out.append((";", at))
        return out

    def whole(self, rule: str, content: str) -> bool:
        if rule == "File":  # the head stands once; declarations are looked up one by one
            parts = self.units["File"][0].split(content)
            return self._file(parts) or self.grammar.matches("File", content)
        return super().whole(rule, content)

    def _file(self, parts: list[str]) -> bool:
        k = 1
        while k < len(parts) and parts[k][0] == g.GO_TOKENS["import"]:
            k += 1
        return self.grammar.matches("File", "".join(parts[:k])) and all(self.grammar.matches("Top", p.removesuffix(";")) for p in parts[k:])


class Script(Checker):
    """TypeScript or JavaScript modules. ``markup``: elements may stand in expressions."""

    lex, root = g.JS_LEX, "Program"
    _starts = "".join(g.JS_TOKENS[w] for w in "var let const if for while function return switch try throw !".split()) + g.NAME
    _brace = "%s-%s" % (chr(GROUP + 2 * GROUP_SIZE), chr(GROUP + 3 * GROUP_SIZE - 1))
    _cut = re.compile("(?<=[;\n])(?=[^\n])|(?<=[%s])(?=[%s])" % (_brace, re.escape(_starts)))
    units = {"Block": (_cut, "n;"), "Program": (_cut, "n;"), "ClassBody": (re.compile("(?<=[;\n])(?=[^\n])"), ""), "Space2": (_cut, "n;")}
    _substitution = re.compile(r"\$\{([^{}`]*)\}")
    _simple_template = re.compile(r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*\})*`", re.S)
    _literal = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
    _special = re.compile(r"`|(?:[=(,:;!&|?{}\[+\-*%~^<>\n]|\breturn|\btypeof|\bcase)[ \t]*/(?![/*=])|(?:[=(,:?&|>{}\[]|\breturn|\bdefault)\s*<[A-Za-z>]")
    _operand = set(")]}") | {g.NAME, g.NUMBER, g.STRING, "t", "r", "\x03", "\x04", "\x06"} | set(g.JS_CLASSES["NAMES"] + g.JS_CLASSES["ATOM"])

    _return = g.JS_TOKENS["return"]
    #: A marked block that belongs to a statement, not to a function.
    _of_statement = re.compile(
        "(?:^|[;:%s]|[%s]\n*[%s-%s])\n*[%s]"
        % ("".join(g.JS_TOKENS[w] for w in "else try finally do catch".split()), "".join(g.JS_TOKENS[w] for w in "if for while switch catch await".split()), chr(GROUP), chr(GROUP + GROUP_SIZE - 1),
           "".join("%s-%s" % (chr(GROUP + 2 * GROUP_SIZE + k), chr(GROUP + 2 * GROUP_SIZE + k + MARK - 1)) for k in (MARK,)))
    )
    _jump = re.compile("(?:^|;)\n*[%s]" % (g.JS_TOKENS["break"] + g.JS_TOKENS["continue"]))

    def __init__(self, typed: bool, markup: bool) -> None:
        self.markup = markup
        super().__init__(g.typescript() if typed else g.javascript(), {**g.JS_TOKENS, "": ""})

    def classify(self, token: str) -> str:
        c = token[0]
        if c == "\n":
            return "\n"
        if token[:2] == "/*":
            return "\n" if "\n" in token else ""
        if c in "\"'" and len(token) > 1:
            return g.STRING
        if c.isalpha() or c in "_$" or c == "#" and len(token) > 1:
            return g.NAME
        return g.NUMBER if c.isdigit() or c == "." and len(token) > 1 else g.ERROR

    def tidy(self, bracket: str, content: str) -> str:
        return content.replace("\n", "") if bracket in ("paren", "brack") else content

    def marked(self, content: str, group: str) -> str:
        """Marks a group with a ``return`` that no function in it encloses."""
        return chr(ord(group) | MARK) if group and self._free_return(content) else group

    def _free_return(self, content: str) -> bool:
        return self._return in content or self._of_statement.search(content) is not None

    def accepts(self, text: str) -> bool:
        shape = self.reduced(self.shape(text))
        return not _LEFT.search(shape) and not self._free_return(shape) and not self._jump.search(shape) and self.whole(self.root, shape)

    def at_root(self, items: list[tuple[str, int]], text: str) -> int:
        shape = "".join(k for k, _ in items)
        if self.grammar.furthest(self.root, shape) is None:  # only a return, break or continue stands wrong
            places = [m.end() - 1 for m in (self._of_statement.search(shape), self._jump.search(shape)) if m] + [shape.find(self._return)] * (self._return in shape)
            return items[min(places)][1] if places else len(text)
        return super().at_root(items, text)

    def shape(self, text: str) -> str:
        text = self._head(text)
        if self._special.search(text):
            return "".join(c for c, _ in self._scan(text, 0, ""))
        return super().shape(text)

    def tokens(self, text: str) -> list[tuple[str, int]]:
        return self._scan(self._head(text), 0, "")

    @staticmethod
    def _head(text: str) -> str:
        return " " * text.index("\n") + text[text.index("\n") :] if text.startswith("#!") and "\n" in text else text

    def _scan(self, text: str, at: int, until: str) -> list[tuple[str, int]]:
        """Tokens where what a character means depends on what precedes it: templates, patterns, elements."""
        out: list[tuple[str, int]] = []
        match, kinds, depth, last = self.lex.match, self.kinds, 0, ""
        while at < len(text):
            m = match(text, at)
            token, start, at = m[1], m.start(1), m.end()
            if token == "`":
                if simple := self._simple_template.match(text, start):
                    out.append(("\x02" if "${" in simple[0] else "t", start))
                    if "${" in simple[0]:
                        for s in self._substitution.finditer(simple[0]):
                            out.append(("\x05", start + s.start()))
                            out += [(c, o + start + s.start(1)) for c, o in self._scan(s[1], 0, "")]
                            out.append(("\x06", start + s.end() - 1))
                        out.append(("\x03", simple.end() - 1))
                    at = simple.end()
                else:
                    at = self._template(text, start, out)
                last = "\x03"
                continue
            if token[:1] == "/" and last not in self._operand and token[:2] != "/*":
                if m := self._literal.match(text, start):
                    out.append(("r", start))
                    at, last = m.end(), "r"
                    continue
            if token == "<" and self.markup and last not in self._operand and re.match(r"<(?:>|[A-Za-z][\w.:-]*(?!\w*\s*(?:,|extends\b)))", text[start : start + 80]):
                inner: list[tuple[str, int]] = []
                end = self._element(text, start, inner)
                out += [("\x04", start), *inner] if end > 0 else [(g.ERROR, start)]
                at, last = end if end > 0 else len(text), "\x04"
                continue
            kind = kinds[token]
            if until:
                if token == "{":
                    depth += 1
                elif token == "}":
                    if not depth:
                        out.append(("\x06", start))
                        self.end = at
                        return out
                    depth -= 1
            if kind:
                out.append((kind, start))
                if kind != "\n":
                    last = kind
        self.end = -1
        return out

    def _template(self, text: str, at: int, out: list[tuple[str, int]]) -> int:
        """Reads a template with nested parts from ``at``; the place after it."""
        begin = len(out)
        out.append(("\x02", at))
        at += 1
        parts = 0
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                if parts:
                    out.append(("\x03", at))
                else:
                    out[begin] = ("t", out[begin][1])
                return at + 1
            elif text.startswith("${", at):
                out.append(("\x05", at))
                out += self._scan(text, at + 2, "}")
                parts += 1
                if self.end < 0:
                    return len(text)
                at = self.end
            else:
                at += 1
        out.append((g.ERROR, len(text)))
        return len(text)

    _tag = re.compile(r"<\s*(/?)\s*([A-Za-z_$][\w.:$-]*)?\s*")
    _attribute = re.compile(r"\s*(?:([A-Za-z_$][\w:$.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|(?=\{)|(?=<)))?|(?=\{))")

    def _element(self, text: str, at: int, out: list[tuple[str, int]]) -> int:
        """Reads an element from ``at``, its containers into ``out``; the place after it, or -1."""
        m = self._tag.match(text, at)
        if not m or m[1]:
            return -1
        name, at = m[2] or "", m.end()
        while name:
            if text.startswith("/>", at):
                return at + 2
            if text[at : at + 1] == ">":
                break
            m = self._attribute.match(text, at)
            if not m or m.end() == at and text[at : at + 1] != "{":
                return -1
            at = m.end()
            if text[at : at + 1] == "{":
                at = self._container(text, at, out)
            elif text[at : at + 1] == "<":
                at = self._element(text, at, out)
            if at < 0:
                return -1
            at += len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else 0
        if text[at : at + 1] != ">":
            return -1
        at += 1
        while at < len(text):
            c = text[at]
            if c == "{":
                at = self._container(text, at, out)
            elif c == "<":
                m = self._tag.match(text, at)
                if m and m[1]:
                    if (m[2] or "") != name or text[m.end() : m.end() + 1] != ">":
                        return -1
                    return m.end() + 1
                at = self._element(text, at, out)
            elif c in ">}":
                return -1
            else:
                at += 1
            if at < 0:
                return -1
        return -1

    def _container(self, text: str, at: int, out: list[tuple[str, int]]) -> int:
        out.append(("\x05", at))
        out += self._scan(text, at + 1, "}")
        return self.end


class Checkers:
    """The checkers of a task, made when first needed."""

    def __init__(self) -> None:
        self.made: dict[tuple, Checker] = {}

    def of(self, language: str, extension: str) -> Checker | None:
        markup = extension in (".tsx", ".jsx")
        make = {"python": Python, "go": Go, "typescript": lambda: Script(True, markup), "javascript": lambda: Script(False, markup)}.get(language)
        if make and (language, markup) not in self.made:
            self.made[language, markup] = make()
        return self.made.get((language, markup))


def verdict(checker: Checker, language: str, content: bytes) -> tuple[int, str] | None:
    """None for an accepted content, else the furthest position of failure, in characters, and the cause."""
    text = text_of(content)
    odd = language in ("python", "go") and _undeclared(content)
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if not odd and "\0" not in text and checker.accepts(text):
        return None
    if "\0" in text:
        return text.index("\0"), "null character"
    if odd:
        return 0, "encoding"
    at = checker.failure(text)
    marks = [m.start() for m in _CONFLICT.finditer(text)]
    if any(abs(at - m) <= 200 for m in marks) or marks and at >= marks[0]:
        return at, "merge conflict"
    return at, "cut off" if not text[at:].strip() else "syntax"


def _undeclared(content: bytes) -> bool:
    """Is it neither UTF-8 nor in an encoding that its first lines declare?"""
    try:
        content.decode("utf-8")
        return False
    except UnicodeDecodeError:
        return not re.search(rb"coding[:=]", b"\n".join(content.split(b"\n", 2)[:2]))


_CHECKERS: list[Checkers] = []


def broken_files(files: DataFrame, file_types: DataFrame) -> DataFrame:
    """(file_id, repo, language, broken, position, cause): a verdict on every file of a known extension.

    ``position`` is the furthest one at which the grammar failed, in characters. The extension decides
    the language, by ``file_types`` (extension, language), which is joined. Null content is no
    case; an empty text is right in Python, TypeScript and JavaScript and broken in Go, which asks for a
    package clause; repeated rows stay repeated.
    """
    languages = file_types.where("extension is not null and language is not null").groupBy(F.lower("extension").alias("_extension")).agg(F.lower(F.min("language")).alias("_language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CHECKERS:
            _CHECKERS.append(Checkers())
        for batch in batches:
            at, known, broken, positions, causes = [], [], [], [], []
            for i, (extension, language, content) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                checker = _CHECKERS[0].of(language, extension)
                if checker is None:
                    continue
                found = verdict(checker, language, content) if content is not None else None
                at.append(i)
                known.append(language)
                broken.append(found is not None)
                positions.append(found and found[0])
                causes.append(found and found[1])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(known, pa.string()), pa.array(broken, pa.bool_()), pa.array(positions, pa.int32()), pa.array(causes, pa.string())], ["file_id", "repo", "language", "broken", "position", "cause"])

    rows = spread(files.select("file_id", "repo", extension_of(F.col("rel_path")).alias("_extension"), F.col("content").cast("binary").alias("_content")))
    rows = rows.join(languages, "_extension").select("file_id", "repo", "_extension", "_language", "_content")
    return rows.mapInArrow(run, "file_id long, repo string, language string, broken boolean, position int, cause string")


def broken_rates(verdicts: DataFrame) -> DataFrame:
    """(repo, language, files, broken, rate) of every repository and language; files count once."""
    return (
        verdicts.groupBy("file_id", "repo", "language").agg(F.max("broken").alias("broken"))
        .groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.col("broken").cast("long")).alias("broken"))
        .withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
    )

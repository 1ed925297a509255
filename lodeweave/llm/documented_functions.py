"""Functions and methods paired with their documentation.

Comment and string spans and declaration spans are taken from the sources independently, each by its
own pattern, as positions in one long axis per batch. An as-of join then gives each declaration its
nearest comment: the last one that ends before it, or, in Python, the first string that starts after its
signature. The pair is rejected if a statement stands between them or if the comment belongs to
another record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

# How comments, strings and declarations are written; a text of another extension is read as Go, else as a script.
_LANGUAGES = {"py": "python", "pyi": "python", "go": "go", **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs"), "script")}
_C_SPANS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_PY_SPANS = re.compile(r"#[^\n]*|(?<![\w])[A-Za-z]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", re.S)
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def\b", re.M)
_PY_SIGNATURE = re.compile(r"[()\[\]{}:]")
_GO_DEF = re.compile(r"^[ \t]*func\b", re.M)
_SCRIPT_DEF = re.compile(
    r"^[ \t]*(?:@[\w$.]+(?:\([^()\n]*\))?[ \t]+)*"
    r"(?:(?:(?:export|default|declare|async)[ \t]+)*function\b|(?:(?:export|declare)[ \t]+)*(?:const|let|var)[ \t]+[\w$]+[^=;\n]*=\s*(?:async\b\s*)?(?:function\b|\(|<|[\w$]+\s*=>)"
    r"|(?:(?:public|private|protected|static|abstract|override|readonly|declare|async|get|set|accessor)[ \t]+)*\*?[ \t]*(?:\#?[A-Za-z_$][\w$]*|\[[^\]\n]*\]|\"[^\"\n]*\"|'[^'\n]*'|\d+)[?!]?\s*"
    r"(?:(?P<open>\()|<[^()=;{}]*>\s*(?P<generic>\()|(?::[^=;\n]*)?=\s*(?:async\b\s*)?(?:function\b|\(|<|[\w$]+\s*=>)))",
    re.M,
)
_STATEMENT = re.compile(r"[ \t]*(?:if|for|while|switch|catch|with|return|throw|new|await|typeof|else|do|try|case|yield|void|delete|super|import)\b")
_BRACKET = re.compile(r"[()\[\]{}]")
_DECORATOR = re.compile(r"@[\w$.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?")
_AFTER_DOC = re.compile(r"[ \t]*(?:[\r\n;#]|\Z|\\\r?\n)")

_DIRECTIVE = re.compile(
    r"\s*(?:go:|\+build|nolint|noqa|type:\s*ignore|pylint|pyright|mypy|flake8|fmt:|yapf|isort|pragma|coverage|nosec|noinspection|eslint|tslint|jshint|jslint|prettier|istanbul|c8 |v8 |biome|deno-|standard|stylelint"
    r"|@ts-|@flow|@jsx|@format|@preserve|@license|@internal\b|@private\b|@public\b|@override\b|@inheritdoc|\{@inheritdoc|sourcemappingurl|webpack|#?region\b|#?endregion\b|lint:|exported?$|line |cgo |skipcq|codeql|sonar|-\*-|vim?:)",
    re.I,
)
_TODO = re.compile(r"\s*(?:[-*]\s*)?(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|N/A|OPTIMIZE|REVIEW)\b", re.I)
_TAG = re.compile(r"\s*(?:@|:|\\)(?:param|arg|argument|return|returns|type|rtype|throws|raises|raise|yields|yield|see|example|template|typeparam|deprecated|since|author|version|default|async|function|method|name|class|memberof|this|todo)\b\s*(?:\{[^}]*\})?", re.I)
_SECTION = re.compile(r"\s*(?:args|arguments|parameters|params|returns?|raises|yields|throws|examples?|notes?|attributes|see also)\s*:?\s*(?:-{3,})?\s*$", re.I)
_NAMED = re.compile(r"\s*[-*]?\s*([A-Za-z_$][\w$]*)\s*(?:\([^)]*\))?\s*(?::|\s-\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|^\s*(?:return|if|elif|for|while|var|let|const|func|def|class|import|from|defer|switch|case|try|except|catch|throw|raise|print|await|yield|with|del|go)\b.*[()=:{;]"
    r"|^\s*[\w$.\[\]\"']+\s*(?:[-+*/|&:]?=|:=|\+\+|--)\s*\S|^\s*(?:await\s+|return\s+)?[\w$]+(?:\.[\w$]+)*\(.*\)\s*[;,]?\s*$|=>|</?\w+>"
)
_REMARK = re.compile(r"(?<=[;{}),])\s*(?://|#|/\*).*$")  # a remark at the end of a line of code
_FENCE = re.compile(r"^\s*```")


def prose(text: str, name: str | None, parameters: set[str]) -> list[str]:
    """The words of a description, without what says nothing: see ``documented_functions``."""
    own = {p for p in parameters}
    if name:
        own.add(name)
        parts = _NAME_PART.findall(name)
        if parts:
            text = re.sub(r"\b" + r"[\s_-]*".join(map(re.escape, parts)) + r"\b", " ", text, flags=re.I)
    words: list[str] = []
    in_tags = fenced = False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip() or _DIRECTIVE.match(line) or _TODO.match(line):
            in_tags = in_tags and bool(line.strip())
            continue
        if m := _TAG.match(line):
            in_tags = True
            line = line[m.end() :]
        elif _SECTION.match(line):
            in_tags = True
            continue
        elif _CODE.search(_REMARK.sub("", line)):
            continue
        elif in_tags and (m := _NAMED.match(line)):
            line = line[m.end() :]
        if in_tags:
            continue
        words += [w for w in _WORD.findall(re.sub(r"[\w$]*(?:_\w+|\$\w*)+", lambda m: " " if m[0] in own else m[0], line)) if w not in own]
    return words


def _comment_text(raw: str) -> str:
    """A comment or string without its marks."""
    if raw.startswith("//"):
        return raw[2:].lstrip("/!")
    if raw.startswith("/*"):
        return re.sub(r"(?m)^[ \t]*\*+(?!/)", "", raw[2:].removesuffix("*/").lstrip("*!"))
    body = raw.lstrip("rRuUbBfF")
    mark = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    return body[len(mark) :].removesuffix(mark)


class _Spans:
    """Spans of one kind over a batch, in the order of their positions."""

    def __init__(self) -> None:
        self.start: list[int] = []
        self.end: list[int] = []

    def add(self, start: int, end: int) -> None:
        self.start.append(start)
        self.end.append(end)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.start, np.int64), np.array(self.end, np.int64)


def _python_signature(text: str, spans: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Where the declaration starts and its signature ends."""
    found = next((m for m in _PY_DEF.finditer(text) if not any(a <= m.start() < b for a, b in spans)), None)
    if not found:
        return None
    depth, at, inside = 0, found.end(), iter([*spans, (len(text), len(text))])
    a, b = next(inside)
    for m in _PY_SIGNATURE.finditer(text, at):
        while m.start() >= b and b < len(text):
            a, b = next(inside)
        if a <= m.start() < b:
            continue
        c = m[0]
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            return found.start(), m.end()
    return None


def _outside(text: str, pattern: re.Pattern, spans: list[tuple[int, int]], at: int = 0) -> Iterator[re.Match]:
    """Matches of a pattern that don't begin in a comment or string."""
    inside = iter([*spans, (len(text) + 1, len(text) + 1)])
    a, b = next(inside)
    for m in pattern.finditer(text, at):
        place = m.end() - len(m[0].lstrip())
        while place >= b:
            a, b = next(inside)
        if not a <= place < b:
            yield m


def _script_declaration(text: str, spans: list[tuple[int, int]]) -> int | None:
    """Where the first function or method of a TypeScript or JavaScript text starts."""
    for m in _outside(text, _SCRIPT_DEF, spans):
        start = m.end() - len(m[0].lstrip())
        if m["open"] or m["generic"]:
            if _STATEMENT.match(text, start):
                continue
            depth, end = 0, len(text)
            for c in _outside(text, _BRACKET, spans, m.end() - 1):
                depth += 1 if c[0] in "([{" else -1
                if depth == 0:
                    end = c.end()
                    break
            after = text[end:].lstrip()
            if after and after[0] not in "{:" and not re.match(r"[ \t]*(?:public|private|protected|static|abstract|override|declare|async|get|set)[ \t]", text[start - 1 if start else 0 :]):
                continue  # a call
        while text[start] == "@":  # decorators on the line of the declaration
            start = _DECORATOR.match(text, start).end()
            start += len(text[start:]) - len(text[start:].lstrip())
        return start
    return None


def attach(texts: list[str], languages: list[str]) -> list[str | None]:
    """The documentation of the declaration in each text, by as-of joins over all spans of the batch."""
    notes, strings, functions = _Spans(), _Spans(), []
    base, blanks = 0, []
    python = [language == "python" for language in languages]
    for i, (text, py) in enumerate(zip(texts, python)):
        found = [m.span() for m in (_PY_SPANS if py else _C_SPANS).finditer(text)]
        for a, b in found:
            if text[a] == "#" or not py and text[a] == "/":
                notes.add(base + a, base + b)
            elif py:
                strings.add(base + a, base + b)
        if py:
            if signature := _python_signature(text, found):
                functions.append((i, base + signature[0], base + signature[1]))
        else:
            start = None if languages[i] == "script" else next((m.end() - 4 for m in _outside(text, _GO_DEF, found)), None)
            if start is None and languages[i] != "go":
                start = _script_declaration(text, found)
            if start is not None:
                functions.append((i, base + start, base + start))
        blanks.append(base)
        base += len(text) + 1
    out: list[str | None] = [None] * len(texts)
    if not functions:
        return out
    row, start, end = (np.array(c, np.int64) for c in zip(*functions))
    begin = np.array(blanks, np.int64)
    note_start, note_end = notes.arrays()
    text_start, text_end = strings.arrays()
    before = np.searchsorted(note_end, start, side="right") - 1  # the last comment that ends before the declaration
    after = np.searchsorted(text_start, end, side="left")  # the first string that starts after the signature
    for r, s, e, k, j in zip(row.tolist(), start.tolist(), end.tolist(), before.tolist(), after.tolist()):
        text, at = texts[r], int(begin[r])
        if python[r]:
            if j < len(text_start) and text_start[j] < at + len(text):
                a, b = int(text_start[j]) - at, int(text_end[j]) - at
                between = re.sub(r"#[^\n]*", "", text[e - at : a])
                raw = text[a:b]
                if not between.strip(" \t\r\n\f\\") and not re.match(r"[A-Za-z]*[bBfFtT]", raw[:2].split("'")[0].split('"')[0]) and _AFTER_DOC.match(text, b):
                    out[r] = _comment_text(raw)
            continue
        parts: list[str] = []
        while k >= 0 and note_start[k] >= at:
            a, b = int(note_start[k]) - at, int(note_end[k]) - at
            between = text[b : s - at]
            if "\n\n" in between.replace("\r", "").replace(" ", "").replace("\t", "") or _DECORATOR.sub("", between).strip():
                break
            parts.append(_comment_text(text[a:b]))
            s, k = at + a, k - 1
        if parts:
            out[r] = "\n".join(reversed(parts))
    return out


_PARAMETER = re.compile(r"[A-Za-z_$][\w$]*")


def documented_functions(symbols: DataFrame, least_words: int = 5) -> DataFrame:
    """(symbol_id, name, signature, code, description, words): functions and methods with a
    description of at least ``least_words`` words of prose, one row for each symbol.

    Not counted: the symbol's own name (also in separate words), its parameters, tags and what is said
    for them, to-do lines, directives for tools, rulers and code. Needs the columns symbol_id,
    file_path, name, kind, content and signature; others are left out. Null content has no
    description; a null name or signature just can't be discounted; of several rows of one symbol_id the
    least pair stands.
    """
    source = symbols.where("kind in ('function', 'method') and content is not null and symbol_id is not null").select("symbol_id", "file_path", "name", "signature", F.col("content").cast("string").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, names, signatures, contents = (c.to_pylist() for c in batch.columns)
            docs = attach(contents, [_LANGUAGES.get((p or "").rpartition(".")[2].lower(), "") for p in paths])
            keep, described, counts = [], [], []
            for i, (doc, name, signature) in enumerate(zip(docs, names, signatures)):
                if doc:
                    n = len(prose(doc, name, set(_PARAMETER.findall(signature or "")) - {name}))
                    if n >= least_words:
                        keep.append(i)
                        described.append(doc.strip())
                        counts.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), batch.column(4).take(at), pa.array(described, pa.string()), pa.array(counts, pa.int32())], ["symbol_id", "name", "signature", "code", "description", "words"])

    pairs = spread(source).mapInArrow(run, "symbol_id long, name string, signature string, code string, description string, words int")
    rest = F.struct("name", "signature", "code", "description", "words")
    return pairs.groupBy("symbol_id").agg(F.min(rest).alias("pair")).select("symbol_id", "pair.*")

"""Symbols, imports, calls and type references of source files, as table functions over files.

Comments and strings are blanked first, positions kept, so that what they quote is no declaration.
Declarations are then found by pattern and their nesting by brackets or, in Python, by indentation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import spread

SYMBOL = "file_id long, repo string, file_path string, start_line int, end_line int, name string, kind string, signature string, class_name string, is_exported boolean, content string, decorators array<string>"
IMPORT = "file_id long, repo string, file_path string, start_line int, module_path string, is_relative boolean, alias string"
CALL = "file_id long, repo string, file_path string, start_line int, name string, receiver string, package string"
TYPE = "file_id long, repo string, file_path string, start_line int, name string, role string"

_PY_QUIET = re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)
_C_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_RAW_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)

_PY_DECL = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w., \t]+))", re.M)
_GO_ALIAS = re.compile(r"^type[ \t]+(\w+)(?:\[[^\]]*\])?[ \t]+(?:=[ \t]*)?(?![ \t=]|struct\b|interface\b)([^\n]+)", re.M)
_GO_RECEIVER = re.compile(r"^func[ \t]*\(\s*(\w+)\s+\*?(\w+)", re.M)
_TS_OTHER = re.compile(r"^(?:(export)[ \t]+)?(?:declare[ \t]+)?(?:const[ \t]+)?(?:(enum)[ \t]+(\w[\w$]*)|(type)[ \t]+(\w[\w$]*)[^=;\n]*=)", re.M)
_CALL_SITE = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*\.\s*)?([A-Za-z_$][\w$]*)\s*\(")
_DECORATOR_LINE = re.compile(r"[ \t]*@([\w$.]+)")
# Words before a bracket that call nothing.
_NO_CALLS = {
    ".py": {"if", "for", "while", "with", "def", "class", "return", "elif", "and", "or", "not", "in", "is", "lambda", "yield", "await", "assert", "del", "except", "print"},
    ".go": {"if", "for", "func", "switch", "return", "select", "go", "defer", "range", "case", "type", "map", "chan", "struct", "interface", "var", "const", "import"},
    ".ts": {"if", "for", "while", "switch", "catch", "function", "return", "new", "await", "typeof", "constructor", "super", "import", "else", "throw", "do", "with", "yield", "void", "delete", "async"},
}
_PY_TYPES = re.compile(r"(->|[:,(]\s*\*{0,2}\w+\s*:)\s*([A-Za-z_][\w.]*)")
_TS_TYPES = re.compile(r"(\)\s*:|[\w$?]\s*:)\s*([A-Z][\w$.]*)")
_GO_FUNC = re.compile(r"^func[ \t]*(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)[ \t]*)?(\w+)\s*(?:\[[^\]]*\])?\(", re.M)
_GO_TYPE = re.compile(r"^type[ \t]+(\w+)(?:\[[^\]]*\])?[ \t]+(struct|interface)\b", re.M)
_GO_IMPORT = re.compile(r"^import[ \t]*(?:\(([^)]*)\)|[ \t]*(?:[\w.]+[ \t]+)?\"([^\"]*)\")", re.M)
_TS_DECL = re.compile(r"^(?:(export)[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:(?:async[ \t]+)?(function)\b[ \t]*\*?[ \t]*(\w[\w$]*)|(class|interface)[ \t]+(\w[\w$]*)|(?:const|let|var)[ \t]+(\w[\w$]*)[^=;\n]*=[ \t]*(?:async[ \t]*)?(?:\([^;{]*?\)|\w+)[^=;{}()]*(?:<[^;{}()]*>)?[^=;{}()]*=>)", re.M)
_TS_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|override|async|get|set|abstract)[ \t]+)*\*?(#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>(]*>)?\(", re.M)
_TS_IMPORT = re.compile(r"^[ \t]*(?:import|export)\b[^;'\"`]*?(?:\bfrom[ \t\n]*)?(['\"])([^'\"\n]+)\1", re.M)
_TS_NOT = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "throw", "await", "new", "typeof", "do", "else", "with"}


def _blank(text: str, quiet: re.Pattern) -> str:
    """The text with strings and comments as white space of the same lines."""
    return quiet.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _signature(text: str, start: int, paren: int) -> str:
    """From a name to the end of its head, on one line, without a comma after the last parameter."""
    end = _close(text, paren)
    stop = re.compile(r"[{\n]|=>").search(text, end)
    return _tidy(text[start : stop.start() if stop else len(text)]).rstrip(":")


def _tidy(text: str) -> str:
    return re.sub(r",? *([)\]])", r"\1", re.sub(r"([(\[]) ", r"\1", re.sub(r"\s+", " ", text).strip()))


def _block_end(bare: str, start: int) -> int:
    """Where the bracket block that follows ends; the end of the line if none does."""
    line = bare.find("\n", start)
    brace = bare.find("{", start)
    return _close(bare, brace) if brace >= 0 and not bare[start:brace].strip("\n\t )]};,") else line if line >= 0 else len(bare)


def _python_end(bare: str, start: int, depth: int) -> int:
    """Where the lines that are indented deeper than ``depth`` end; blank lines and remarks after them don't count."""
    end = at = bare.find("\n", start)
    while at >= 0:
        after = bare.find("\n", at + 1)
        line = bare[at + 1 : after if after >= 0 else len(bare)]
        if line.strip():
            if len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip()) <= depth:
                return end
            end = after if after >= 0 else len(bare)
        at = after
    return end if end >= 0 else len(bare)


def python_symbols(text: str) -> Iterator[tuple]:
    bare = _blank(text, _PY_QUIET)
    classes: list[tuple[int, str]] = []
    functions: list[int] = []
    for m in _PY_DECL.finditer(bare):
        depth = len(m[1].expandtabs(8))
        while classes and classes[-1][0] >= depth:
            classes.pop()
        while functions and functions[-1] >= depth:
            functions.pop()
        inside = classes[-1][1] if classes and (not functions or functions[-1] < classes[-1][0]) else ""
        if functions and (not classes or functions[-1] > classes[-1][0]):
            functions.append(depth)
            continue  # of a function's own body
        paren = bare.find("(", m.end())
        if m[2] == "class":
            head = bare[m.start(2) : bare.find(":", m.end())]
            yield m.start(), _python_end(bare, m.start(), depth), m[3], "class", re.sub(r"\s+", " ", head).strip(), "", not m[3].startswith("_")
            classes.append((depth, m[3]))
        else:
            yield m.start(), _python_end(bare, _close(bare, paren), depth), m[3], "method" if inside else "function", _signature(text, m.start(3), paren), inside, not m[3].startswith("_")
            functions.append(depth)


def _go_end(bare: str, start: int) -> int:
    """Where a declaration at the left margin ends: the next closing brace there, unless it is on one line."""
    line = bare.find("\n", start)
    if line < 0 or bare[start:line].count("{") == bare[start:line].count("}"):
        return line if line >= 0 else len(bare)
    close = re.compile(r"^\}", re.M).search(bare, line)
    return close.end() if close else len(bare)


def go_symbols(text: str) -> Iterator[tuple]:
    bare = _blank(text, _RAW_QUIET)
    for m in _GO_FUNC.finditer(bare):
        yield m.start(), _go_end(bare, m.start()), m[2], "method" if m[1] else "function", _signature(text, m.start(2), m.end() - 1), m[1] or "", m[2][:1].isupper()
    for m in _GO_TYPE.finditer(bare):
        yield m.start(), _go_end(bare, m.start()), m[1], "class" if m[2] == "struct" else "interface", f"type {m[1]} {m[2]}", "", m[1][:1].isupper()
    for m in _GO_ALIAS.finditer(bare):
        yield m.start(), _go_end(bare, m.start()), m[1], "type_alias", f"type {m[1]}", "", m[1][:1].isupper()


def script_symbols(text: str) -> Iterator[tuple]:
    bare = _blank(text, _C_QUIET)
    for m in _TS_DECL.finditer(bare):
        name = m[3] or m[5] or m[6]
        kind = m[4] or "function"
        start = m.start(4) if m[4] else m.start(3) if m[3] else m.start(6)
        brace = bare.find("{", m.end())
        if m[4]:
            signature = re.sub(r"\s+", " ", bare[start : brace if brace > 0 else len(bare)]).strip()
            end = _close(bare, brace) if brace > 0 else len(bare)
        else:
            paren = bare.find("(", start)
            signature = name + _signature(text, paren, paren) if paren > 0 else name
            end = _script_end(bare, m.end() if m[6] else _close(bare, paren))
        yield m.start(), end, name, kind, signature, "", bool(m[1])
        if m[4] == "class" and brace > 0:
            at = brace + 1
            while p := _TS_METHOD.search(bare, at, end):
                close = _close(bare, p.end() - 1)
                body = re.compile(r"[{;\n]").search(bare, close)
                if p[1] not in _TS_NOT and body and body[0] == "{":
                    at = _close(bare, body.start())
                    yield p.start(), at, p[1], "method", p[1] + _signature(text, p.end() - 1, p.end() - 1), name, p[1][0] != "#" and not re.search(r"\b(?:private|protected)\b", p[0])
                else:
                    at = close
    for m in _TS_OTHER.finditer(bare):
        yield m.start(), _script_end(bare, m.end()), m[3] or m[5], "enum" if m[2] else "type_alias", re.sub(r"\s+", " ", m[0].rstrip("= ")), "", bool(m[1])


def _script_end(bare: str, at: int) -> int:
    """Where a function's body or a statement that goes on at ``at`` ends: after its block, or before the line break or after the semicolon outside of brackets."""
    for m in re.compile(r"[\n;{(\[]").finditer(bare, at):
        if m.start() < at or m[0] == "\n" and not bare[at : m.start()].strip():
            continue
        if m[0] == "{":
            end = _close(bare, m.start())
            return end + (bare[end : end + 1] == ";")
        if m[0] in "([":
            at = _close(bare, m.start())
        else:
            return m.end() if m[0] == ";" else m.start()
    return len(bare)


def python_imports(text: str) -> Iterator[tuple]:
    for m in _PY_IMPORT.finditer(_blank(text, _PY_QUIET)):
        for part in [m[1]] if m[1] is not None else [x for x in m[2].split(",") if x.strip()]:
            words = part.split()
            yield m.start(), m.end(), words[0], words[0].startswith("."), words[2] if len(words) == 3 and words[1] == "as" else ""


def go_imports(text: str) -> Iterator[tuple]:
    quiet = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
    for m in _GO_IMPORT.finditer(_blank(text, quiet)):
        for p in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]*)\"", m[0]):
            yield m.start() + p.start(), m.start() + p.end(), p[2], p[2].startswith("."), p[1] if p[1] and p[1] != "import" else ""


def script_imports(text: str) -> Iterator[tuple]:
    bare = _blank(text, re.compile(r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`", re.S))
    for m in _TS_IMPORT.finditer(bare):
        if bare[m.start() :].lstrip().startswith("import") or re.search(r"\bfrom\s*['\"]", m[0]):
            alias = re.search(r"\*\s*as\s+([\w$]+)", m[0])
            yield m.start(), m.end(), m[2], m[2].startswith("."), alias[1] if alias else ""


def calls_of(text: str, extension: str) -> Iterator[tuple]:
    """(start, end, name, receiver, package) of every call.

    What stands before the dot is, in this order, the name of an imported package, which is then given
    instead of a receiver; the receiver of the method around it, whose class is given; or just a name.
    """
    kind = extension if extension in (".py", ".go") else ".ts"
    quiet = {".py": _PY_QUIET, ".go": _RAW_QUIET}.get(kind, _C_QUIET)
    bare = _blank(text, quiet)
    imported = {(alias or re.split(r"[/.]", module)[-1]): module for _, _, module, _, alias in _PARSERS[extension][1](text)}
    owners = [(start, end, cls) for start, end, _, _, _, cls, _ in _PARSERS[extension][0](text) if cls]
    variables = {m.start(): m[1] for m in _GO_RECEIVER.finditer(bare)} if kind == ".go" else {}
    for m in _CALL_SITE.finditer(bare):
        before = bare[max(0, m.start() - 12) : m.start()].split()
        if m[2] in _NO_CALLS[kind] or before and before[-1] in ("def", "func", "function", "class"):
            continue
        receiver, package = m[1] or "", ""
        around = next((o for o in owners if o[0] <= m.start() < o[1]), None)
        if around and kind == ".ts" and m.start(2) <= bare.find("(", around[0]) < m.end() or kind == ".go" and re.match(r"func\s*\([^)]*\)\s*\Z", bare[bare.rfind("\n", 0, m.start()) + 1 : m.start(2)]):
            continue  # the declaration itself
        if receiver in imported:
            receiver, package = "", imported[receiver]
        elif around and receiver and receiver in ("self", "cls", "this", variables.get(around[0])):
            receiver = around[2]
        yield m.start(), m.end(), m[2], receiver, package


def types_of(text: str, extension: str) -> Iterator[tuple]:
    """(start, end, name, role) of the types that annotations name: ``return``, ``param`` or ``field``."""
    if extension == ".go":
        return
    for start, _, name, kind, signature, _, _ in _PARSERS[extension][0](text):
        if kind in ("function", "method"):
            for m in (_PY_TYPES if extension == ".py" else _TS_TYPES).finditer(signature):
                yield start, start, m[2].rpartition(".")[2], "return" if m[1][0] in "-)" else "param"


_PARSERS = {".py": (python_symbols, python_imports), ".go": (go_symbols, go_imports), **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), (script_symbols, script_imports))}


def _lead(lines: list[str], line: int) -> int:
    """The first of the comment and decorator lines that stand directly above a line (numbers from 0)."""
    first = line
    while first and (above := lines[first - 1].strip()):
        if above.startswith(("//", "#", "@")) or above.startswith("/*") and above.endswith("*/"):
            first -= 1
        elif above.endswith("*/"):
            start = first - 1
            while start and not lines[start].lstrip().startswith("/*"):
                start -= 1
            first = start
        elif above.endswith(")"):  # a decorator of several lines
            start = first - 1
            while start and not lines[start].lstrip().startswith("@") and lines[start].strip() and lines[start].startswith((" ", "\t", ")")):
                start -= 1
            if not lines[start].lstrip().startswith("@"):
                break
            first = start
        else:
            break
    return first


def _parsed(files: DataFrame, which: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for file_id, repo, rel, content in zip(*(c.to_pylist() for c in batch.columns)):
                extension = "." + (rel or "").rpartition("/")[2].rpartition(".")[2].lower()
                if content is None or extension not in _PARSERS:
                    continue
                text = content.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                breaks = [m.start() for m in re.finditer("\n", text)]
                lines = text.split("\n") if which == "symbols" else []
                find = {"symbols": _PARSERS[extension][0], "imports": _PARSERS[extension][1]}.get(which)
                found = find(text) if find else (calls_of if which == "calls" else types_of)(text, extension)
                for start, end, *fields in found:
                    first = bisect_right(breaks, start - 1)
                    place = (file_id, repo, f"{repo}/{rel}")
                    if which == "symbols":
                        last, lead = bisect_right(breaks, end - 1), _lead(lines, first)
                        rows.append((*place, lead + 1, last + 1, *fields, "\n".join(lines[lead : last + 1]), [m[1] for x in lines[lead:first] if (m := _DECORATOR_LINE.match(x))]))
                    else:
                        rows.append((*place, first + 1, *fields))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    kind = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in schema.split(", ")])
    return spread(files.where("file_id is not null").select("file_id", "repo", "rel_path", F.col("content").cast("binary"))).mapInArrow(run, schema)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Every function, method, class, interface, type alias and enum that is declared at the top or in a
    class: (file_id, repo, file_path, start_line, end_line, name, kind, signature, class_name, is_exported,
    content, decorators).

    Content begins with the comment and decorator lines directly above. Null content and unknown
    extensions have none; a file that doesn't parse gives what can be found; repeated rows stay repeated.
    """
    return _parsed(files, "symbols", SYMBOL)


def parse_imports(files: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, start_line, module_path, is_relative, alias) of every import statement's modules."""
    return _parsed(files, "imports", IMPORT)


def parse_calls(files: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, start_line, name, receiver, package) of every call site; see ``calls_of``."""
    return _parsed(files, "calls", CALL)


def parse_types(files: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, start_line, name, role) of the types in the signatures of functions and methods."""
    return _parsed(files, "types", TYPE)

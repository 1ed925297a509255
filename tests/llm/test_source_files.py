"""Broken files, foreign files and documented functions."""

import ast

import pytest
from pyspark.sql import functions as F

from lodeweave.llm.broken_files import Checkers, broken_files, broken_rates, verdict
from lodeweave.llm.documented_functions import attach, documented_functions, prose
from lodeweave.llm.foreign_files import by_header, by_layout, by_path, copied_directories, foreign_files

CHECKERS = Checkers()
LANGUAGE = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}


def broken(extension, text):
    language = LANGUAGE[extension]
    return verdict(CHECKERS.of(language, extension), language, text if isinstance(text, bytes) else text.encode())


GOOD = {
    ".py": [
        "", "\ufeffx = 1\r\ny = 2\r\n", "# only a remark", "def f(a, /, b: int = 1, *args, c, **kw) -> dict[str, int]:\n    '''doc'''\n    return {**kw, 'a': [*args]}\n",
        "@app.route('/x')\nasync def g():\n    async with a as b, c:\n        async for x in y:\n            await z\n", "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case A(b=1) | None:\n        pass\n    case _:\n        pass\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "class A[T](B, metaclass=M): x: int = 1; y = 2\n", "x = [i async for i in y if (n := i) > 1 for j in n]\nlambda *a, k=1: (yield)\n",
        "if a:\n\tb\nelif c: d\nelse:\n\te\n", "with (a as b, c as d,):\n    pass\n", "f'{x!r:>{w}}' 'b' \"\"\"c\nd\"\"\"\n", "print(*a, sep='')\nx[1:2, ..., ::3] @= y\ntype A = int\nmatch = case = 1\n", "a = b = c, *d = e\ndel a[0], b.c\nglobal x\n", "x = (\n    1,\n    2)\\\n  + 3\n",
    ],
    ".go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = 1, 2\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n",
        "package a\n\nfunc (t *T) F(a, b int, c ...string) (n int, err error) {\n\tfor i := 0; i < 10; i++ {\n\t\tif v, ok := m[k]; ok && v != (T{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tfor k, v := range m {\n\t\tgo func() { _ = k }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\treturn\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}, nil\n}\n",
        "package a\n\nvar f = func(x int) int { return x }\nvar r = 'a'\nvar s = `raw\n<<<<<<< HEAD\n`\nvar z = []struct{ a int }{{1}, {2}}\n", "package a\n\ntype I interface {\n\tM(int) string\n\t~int | string\n\tfmt.Stringer\n}\n\nfunc G[T any](x T) { L: for { break L } }\n",
    ],
    ".ts": [
        "", "import a, { b as c, type D } from 'x';\nexport * as q from 'y'\nexport default class A<T extends B = C> extends D<T> implements E, F {\n  private readonly x?: number = 1\n  static async *g(this: A, ...r: string[]): AsyncGenerator<T> { yield* r }\n  get y(): number { return 1 }\n  [key: string]: unknown\n  constructor(public z: string) { super() }\n}\n",
        "const f = async <T>(x: T, { a, b: [c] = [] }: P = {}): Promise<Map<string, Array<T>>> => { await x; return new Map() }\n", "type A = { [K in keyof T]?: T[K] } | (string & {}) | `a${B}`\ntype C = A extends infer U ? U[] : never\nenum E { A = 1, B, 'c' }\ndeclare module 'x' { export const y: number }\n",
        "let a = b as unknown as C\na!.b?.[0]?.(1)\nconst r = /[/\\]]\\/x/gi.test(s) ? a / b / c : `x${`y${z}`}`\nlabel: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break }\n", "function isA(x: unknown): x is A { switch (x) { case 1: default: throw new Error('a') } }\n", "interface A extends B<C> { (x: number): string; new (): A; readonly y: string, z?(): void }\n",
        "abstract class X { abstract f(): void; protected constructor() {} }\nexport type { A } from './a'\ndo { x++ } while (x < 3)\ntry { a() } catch { b() } finally { c() }\n",
    ],
    ".js": ["export const a = (x) => ({ ...x, b() {}, get c() { return 1 }, [d]: 2 })\nclass A { #p = 1; static { this.x = 1 } m() { return this.#p } }\n", "var x = function* () { yield 1 }, y = a ?? b, z = a ** 2\nif (a) b(); else if (c) d()\nfor (;;) {}\nfor await (const x of y) z\n", "#!/usr/bin/env node\nimport.meta.url\nconst { a = 1, ...r } = b, [c, , d] = e\n"],
    ".tsx": ["const a = <div className=\"x\" {...p} onClick={() => f(`a`)}>it's {b ? <B.C key={1} /> : null} text <></></div>;\nconst f = <T,>(x: T) => x\n"],
    ".jsx": ["export default function A() {\n  return (\n    <ul>\n      {items.map((i) => <li key={i}>{i} isn't</li>)}\n      {/* none */}\n    </ul>\n  )\n}\n"],
}
BAD = {
    ".py": ["print 'a'\n", "def f(:\n    pass\n", "if a:\nb\n", "  x = 1\n", "x = (1,\n", "'''open\n", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "try:\n    pass\nx = 1\n", "x = 1 +\n", "class A\n    pass\n", "else:\n    pass\n", "f(a b)\n", "if a:\n    b\n  c\n", "x = 08\n", "1 = x\n", "// no\n", b"x = '\xe9'\n", b"x\0", "def f():\n    return 1\n}\n"],
    ".go": ["", "x := 1\n", "package a\nfunc f() {\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nimport \"a\" \"b\"\n", "package a\nvar x = []int{\n\t1\n}\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nvar s = \"open\n", "package a\nfunc f(a int b int) {}\n", "package a\n<<<<<<< HEAD\n", "class A {}\n"],
    ".ts": ["const x\n", "const a = ;\n", "function f( { }\n", "a b\n", "if (x) {\n", "`open ${x}", "/* open", "import a from\n", "=======\n", "x = {} y\n", "class A { m() { } \n", "def f(x):\n    return x\n", "let a = 'open\n", "{\n  \"a\": 1, \"b\": 2\n}\n", "<div>no</div>\n"],
    ".js": ["let x: number = 1\n", "interface A {}\n", "const a = b as C\n", "return (\n", "function f(a?: b) {}\n", "export const x = [1, 2\n"],
    ".tsx": ["const a = <div>open\n", "const a = <a></b>\n"],
    ".jsx": ["const a = <A b={>x</A>\n"],
}


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_accepted(extension, text):
    assert broken(extension, text) is None


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_rejected(extension, text):
    found = broken(extension, text)
    assert found is not None
    assert 0 <= found[0] <= len(text) + 1


def test_own_modules_are_python():
    import glob
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = glob.glob(f"{root}/lodeweave/**/*.py", recursive=True) + sorted(glob.glob(f"{os.path.dirname(ast.__file__)}/*.py"))[:80]
    wrong = []
    for path in paths:
        with open(path, "rb") as f:
            content = f.read()
        assert verdict(CHECKERS.of("python", ".py"), "python", content) is None, path
        if not CHECKERS.of("python", ".py").accepts(content.decode("utf-8").replace("\r\n", "\n")):
            wrong.append(path)
    assert len(wrong) <= 0.02 * len(paths)  # strings within strings of the same quotes, which the exact check then accepts


def test_cause_and_position():
    assert broken(".py", "x = 1\nif a:\n    y\n<<<<<<< HEAD\n    z\n=======\n    w\n>>>>>>> b\n")[1] == "merge conflict"
    assert broken(".go", "package a\n\nfunc f() {\n\tx(") == (25, "cut off")
    assert broken(".ts", "const a = 1;\nconst b = ;\n")[0] == 23


def test_broken_operator(spark):
    types = spark.createDataFrame([(".py", "python"), (".go", "go"), (None, "x")], "extension string, language string")
    rows = [(1, "r", "a.py", b"x = 1"), (2, "r", "b.py", b"x = "), (3, "r", "c.go", b""), (4, "r", "d.py", None), (5, None, "e.py", b""), (6, "r", "f.txt", b"?"), (7, "r", None, b"?"), (2, "r", "b.py", b"x = "), (8, "r", "G.PY", b"(" * 50_000)]
    df = spark.createDataFrame(rows, "file_id long, repo string, rel_path string, content binary").withColumn("broken", F.lit("clash"))
    got = broken_files(df, types)
    assert {r.file_id: r.broken for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 8: True}
    assert {(r.repo, r.language): (r.files, r.broken) for r in broken_rates(got).collect()} == {("r", "python"): (4, 2), (None, "python"): (1, 0), ("r", "go"): (1, 1)}
    assert broken_files(df.limit(0), types).count() == 0


@pytest.mark.parametrize(
    ("path", "reason"),
    [("vendor/a/b.go", "vendored"), ("x/node_modules/y.js", "vendored"), ("a/vendors/b.ts", None), ("a/vendoring.py", None), ("a/x_pb2.py", "generated"), ("a/x.pb.go", "generated"), ("a/__generated__/x.ts", "generated"), ("a/generator.py", None), ("a/x.min.js", "minified"), ("a/minimal.js", None), (None, None), ("", None)],
)
def test_by_path(path, reason):
    assert by_path(path) == reason


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("// Code generated by tool v1.2; DO NOT EDIT.\npackage a\n", "generated"), ("/* (c) x */\n\n/**\n * @generated by x\n */\nclass A {}", "generated"), ('"""AUTO-GENERATED FILE. Do not modify. (x)"""\n', "generated"), ("# Diese Datei wurde automatisch von x erzeugt.\n", "generated"),
        ("# Vendored copy of X 1.2; see PATCHES.\n", "vendored"), ("// X v1.2.3 | upstream: https://x.example\n", "vendored"), ("x = 'Code generated by y. DO NOT EDIT.'\n", None), ("def f():\n    # Code generated by z. DO NOT EDIT.\n    pass\n", None),
        ("# Copyright (c) 2001 the X authors.\nx = 1\n", None), ('"""Tools that look for generated files, which nobody should edit."""\n', None), ("", None),
    ],
)
def test_by_header(text, reason):
    assert by_header(text) == reason


def test_by_layout():
    assert by_layout("!function(e,t){e.a=t.b||1}(x,y);" * 60) == "minified"
    assert by_layout("export const a = [" + "1, 0x2f, 33, " * 200 + "]") == "data"
    assert by_layout("DATA = [\n" + '  ["a-1", 0.25, 3],\n' * 100 + "]\n") == "data"
    assert by_layout('x = "' + "aB3/" * 500 + '"\n') == "data"
    assert by_layout("def f(a):\n    return g(a, 1)\n" * 100) is None
    assert by_layout('"""' + "words of a long text. " * 100 + '"""\ndef f():\n    return 1\n') is None
    assert by_layout("") is None


def test_layout_of_short_strings():
    words = "".join(f'  "{a}{b}{c}",\n' for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo") for c in ("b", "d", "g", "l", "n"))
    assert by_layout("WORDS = [\n" + words * 2 + "]\n") == "data"
    assert by_layout("NAMES = {\n" + words.replace('",', '": "x",') * 2 + "}\n") == "data"
    encoded = "".join('  "' + "abcdEFGH" * 8 + '",\n' for _ in range(40))
    assert by_layout("# one\n" * 45 + "KEY = [\n" + encoded + "]\n") == "data"


def test_deep_directories(spark):
    deep = "/".join(["d"] * 66)
    rows = [(r, f"same/{deep}/x.py", 900, 1, 1) for r in ("r1", "r2")] + [(r, f"other/{deep}/x.py", 900, n, n) for n, r in ((2, "r1"), (3, "r2"))] + [(r, "other/top.py", 900, 4, 4) for r in ("r1", "r2")]
    got = copied_directories(spark.createDataFrame(rows, "repo string, rel_path string, size long, h1 long, h2 long"))
    assert {tuple(r) for r in got.collect()} == {(r, "same" + "/d" * n) for r in ("r1", "r2") for n in range(67)}


def test_hundred_levels(spark):
    deep = "/".join(f"d{i}" for i in range(100))
    rows = [(r, f"{deep}/x.py", 900, 1, 1) for r in ("r1", "r2")] + [("r1", "own.py", 900, 2, 2)]
    got = copied_directories(spark.createDataFrame(rows, "repo string, rel_path string, size long, h1 long, h2 long"))
    assert got.count() == 200


def test_related_repositories(spark):
    whole = [(r, f"lib/{f}.py", 900, ord(f), 7) for r in ("fork", "origin") for f in "ab"]
    schema = "repo string, rel_path string, size long, h1 long, h2 long"
    assert copied_directories(spark.createDataFrame(whole, schema)).count() == 0
    third = [("third", f"deps/{f}.py", 900, ord(f), 7) for f in "ab"]
    assert {tuple(r) for r in copied_directories(spark.createDataFrame(whole + third, schema)).collect()} == {("fork", "lib"), ("origin", "lib"), ("third", "deps")}


def test_copied_directories(spark):
    def tree(repo, base, text):
        return [(repo, f"{base}/a/x.py", 400, hash(text), 1), (repo, f"{base}/a/y.py", 300, hash(text + "y"), 1), (repo, f"{base}/z.py", 300, hash(text + "z"), 1)]

    rows = tree("r1", "lib/copied", "t") + tree("r2", "deep/er/other", "t") + tree("r3", "lib", "u") + [("r1", "p/__init__.py", 1, 5, 5), ("r2", "q/__init__.py", 1, 5, 5), ("r1", "lib/own.py", 900, 9, 9), (None, "a/b.py", 1, 1, 1), ("r4", None, 1, 1, 1), ("r4", "top.py", 1, 1, 1)]
    got = copied_directories(spark.createDataFrame(rows, "repo string, rel_path string, size long, h1 long, h2 long"))
    assert {tuple(r) for r in got.collect()} == {("r1", "lib/copied"), ("r1", "lib/copied/a"), ("r2", "deep/er/other"), ("r2", "deep/er/other/a")}


def test_foreign_operator(spark):
    code = lambda n: (f"def function_{n}(value):\n    return other_{n}(value) + {n}\n" * 12).encode()
    rows = [(1, "r1", "inner/pkg/a.py", code(1)), (2, "r1", "inner/pkg/b.py", code(2)), (3, "r2", "x/a.py", code(1)), (4, "r2", "x/b.py", code(2)), (5, "r1", "own.py", code(5)), (6, "r1", "vendor/v.py", None), (7, "r1", "n.py", None), (8, "r1", "e.py", b""), (9, None, None, code(9)), (5, "r1", "own.py", code(5)), (10, "r3", "g.go", b"// Code generated by x. DO NOT EDIT.\npackage a\n")]
    df = spark.createDataFrame([(*r, None) for r in rows], "file_id long, repo string, rel_path string, content binary, scanned_at timestamp").withColumn("reason", F.lit("clash"))
    assert {r.file_id: r.reason for r in foreign_files(df).collect()} == {1: "vendored", 2: "vendored", 3: "vendored", 4: "vendored", 6: "vendored", 10: "generated"}
    assert foreign_files(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "python", "doc"),
    [
        ("def f(a: str = ')'):\n    \"\"\"Says what.\"\"\"\n    return 1", True, "Says what."), ("@d('x')\nasync def f(\n    a,\n):\n    # note\n    r'''Raw.'''\n", True, "Raw."), ("# above\ndef f():\n    return 'x'", True, None), ("def f():\n    x = '''no'''", True, None), ("def f():\n    '''a'''.strip()", True, None),
        ("def f():\n    def g():\n        '''inner'''", True, None), ("def f(): 'one line'", True, "one line"), ("def f():\n    f'''no {x}'''", True, None), ("// One.\n// Two.\nfunc f() {}", False, "One.\n Two."), ("/** Doc. */\n@dec({ a: 1 })\nexport function f() {}", False, "Doc. "), ("func f() {\n\t// inside\n}", False, None),
        ("// Far.\n\nfunc f() {}", False, None), ("// Other.\nx()\nfunc f() {}", False, None), ("", False, None), ("", True, None), ("x = 1", True, None),
    ],
)
def test_attach(text, python, doc):
    (got,) = attach([text], ["python" if python else "go" if "func " in text else "script"])
    assert (got and got.strip()) == (doc and doc.strip())


def test_attach_keeps_records_apart():
    assert attach(["// Doc of another.", "func f() {}"], ["go", "go"]) == [None, None]


@pytest.mark.parametrize(
    ("text", "name", "parameters", "n"),
    [
        ("getThing returns the thing that was asked for", "getThing", set(), 7), ("get thing", "getThing", set(), 0), ("TODO: say what this function really does here", "f", set(), 0), ("@param a the first value of all values\n@returns a good many words here", "f", {"a"}, 0), (":param a:\n:param b:", "f", {"a", "b"}, 0),
        ("go:noinline\nnolint:all // because of the line above it", "f", set(), 0), ("x.call(y, 1); // some words that stand behind", "f", set(), 0), ("----------", "f", set(), 0), ("Computes the sum of all\n\nArgs:\n    a: the first of the two values", "f", {"a"}, 5), ("for each value it keeps a copy", "f", set(), 7), ("", None, set(), 0),
    ],
)
def test_prose(text, name, parameters, n):
    assert len(prose(text, name, parameters)) == n


def test_documented_operator(spark):
    doc = "// Returns the greatest of all the given values.\n"
    rows = [(1, "r/a.go", "f", "function", doc + "func f() {}", "f()"), (2, "r/a.go", "g", "function", "func g() {}", None), (3, "r/a.go", None, "method", doc + "func h() {}", None), (4, "r/a.go", "C", "class", doc, ""), (5, "r/a.go", "k", "function", None, ""), (6, None, "m", "function", doc + "func m() {}", ""), (1, "r/a.go", "f", "function", doc + "func f() {}", "f()"), (7, "r/b.py", "p", "function", "def p():\n    '''" + "long words " * 50_000 + "'''", "p()"), (8, "r/a.go", "e", "function", "", "")]
    df = spark.createDataFrame(rows, "symbol_id long, file_path string, name string, kind string, content string, signature string").withColumn("words", F.lit("clash"))
    got = documented_functions(df)
    assert {r.symbol_id for r in got.collect()} == {1, 3, 6, 7}
    assert got.where("symbol_id = 1").first().description == "Returns the greatest of all the given values."
    assert documented_functions(df.limit(0)).count() == 0


@pytest.mark.parametrize(("language", "code"), [
    ("script", "// Says what the function does.\nconst limit = 1;\nfunction foo() {}"),
    ("script", "/* Says what the method does. */\nfield = 2;\n  async run(a) {\n  }"),
    ("script", "// Says what the function does.\nfoo(1);\nexport const bar = (x) => x;"),
    ("go", "// Foo says what the function does.\nvar limit = 1\nfunc Foo() {}"),
    ("python", 'def foo():\n    x = 1\n    """Says what the function does."""\n'),
])
def test_statement_between_rejects(language, code):
    assert attach([code], [language]) == [None]


@pytest.mark.parametrize(("language", "code"), [
    ("script", "// Says what it does.\n@route('/a')\n@log()\nexport async function foo() {}"),
    ("script", "// Says what it does.\n  static async *run<T>(a: T): Promise<T> {\n  }"),
    ("script", "// Says what it does.\nexport const bar = async (x) => x;"),
    ("script", "// Says what it does.\n  @memo() get size() { return 1; }"),
    ("script", "const limit = 1;\n// Says what it does.\nfunction foo() {}"),
    ("go", "var limit = 1\n// Says what it does.\nfunc (s *Set[T]) Foo() {}"),
    ("python", 'def foo(\n    a,\n):\n    """Says what it does."""\n'),
])
def test_nearest_comment_is_attached(language, code):
    assert [d.strip() for d in attach([code], [language])] == ["Says what it does."]


def test_one_pair_for_each_symbol(spark):
    row = (1, "r/a.py", "foo", "function", 'def foo():\n    """Collects all open orders of one customer."""\n', None)
    other = (1, "r/a.py", "foo", "function", 'def foo():\n    """Gathers all open orders of one customer."""\n', None)
    df = spark.createDataFrame([row, row, other], "symbol_id long, file_path string, name string, kind string, content string, signature string").withColumn("description", F.lit(1))
    assert [r.description for r in documented_functions(df).collect()] == ["Collects all open orders of one customer."]


@pytest.mark.parametrize(("extension", "text"), [
    *((".ts", f"export default {x}\n") for x in ("class {}", "class extends B {}", "function () {}", "abstract class {}", "class implements I {}", "async function* named() {}")),
    (".ts", "const a = x as const satisfies T;\nconst b = a satisfies B as const;\nlet c = x as unknown as T;\n"), (".ts", "@dec export default class {}\n"),
    (".js", "function f() {\n  if (a) {\n    return 1;\n  }\n  for (;;) { switch (b) { case 1: { return; } default: break; } }\n}\n"),
    (".js", "const f = () => { try { return 1; } finally { g(); } };\nclass A { if(x) { return x; } get y() { return 1; } static { h(); } }\n"),
    (".ts", "function f(): { a: string } {\n  return { a: '' };\n}\nfoo(function () { return 1; }, { m() { return 2; } });\n"),
    (".js", "for (;;) if (a) break; else continue;\nwhile (a) { if (b) { break; } }\n"),
    (".py", "x = f'{a['b']} {f\"{c!r:>{w}}\"} {{x}}'\nde\u0301f\u00b7 = 1\n"),
])
def test_valid_sources_of_rare_kinds(extension, text):
    assert broken(extension, text) is None


@pytest.mark.parametrize(("extension", "text", "at"), [
    (".js", "const a = 1;\nreturn 1;\n", "return"), (".ts", "let a = 1;\nif (a) {\n  return;\n}\n", "{"), (".js", "f();\nbreak;\n", "break"), (".js", "try { return 1; } catch { g(); }\n", "{"),
    (".js", "export default abstract class A {}\n", None), (".js", "const a = x as const;\n", None), (".ts", "export class {}\n", None), (".py", "x = f'{a['c'}'\n", None), (".py", "f'{x\n", None),
])
def test_invalid_sources_of_rare_kinds(extension, text, at):
    assert broken(extension, text) is not None
    if at:
        assert broken(extension, text)[0] == text.index(at)


@pytest.mark.parametrize("n", [120, 5000])
def test_long_chains(n):
    for extension, text in (
        (".js", "x = " + "a ? b : " * n + "c;\n"), (".js", "f = " + "a => " * n + "c;\n"), (".ts", "if (a) {}" + " else if (b) {}" * n + "\n"), (".go", "package a\n\nfunc f() {\n\tif a {\n\t}" + " else if b {\n\t}" * n + "\n}\n"),
        (".js", "a = " * n + "c;\n"), (".py", "x = " + "not " * n + "a\n"), (".py", "x = " + "a if b else " * n + "c\n"),
    ):
        assert broken(extension, text) is None
        assert broken(extension, text.replace("\n", " @@\n")) is not None


def test_many_indents_of_one_task():
    for n in range(40):
        assert broken(".py", "".join("if a:\n" + " " * (n * 600 + k + 1) + "b\n" for k in range(600))) is None


def test_same_verdicts_as_the_interpreter():
    import glob
    import sysconfig

    for path in sorted(glob.glob(sysconfig.get_path("stdlib") + "/*.py"))[::4]:
        content = open(path, "rb").read()
        ast.parse(content)
        assert broken(".py", content) is None, path

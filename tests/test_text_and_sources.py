"""Tokenisers, search, vectors, repository sources and change streams."""

import math
import os

from pyspark.sql import functions as F

from lodeweave.functions.text import byte_prefix, code_tokens, describe, short_text, tokens
from lodeweave.functions.vectors import cosine
from lodeweave.operators import search
from lodeweave.sources.parsers import parse_calls, parse_types
from lodeweave.sources.repository import is_ignored, language_of, read_commit_log, read_ignore_file, scan
from lodeweave.streaming.changes import at_most_every, quiet_batches, reindex_files, reindex_into, route


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    words = lambda t: one(spark, tokens(F.col("t")), t=t)
    assert words("hello_world test-case") == ["hello", "world", "test", "case"]
    assert words("UserService") == ["userservice"]
    assert words("a b cd") == ["cd"]
    assert words(None) == words("") == []
    parts = lambda t: set(one(spark, code_tokens(F.col("t")), t=t))
    assert {"userservice", "user", "service"} <= parts("UserService")
    assert {"parse_input", "parse", "input"} <= parts("parse_input")
    assert {"user.validate", "user", "validate"} <= parts("user.validate")
    assert {"geturl", "get", "url"} <= parts("getURL")
    assert {"parsehttp2", "parse", "http", "2", "parsehttp"} <= parts("parseHTTP2")
    assert parts("i") == {"i"}
    assert parts("") == {""}
    assert one(spark, byte_prefix(F.col("t"), 3), t="aéé") == "aé"


def test_node_texts(spark):
    c = F.col
    row = dict(label="method", name="run", path="a.py", sig="run()", content="", cls="T")
    assert one(spark, describe(c("label"), c("name"), c("path"), c("sig"), c("content"), c("cls")), **row) == "method run. in file a.py. Signature: run(). Method of class T"
    assert one(spark, short_text(c("label"), c("name"), c("sig"), c("path")), **row) == "method run run() a.py"


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0, 2.0], [2.0, 4.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select(cosine(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_term_and_vector_search(spark):
    docs = spark.createDataFrame([("d1", "user service user"), ("d2", "validate user"), ("d3", "parse input"), ("d4", None), ("d5", "")], "id string, text string")
    text = F.col("text")
    hits = [tuple(r) for r in search.term_search(docs, "id", text, ["user"], 10).collect()]
    assert hits == [("d1", 2), ("d2", 1)]
    assert [tuple(r) for r in search.term_search(docs, "id", text, ["user", "user"], 1).collect()] == [("d1", 4)]
    assert search.term_search(docs, "id", text, ["nonexistent"], 10).count() == 0
    assert [r.id for r in search.bm25(docs, "id", text, ["validate", "user"], 10).collect()][0] == "d2"
    vectors = spark.createDataFrame([("A", [1.0, 0.0, 0.0]), ("B", [0.0, 1.0, 0.0]), ("C", [0.0, 0.0, 1.0])], "id string, v array<float>")
    near = search.nearest(vectors, "id", "v", spark.createDataFrame([([0.9, 0.1, 0.0],)], "q array<float>"), 2).collect()
    assert [r.id for r in near] == ["A", "B"]
    left = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    right = spark.createDataFrame([("b", 0)], "id string, rank int")
    got = {r.id: r.score for r in search.fuse(left, right, "id", 5).collect()}
    assert math.isclose(got["b"], 1 / 61 + 1 / 60, abs_tol=1e-8)
    assert math.isclose(got["a"], 1 / 60, abs_tol=1e-8)


def test_tfidf(spark):
    text = " ".join(f"term{i:03}" for i in range(150))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "term000 other words here"), (4, None), (5, "")], "id int, text string")
    parts = search.tfidf(docs, "id", F.col("text"), 100).collect()
    norms: dict = {}
    for r in parts:
        norms[r.id] = norms.get(r.id, 0) + r.weight**2
        assert 0 <= r.idx < 100
    assert set(norms) == {1, 2, 3}
    assert all(abs(n - 1) < 1e-9 for n in norms.values())
    vectors = {i: {r.idx: r.weight for r in parts if r.id == i} for i in (1, 2)}
    assert abs(sum(w * vectors[2][k] for k, w in vectors[1].items()) - 1) < 1e-9
    whole = search.tfidf(docs, "id", F.col("text"))
    assert whole.where("id = 1").count() == 150
    assert {r.term for r in whole.where("id = 3").collect()} == {"term000", "other", "words", "here"}


def test_scan_and_ignore(spark, tmp_path):
    for name in ("main.py", "utils.py", "test_main.py", "src/app.py", "src/lib/utils.py", "README.md", ".gitignore", "cache.pyc", "__pycache__/mod.pyc", "node_modules/x.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = scan(spark, f"file://{tmp_path}")
    assert {r.rel_path for r in got.collect()} == {"main.py", "utils.py", "test_main.py", "src/app.py", "src/lib/utils.py"}
    df = spark.createDataFrame([("a/dist/x.js",), ("dist.js",), ("a/b.min.js",), ("file.go",), ("image.png",), (None,)], "p string")
    rows = {r.p: (r.ignored, r.lang) for r in df.select("p", is_ignored(F.col("p")).alias("ignored"), language_of(F.col("p")).alias("lang")).collect()}
    assert rows == {"a/dist/x.js": (True, "javascript"), "dist.js": (False, "javascript"), "a/b.min.js": (True, "javascript"), "file.go": (False, "go"), "image.png": (False, None), None: (None, None)}


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("COMMIT:abc\na.py\nb.py\n\nCOMMIT:empty\n\nCOMMIT:def\na.py\n")
    assert sorted(tuple(r) for r in read_commit_log(spark, f"file://{tmp_path}/log").collect()) == [("abc", "a.py"), ("abc", "b.py"), ("def", "a.py")]


def test_route(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "rel_path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "rel_path string, sha256 string")
    assert {tuple(r) for r in route(old, new).collect()} == {("b", "modified"), ("d", "added")}
    assert {tuple(r) for r in route(new, old).collect()} == {("b", "modified"), ("d", "deleted")}


def test_stream_batches_and_reindex(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "a"), ("r", "2024-01-01 00:00:01", "a"), ("r", "2024-01-01 00:00:02", "b"), ("r", "2024-01-01 00:01:00", "c"), ("r", "2024-01-02 00:00:00", "z")]
    events = spark.createDataFrame(rows, "repo string, t string, path string").withColumn("t", F.to_timestamp("t"))
    want = [(3, 2), (1, 1), (1, 1)]
    assert [(r.changes, r.paths) for r in quiet_batches(events, "t", "path", "2 seconds", "repo").orderBy("start").collect()] == want
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    run = quiet_batches(live, "t", "path", "2 seconds", "repo", late="1 second").writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.changes, r.paths) for r in spark.table("batches").orderBy("start").collect()] == want[:2]  # the last is still open
    target = f"file://{tmp_path}/index"
    sink = reindex_into(target)
    from lodeweave.sources.tables import shared_folder

    shared_folder(spark)
    sink(spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "file_path string, name string"), 0)
    sink(spark.createDataFrame([("a.py", "new1"), ("a.py", "new2")], "file_path string, name string"), 1)
    sink(spark.createDataFrame([("a.py", "new1"), ("a.py", "new2")], "file_path string, name string"), 1)
    assert sorted((r.file_path, r.name) for r in spark.read.parquet(target).collect()) == [("a.py", "new1"), ("a.py", "new2"), ("b.py", "y")]


def test_parsers(spark):
    from lodeweave.sources.parsers import parse_calls, parse_types, parse_imports, parse_symbols

    go = 'package a\n\nimport (\n\t"fmt"\n\tx "other/y"\n)\n\nfunc greet(name string) string { return "func no() {" }\n\ntype Service struct {\n\tA int\n}\n\nfunc (s *Service) GetUser(id int) (string, error) {\n\treturn "", nil\n}\n\ntype Reader interface {\n\tRead()\n}\n'
    python = 'from .a import b\nimport os, sys as s\n\nclass Base:\n    """class No: pass"""\n    def __init__(self, x: int = 1):\n        def inner(): pass\n\n    @property\n    async def value(self) -> str:\n        return ""\n\ndef free(\n    a,\n):\n    pass\n'
    ts = "import { x } from './x';\nimport * as q from \"q\";\nexport function f(a: string): number { return 1 }\nexport const arrow = async (a: number): Promise<void> => { g() };\nexport class A extends B {\n  private m(x: { y: number }): void {\n    if (x) { h() }\n  }\n  static n() {}\n}\ninterface I { z(): void }\n// function no() {}\n"
    rows = [(1, "r", "a.go", go.encode()), (2, "r", "b.py", python.encode()), (3, "r", "c.ts", ts.encode()), (4, "r", "d.txt", b"def f(): pass"), (5, "r", "e.py", None), (6, None, None, b""), (7, "r", "f.go", b"")]
    files = spark.createDataFrame(rows, "file_id long, repo string, rel_path string, content binary").withColumn("name", F.lit("clash"))
    got = {(r.file_id, r.kind, r.class_name, r.name, r.start_line, r.signature) for r in parse_symbols(files).collect()}
    assert got == {
        (1, "function", "", "greet", 8, "greet(name string) string"), (1, "class", "", "Service", 10, "type Service struct"), (1, "method", "Service", "GetUser", 14, "GetUser(id int) (string, error)"), (1, "interface", "", "Reader", 18, "type Reader interface"),
        (2, "class", "", "Base", 4, "class Base"), (2, "method", "Base", "__init__", 6, "__init__(self, x: int = 1)"), (2, "method", "Base", "value", 9, "value(self) -> str"), (2, "function", "", "free", 13, "free(a)"),
        (3, "function", "", "f", 3, "f(a: string): number"), (3, "function", "", "arrow", 4, "arrow(a: number): Promise<void>"), (3, "class", "", "A", 5, "class A extends B"), (3, "method", "A", "m", 6, "m(x: { y: number }): void"), (3, "method", "A", "n", 9, "n()"), (3, "interface", "", "I", 11, "interface I"),
    }
    assert {(r.file_id, r.module_path, r.is_relative) for r in parse_imports(files).collect()} == {(1, "fmt", False), (1, "other/y", False), (2, ".a", True), (2, "os", False), (2, "sys", False), (3, "./x", True), (3, "q", False)}
    assert parse_symbols(files.limit(0)).count() == 0


def test_all_that_is_parsed(spark, tmp_path):
    from lodeweave.plans.queries import QUERIES

    texts = {"a.py": "import logging\nimport os\n\nclass A:\n    def f(self):\n        pass\n", "b.ts": "import { x } from './x';\nexport interface I {\n  a: string;\n}\n"}
    rows = [(i, "r", path, text.encode()) for i, (path, text) in enumerate(texts.items())]
    spark.createDataFrame(rows, "file_id long, repo string, rel_path string, content binary").write.parquet(f"{tmp_path}/files.parquet")
    symbols = QUERIES["parse_symbols_all"](spark, str(tmp_path))
    assert {"file_id", "name", "kind", "start_line", "signature", "class_name", "is_exported"} <= set(symbols.columns)
    assert {(r.file_id, r.name, r.kind) for r in symbols.collect()} == {(0, "A", "class"), (0, "f", "method"), (1, "I", "interface")}
    assert {(r.file_id, r.module_path) for r in QUERIES["parse_imports_all"](spark, str(tmp_path)).collect()} == {(0, "logging"), (0, "os"), (1, "./x")}


def test_ignore_file(spark, tmp_path):
    for name in ("main.go", "gen/a.go", "gen/keep.go", "top.py", "sub/top.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# remark\n\ngen/*.go\n!gen/keep.go\n/top.py\n")
    root = f"file://{tmp_path}"
    assert read_ignore_file(spark, root) == ("gen/*.go", "!gen/keep.go", "/top.py")
    assert {r.rel_path for r in scan(spark, root).collect()} == {"main.go", "gen/keep.go", "sub/top.py"}
    (tmp_path / ".gitignore").unlink()
    assert read_ignore_file(spark, root) == ()


def test_code_index(spark):
    nodes = spark.createDataFrame([("n1", "function", "UserService", "a.go", "UserService()", "x"), ("n2", "function", "validate_user", "b.go", "", "parse_input(user)"), ("n3", "method", "parseInput", "c.go", "", "")], "id string, label string, name string, file_path string, signature string, content string")
    index = search.code_index(nodes)
    found = lambda i, q, n=0: [(r.id, r.score) for r in search.code_search(i, q, n).collect()]
    assert found(index, "user") == [("n1", 1), ("n2", 1)]
    assert found(index, "parse_input") == [("n2", 3), ("n3", 2)]
    assert found(index, "user", 1) == [("n1", 1)]
    assert found(index, "nonexistent") == found(index, "") == []
    renamed = search.with_nodes(index, nodes.where("id = 'n1'").withColumn("name", F.lit("Account")).withColumn("signature", F.lit("")))
    assert found(renamed, "user") == [("n2", 1)]
    assert found(renamed, "account") == [("n1", 1)]
    assert found(search.without_nodes(index, nodes.where("id = 'n2'")), "user") == [("n1", 1)]
    assert search.resolve_name(index, nodes, "parseInput").first()["id"] == "n3"


def test_parsed_calls(spark):
    go = b"package a\n\nimport (\n\tx \"repo/util\"\n\t\"fmt\"\n)\n\ntype S struct{}\n\nfunc (s *S) Run(n int) {\n\ts.helper(n)\n\tx.Do()\n\tfmt.Println(other.call())\n}\n"
    py = b"import os\n\nclass A:\n    def f(self, a: Item = 1) -> Result:\n        self.g()\n        return os.getcwd(h('x()'))\n"
    files = spark.createDataFrame([(1, "r", "a.go", go), (2, "r", "b.py", py), (3, "r", "c.py", None)], "file_id long, repo string, rel_path string, content binary")
    got = {(r.file_id, r.name, r.receiver, r.package) for r in parse_calls(files).collect()}
    assert got == {(1, "helper", "S", ""), (1, "Do", "", "repo/util"), (1, "Println", "", "fmt"), (1, "call", "other", ""), (2, "g", "A", ""), (2, "getcwd", "", "os"), (2, "h", "", "")}
    assert {(r.name, r.role) for r in parse_types(files).collect()} == {("Item", "param"), ("Result", "return")}


def test_reindex_files(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(list(rows), "file_id long, repo string, rel_path string, content binary")
    targets = {"symbols": f"file://{tmp_path}/symbols", "calls": f"file://{tmp_path}/calls"}
    runs, now = [], [0.0]
    sink = reindex_files(targets, 4, at_most_every(30, lambda _: runs.append(now[0]), lambda: now[0]))
    sink(files((1, "r", "a.py", b"def f():\n    g()\n"), (2, "r", "b.py", b"def h():\n    pass\n")), 0)
    now[0] = 10.0
    sink(files((3, "r", "a.py", b"def k():\n    pass\n")), 1)
    now[0] = 31.0
    sink(files((4, "r", "b.py", None)), 2)
    names = lambda t: {r.name for r in spark.read.parquet(targets[t]).where("name is not null").collect()}
    assert names("symbols") == {"k"}
    assert names("calls") == set()
    assert runs == [0.0, 31.0]

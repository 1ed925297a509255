"""Graph, traversal, dead code, coupling and communities on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import community, coupling, deadcode, graph as ops, traversal
from lodeweave.plans.graph import CodeGraph, call_edges, call_sites, heritage, heritage_edges, import_edges, parsed_graph, resolve, structure, symbol_nodes, type_edges
from lodeweave.plans.queries import QUERIES

SYMBOL = "symbol_id long, file_id long, repo string, file_path string, name string, kind string, start_line int, end_line int, content string, signature string, class_name string, is_exported boolean, decorators array<string>"


def symbols(spark, *rows):
    """(name, kind, file_path, content, signature, class_name) -> a symbols table."""
    full = []
    for i, (name, kind, path, *rest) in enumerate(rows):
        content, signature, class_name, exported, decorators = [*rest, *[None, None, None, None, None][len(rest) :]]
        full.append((i, 1, path.split("/")[0], path, name, kind, 1, 2, content, signature, class_name, exported, decorators))
    return spark.createDataFrame(full, SYMBOL)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_traversal_chain(spark):
    calls = edges(spark, ("main", "foo"), ("foo", "bar"), ("bar", "baz"))
    start = lambda n: spark.createDataFrame([(n,)], "id string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(traversal.reach(calls, start("bar"), 1, "callers")) == {"foo"}
    assert ids(traversal.reach(calls, start("bar"), 2, "callers")) == {"foo", "main"}
    assert ids(traversal.reach(calls, start("foo"), 1)) == {"bar"}
    assert ids(traversal.reach(calls, start("main"), 15)) == {"foo", "bar", "baz"}
    assert ids(traversal.reach(calls, start("nothing"), 3)) == set()


def test_flows(spark):
    chain = edges(spark, *((f"n{i:02}", f"n{i + 1:02}") for i in range(20)))
    steps = traversal.flows(chain, spark.createDataFrame([("n00",)], "id string"), 5).orderBy("step").collect()
    assert [r.id for r in steps] == [f"n{i:02}" for i in range(6)]
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert traversal.flows(ring, spark.createDataFrame([("a",)], "id string")).count() == 3
    three = spark.createDataFrame([("x", 0, "A"), ("x", 1, "B"), ("y", 0, "A"), ("y", 1, "B"), ("z", 0, "A"), ("z", 1, "D")], "root string, step int, id string")
    assert {r.root for r in traversal.distinct_flows(three).collect()} == {"x", "z"}


def test_depth_is_least(spark):
    calls = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"))
    got = {r.id: r.depth for r in traversal.reach(calls, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {"b": 1, "c": 1, "d": 2}


@pytest.mark.parametrize(
    ("names", "calls", "dead"),
    [(["main", "foo", "bar"], [("main", "foo"), ("foo", "bar")], set()), (["main", "foo", "bar"], [("main", "foo")], {"bar"}), (["main", "foo", "bar", "baz", "qux"], [("main", "foo")], {"bar", "baz", "qux"}), (["main"], [], set())],
)
def test_dead_counts(spark, names, calls, dead):
    nodes = symbol_nodes(symbols(spark, *((n, "function", "r/a.py", "") for n in names)))
    ids = {n: f"function:r/a.py:{n}" for n in names}
    got = deadcode.dead_code(nodes, edges(spark, *((ids[a], ids[b]) for a, b in calls)) if calls else edges(spark, ("-", "-")), edges(spark, ("-", "-")).withColumn("type", F.lit("extends")))
    assert {r.name for r in got.collect()} == dead


def test_dead_exemptions_and_override(spark):
    table = symbols(
        spark, ("Exported", "function", "r/a.go", "", "", "", True), ("TestFoo", "function", "r/main_test.go"), ("__init__", "method", "r/a.py", "", "", "My"), ("helper", "function", "r/a.py"), ("Unused", "function", "r/a.py"),
        ("Base", "class", "r/b.py", "", "class Base"), ("Derived", "class", "r/b.py", "", "class Derived(Base)"), ("show", "method", "r/b.py", "", "", "Base", True), ("show", "method", "r/b.py", "", "", "Derived"),
        ("handleInitialize", "function", "r/server.go"), ("setupTool", "function", "r/cmd.go"),
    )
    nodes = symbol_nodes(table)
    got = {(r.name, r.confidence) for r in deadcode.dead_code(nodes, edges(spark, ("-", "-")), heritage_edges(nodes)).collect()}
    assert got == {("helper", "medium"), ("Unused", "high"), ("Base", "high"), ("Derived", "high")}


def test_resolution_prefers_the_nearest(spark):
    nodes = symbol_nodes(
        symbols(
            spark, ("run", "function", "r/a/x.py", "def run():\n    helper()\n    other()\n    far()\n    run()", "run()"), ("helper", "function", "r/a/x.py"), ("helper", "function", "r/b/y.py"),
            ("other", "function", "r/a/z.py"), ("other", "function", "q/a/z.py"), ("far", "method", "q/a/z.py", "", "", "T"), ("same", "function", "r/a/x.py", "call()", "same(a: Thing)"), ("Thing", "class", "r/c/t.py"),
        )
    )
    assert {(r.src.rpartition(":")[2], r.dst) for r in call_edges(nodes).collect()} == {("run", "function:r/a/x.py:helper"), ("run", "function:r/a/z.py:other"), ("run", "method:q/a/z.py:T.far")}
    assert {r.dst for r in type_edges(nodes).collect()} == {"class:r/c/t.py:Thing"}


def test_heritage(spark):
    nodes = symbol_nodes(symbols(spark, ("A", "class", "r/a.py", "", "class A(Base, LogMixin)"), ("B", "class", "r/a.ts", "", "class B extends A implements C"), ("Base", "class", "r/z.py", "", None)))
    assert {(r.id[-1], r.base, r.type) for r in heritage(nodes).collect()} == {("A", "Base", "extends"), ("A", "LogMixin", "implements"), ("B", "A", "extends"), ("B", "C", "implements")}
    assert {(r.src, r.dst) for r in heritage_edges(nodes).collect()} == {("class:r/a.py:A", "class:r/z.py:Base"), ("class:r/a.ts:B", "class:r/a.py:A")}


def test_structure_and_imports(spark):
    files = spark.createDataFrame([("r", "a/b/x.py"), ("r", "a/y.py"), ("r", "a/b/z.ts"), ("r", "a/w.ts"), (None, "q"), ("r", None)], "repo string, rel_path string")
    nodes, contains = structure(files)
    assert {r.file_path for r in nodes.where("label = 'folder'").collect()} == {"r", "r/a", "r/a/b"}
    assert ("folder:r/a", "file:r/a/y.py") in {tuple(r) for r in contains.collect()}
    imports = spark.createDataFrame([("r/a/b/x.py", "..y", True), ("r/a/b/z.ts", "../w", True), ("r/a/b/z.ts", "./none", True), ("r/a/b/z.ts", "../../../../../out", True), ("r/a/y.py", "os", False), (None, None, None)], "file_path string, module_path string, is_relative boolean")
    assert {tuple(r) for r in import_edges(files, imports).collect()} == {("file:r/a/b/x.py", "file:r/a/y.py"), ("file:r/a/b/z.ts", "file:r/a/w.ts")}


def test_upsert_and_remove(spark):
    nodes = symbol_nodes(symbols(spark, ("foo", "function", "test.py"), ("Foo", "class", "test.py"), ("bar", "function", "other.py")))
    calls = edges(spark, ("function:test.py:foo", "function:other.py:bar"), ("function:other.py:bar", "function:other.py:bar"))
    kept, left = ops.remove_files(nodes, calls, spark.createDataFrame([("test.py",)], "file_path string"))
    assert {r.name for r in kept.collect()} == {"bar"}
    assert left.count() == 1
    same, _ = ops.remove_files(nodes, calls, spark.createDataFrame([("none.py",)], "file_path string"))
    assert same.count() == 3
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert {tuple(r) for r in ops.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_coupling(spark):
    rows = [("r", c, f) for c, fs in {"1": "f1 f2", "2": "f1 f3", "3": "f2 f3", "4": "f1 f2"}.items() for f in fs.split()] + [("r", "1", "f1"), (None, "1", "f1"), ("r", "1", None), ("r", "1", "")]
    changed = coupling.changes(spark.createDataFrame(rows, "repo string, commit_id string, file string"))
    assert {(r.file_a, r.file_b): r.co_changes for r in coupling.co_changes(changed).collect()} == {("f1", "f2"): 2, ("f1", "f3"): 1, ("f2", "f3"): 1}
    got = {(r.file_a, r.file_b): r.strength for r in coupling.coupling(changed, 0.0, 1).collect()}
    assert got == {("f1", "f2"): round(2 / 3, 6), ("f1", "f3"): round(1 / 3, 6), ("f2", "f3"): round(1 / 3, 6)}
    assert coupling.co_changes(changed, bulk=1).count() == 0


def test_coupling_of_large_commits(spark):
    import itertools
    from collections import Counter

    sizes = {"1": 300, "2": 290, "3": 300, "4": 5, "5": 2, "6": 150}
    rows = [("r", c, f"f{i:03}") for c, n in sizes.items() for i in range(n)] + [("r", str(c), "f001") for c in range(10, 22)]
    changed = coupling.changes(spark.createDataFrame(rows, "repo string, commit_id string, file string"))
    pairs, totals = Counter(), Counter(f for _, _, f in rows)
    for _, files in itertools.groupby(sorted((c, f) for _, c, f in rows), key=lambda x: x[0]):
        pairs.update(itertools.combinations([f for _, f in files], 2))
    assert {(r.file_a, r.file_b): r.co_changes for r in coupling.co_changes(changed).collect()} == pairs
    want = {(a, b): (n, round(n / max(totals[a], totals[b]), 6)) for (a, b), n in pairs.items() if n >= 3 and n / max(totals[a], totals[b]) >= 0.3}
    got = {(r.file_a, r.file_b): (r.co_changes, r.strength) for r in coupling.coupling(changed).collect()}
    assert got == want
    assert len(want) > 40_000


def test_communities(spark):
    two = community.adjacency(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")))
    labels = {r.id: r.community for r in community.communities(two).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"] == labels["z"]
    assert {r.id: r.component for r in community.components(two).collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")
    weights = {(r.i, r.j): r.w for r in community.adjacency(edges(spark, ("A", "B"), ("B", "C"), ("D", "D"))).collect()}
    assert weights["A", "B"] == weights["B", "A"] == 1
    assert weights["D", "D"] == 2
    nodes = spark.createDataFrame([(c, f"name_{c}") for c in "abcxyz"], "id string, name string")
    same = spark.createDataFrame([(c, "k") for c in "abcxyz"], "id string, community string")
    (row,) = community.describe(same, nodes).collect()
    assert (row.member_count, row.label) == (6, "Community (name_a, name_b, name_c, +3 more)")


def test_communities_end_where_no_move_gains(spark):
    from collections import Counter

    path = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    labels = {r.id: r.community for r in community.communities(community.adjacency(edges(spark, *path))).collect()}
    near = {v: [b if a == v else a for a, b in path if v in (a, b)] for v in labels}
    size, total = Counter(), 2 * len(path)
    for v, c in labels.items():
        size[c] += len(near[v])
    for v, own in labels.items():
        k = Counter(labels[n] for n in near[v])
        gain = {c: k[c] / total - len(near[v]) * (size[c] - (len(near[v]) if c == own else 0)) / total**2 for c in {*k, own}}
        assert max(gain.values()) <= gain[own] + 1e-12


@pytest.mark.parametrize("rows, leaves", [(0, 40), (100_000, 300)])
def test_communities_settle_where_all_move_at_once(spark, monkeypatch, rows, leaves):
    """Leaves between two hubs prefer the smaller community: if all move at once, they go to and fro."""
    from collections import Counter

    monkeypatch.setattr(community, "TASK_ROWS", rows)  # by joins, and in one task
    pairs = [(hub, f"n{i:03}") for i in range(leaves) for hub in "ab"] + [("a", "a")]
    adjacent = community.adjacency(edges(spark, *pairs)).persist()
    labels = {r.id: r.community for r in community.communities(adjacent).collect()}
    near = {v: Counter() for v in labels}
    for r in adjacent.collect():
        near[r.i][r.j] += r.w
    degree = {v: sum(near[v].values()) for v in labels}
    size, total = Counter(), sum(degree.values())
    for v, c in labels.items():
        size[c] += degree[v]
    for v, own in labels.items():
        k = Counter()
        for u, w in near[v].items():
            k[labels[u]] += w * (u != v)
        gain = {c: k[c] * total - degree[v] * (size[c] - degree[v] * (c == own)) for c in {*k, own}}
        assert max(gain.values()) <= gain[own]


def test_settled_equals_brute_force_rule():
    import numpy as np

    r = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 60), (400, 1500)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        w = np.zeros((n, n), int)
        np.add.at(w, (a, b), 1)
        w += w.T
        i, j = np.nonzero(w)
        found = community.settled(i, j, w[i, j], n)
        d, total = w.sum(1), w.sum()
        bare = w - np.diag(np.diag(w))
        for v in set(i.tolist()):
            gain = {c: bare[v][found == c].sum() * total - d[v] * (d[found == c].sum() - d[v] * (c == found[v])) for c in {*found[np.flatnonzero(bare[v])].tolist(), found[v]}}
            assert max(gain.values()) <= max(gain[found[v]], 0)


def test_long_path_is_one_component(spark):
    path = community.adjacency(edges(spark, *((f"n{i:03}", f"n{i + 1:03}") for i in range(60))))
    assert {r.component for r in community.components(path).collect()} == {"n000"}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    import random

    r = random.Random(seed)
    pairs = [(f"v{r.randint(0, 150):03}", f"v{r.randint(0, 150):03}") for _ in range(90)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.id: x.component for x in community.components(community.adjacency(edges(spark, *pairs))).collect()}
    assert got == {v: root(v) for v in parent}


def _symbols(spark, *rows):
    return spark.createDataFrame([(f"{kind}:{path}:{cls + '.' if cls else ''}{name}", kind, name, path, "r", cls, content) for kind, path, cls, name, content in rows], "id string, label string, name string, file_path string, repo string, class_name string, content string")


def test_resolution_by_package_receiver_and_name(spark):
    nodes = _symbols(
        spark, ("method", "p/a.go", "Parser", "helper", ""), ("method", "p/a.go", "Parser", "Parse", "func (p *Parser) Parse() {\n\tp.helper()\n\tv.validate()\n}"), ("method", "p/b.go", "Service", "validate", ""), ("method", "p/c.go", "Other", "validate", ""),
        ("method", "p/b.go", "Service", "run", "def run(self):\n    self.validate()\n"), ("function", "x/ingestion/run.go", "", "RunPipeline", ""), ("function", "a/cmd/run.go", "", "RunPipeline", ""), ("function", "a/cmd/main.go", "", "main", "func main() {\n\tingestion.RunPipeline()\n\tother.RunPipeline()\n}"),
    )
    imports = spark.createDataFrame([("a/cmd/main.go", "example/x/ingestion", ""), ("a/cmd/main.go", None, "q")], "file_path string, module_path string, alias string")
    got = {(r.src, r.dst): r.rule for r in resolve(call_sites(nodes, imports), nodes).collect()}
    assert got == {
        ("method:p/a.go:Parser.Parse", "method:p/a.go:Parser.helper"): 3, ("method:p/b.go:Service.run", "method:p/b.go:Service.validate"): 3,
        ("function:a/cmd/main.go:main", "function:x/ingestion/run.go:RunPipeline"): 1, ("function:a/cmd/main.go:main", "function:a/cmd/run.go:RunPipeline"): 4,
    }


def test_graph_of_files(spark):
    go = b"package main\n\nimport \"r/svc\"\n\nfunc main() {\n\tsvc.Start()\n}\n"
    svc = b"package svc\n\ntype S struct{}\n\nfunc Start() {\n\tstop()\n}\n\nfunc stop() {}\n"
    files = spark.createDataFrame([(1, "r", "main.go", go), (2, "r", "svc/service.go", svc)], "file_id long, repo string, rel_path string, content binary")
    for mode, more in (("span", set()), ("file", {("class:r/svc/service.go:S", "function:r/svc/service.go:stop")})):
        nodes, calls = parsed_graph(files, mode)
        assert nodes.count() == 4
        assert {(r.src, r.dst) for r in calls.collect()} == {("function:r/main.go:main", "function:r/svc/service.go:Start"), ("function:r/svc/service.go:Start", "function:r/svc/service.go:stop")} | more


def test_numbered_communities(spark):
    labels = spark.createDataFrame([("c", "x"), ("a", "y"), ("d", "x"), ("b", "z"), ("e", "y")], "id string, community string")
    assert {r.id: r.number for r in community.numbered(labels).collect()} == {"a": 0, "e": 0, "b": 1, "c": 2, "d": 2}


def test_modularity_of_communities(spark):
    for edges, least in (([(i, i + 1) for i in range(200)], 0.5), ([(0, i) for i in range(1, 60)], -0.01), ([(c * 8 + a, c * 8 + b) for c in range(6) for a in range(8) for b in range(a)] + [(c * 8, c * 8 + 8) for c in range(5)], 0.75)):
        adjacent = community.adjacency(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string"))
        labels = community.communities(adjacent).persist()
        assert community.modularity(adjacent, labels).first()[0] >= least


def test_bulk_load_and_append(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "function"), ("b", "class")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, type string")
    target = f"file://{tmp_path}/graph"
    ops.bulk_load(nodes, edges, target)
    ops.append(spark.createDataFrame([("c", "function")], "id string, label string"), edges.withColumn("dst", F.lit("c")), target)
    assert {r.id for r in spark.read.parquet(f"{target}/nodes").collect()} == {"a", "b", "c"}
    assert spark.read.parquet(f"{target}/edges").count() == 2
    ops.bulk_load(nodes.where("id = 'a'"), edges.limit(0), target)
    assert spark.read.parquet(f"{target}/nodes").count() == 1


def test_recent_commits(spark):
    rows = spark.createDataFrame([("r", "c1", "a", "2024-01-10"), ("r", "c2", "a", "2024-06-01"), ("r", "c3", "a", "2024-07-10"), ("r", "c4", "a", None)], "repo string, commit_id string, file string, t string").withColumn("committed_at", F.col("t").cast("timestamp_ntz"))
    assert {r.commit_id for r in coupling.recent(rows, 6).collect()} == {"c1", "c2", "c3"}
    assert {r.commit_id for r in coupling.recent(rows, 2).collect()} == {"c2", "c3"}


def test_inner_calls(spark):
    nodes = _symbols(spark, ("method", "a.go", "S", "x", ""), ("method", "b.go", "S", "y", ""), ("method", "c.go", "T", "y", ""), ("function", "a.go", "", "f", ""))
    calls = edges(spark, ("method:a.go:S.x", "method:b.go:S.y"), ("method:a.go:S.x", "method:c.go:T.y"), ("method:a.go:S.x", "function:a.go:f"))
    assert {(r.dst, r.within) for r in deadcode.inner_calls(nodes, calls).collect()} == {("method:b.go:S.y", "intra_class"), ("function:a.go:f", "intra_file")}


def test_calls_of_what_is_left_of_texts(spark, tmp_path):
    """Calls, and their names, don't need the texts of symbols through a shuffle: the same without."""
    rows = [(k, kind, f"n{k}", f"r/d{k % 3}/f{k % 5}.py", "r", "", 1, 2, True, "s", text, ["d"]) for k, (kind, text) in enumerate([("function", "def n0(a): n1(n2(3)); n1 (); _n3(n4(n9("), ("method", "n0()n2("), ("class", None), ("function", ""), ("function", "x.n0(1)\u00e9n2(2)"), ("function", "n0((n5(")])]
    symbols = spark.createDataFrame(rows, "symbol_id long, kind string, name string, file_path string, repo string, class_name string, start_line int, end_line int, is_exported boolean, signature string, content string, decorators array<string>")
    symbols.write.parquet(f"{tmp_path}/symbols.parquet")
    want = {(r.src, r.dst) for r in call_edges(symbol_nodes(symbols)).collect()}
    g = CodeGraph(spark, str(tmp_path))
    assert {(r.src, r.dst) for r in g.calls.collect()} == want and len(want) > 5
    assert {(r.id, r.name) for r in g.names().collect()} == {(r.id, r.name) for r in symbol_nodes(symbols).collect()}
    assert "symbols" not in g.kept
    g.release()


@pytest.mark.parametrize("rows", [0, 1000])
def test_settled_numbers_are_the_named_communities(spark, monkeypatch, rows):
    monkeypatch.setattr(community, "TASK_ROWS", rows)
    adjacent = community.adjacency(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "x"), ("z", "z")))
    degree, numbers, labels = community.settle(adjacent)
    named = community.communities(adjacent)
    assert {r.id: r.degree for r in degree.collect()} == {r.id: r.degree for r in community.degrees(adjacent).collect()}
    assert community.modularity(numbers, labels.withColumnRenamed("node", "id")).first() == community.modularity(adjacent, named).first()


@pytest.mark.parametrize("rows", [0, 1000])
def test_settled_edges_are_the_settled_adjacency(spark, monkeypatch, rows):
    monkeypatch.setattr(community, "TASK_ROWS", rows)
    calls = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "x"), ("z", "z"), ("a", "b"))
    one, two = community.settle_edges(calls), community.settle(community.adjacency(calls))
    for a, b in zip(one, two):
        assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    assert sorted(community.named(*one[::2]).collect()) == sorted(community.communities(community.adjacency(calls)).collect())
    assert community.settle_edges(calls.limit(0))[0].isEmpty()


def test_nearest_candidate_of_names_with_one_and_several(spark):
    """Each level, ranks within it, ids that hold a path twice, and names that only one node or none has."""
    from lodeweave.plans import graph

    symbols = [
        ("function", "r/a/f.py", "once", "r", "", ""), ("function", "s/b/g.py", "twice", "s", "", "once(twice("), ("function", "r/a/f.py", "twice", "r", "", "once( nowhere("),
        ("function", "r/a/h.py", "u", "r", "", "twice(once(near(u("), ("method", "r/a/f.py", "v", "r", "r/a/f.py:C", "twice(near(once("), ("function", "r/c/k.py", "w", "r", "", "twice(near("),
        ("function", "q/d.py", "x", "q", "", "twice(near(once("), ("class", "q/e/z.py", "near", "q", "", ""), ("interface", "r/a/i.py", "near", "r", "", ""), ("function", "r/a/j.py", "near", "r", "", ""), ("function", "r/d/y.py", "near", None, "", "twice("),
    ]
    rows = [(k, *s) for k, s in enumerate(symbols)]
    nodes = graph.symbol_nodes(spark.createDataFrame([(*r, 1, 2, None, None, None) for r in rows], "symbol_id long, kind string, file_path string, name string, repo string, class_name string, content string, start_line int, end_line int, is_exported boolean, signature string, decorators array<string>"))
    order = {"function": 1, "method": 2, "class": 3, "interface": 4}
    ident = lambda s: f"{s[0]}:{s[1]}:{s[4] + '.' if s[4] else ''}{s[2]}"
    folder = lambda p: p.rpartition("/")[0]
    want = set()
    for s in symbols:
        if s[0] in ("function", "method"):
            for name in set(s[5].replace("(", " ").split()) - {s[2]}:
                found = [c for c in symbols if c[2] == name]
                levels = [[c for c in found if c[1] == s[1]], [c for c in found if folder(c[1]) == folder(s[1])], [c for c in found if c[3] == s[3] and s[3]], found]
                for level in levels:
                    if level:
                        want.add((ident(s), min((order[c[0]], ident(c)) for c in level)[1]))
                        break
    got = [(r.src, r.dst) for r in graph.call_edges(nodes).collect()]
    assert sorted(got) == sorted(want)
    assert len(want) > 12


def test_labels_leave_no_member_out(spark):
    """Equal names, members that no node is known of, and nodes in no community."""
    names = {"a1": "run", "a2": "run", "a3": "stop", "a4": "walk", "b1": "go", "b2": "go", "c2": "x", "e1": "alone"}
    of = {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a1", "b1": "b2", "b2": "b2", "c1": "c2", "c2": "c2", "c3": "c2", "d1": "d1", "d2": "d1"}
    nodes = spark.createDataFrame(list(names.items()), "id string, name string")
    got = {r.community: (r.member_count, r.members, r.label) for r in community.describe(spark.createDataFrame(list(of.items()), "id string, community string"), nodes).collect()}
    assert got == {
        "a1": (4, ["a1", "a2", "a3", "a4"], "Community (run, run, stop, +1 more)"), "b2": (2, ["b1", "b2"], "Community (go, go)"), "c2": (3, ["c1", "c2", "c3"], "Community (x)"),
        "d1": (2, ["d1", "d2"], "Community (2 members)"), "e1": (1, ["e1"], "Community (alone)"),
    }


def test_labels_of_all_symbols(spark):
    """Of the smallest tables each function, method, class and interface has its place, whether it calls or not."""
    base = "/root/testdata/sf0.001"
    names = {r.id: r.name for r in CodeGraph(spark, base).symbols.where("label in ('function', 'method', 'class', 'interface')").collect()}
    calling = {r.id: r.community for r in QUERIES["communities"](spark, base).collect()}
    assert calling.keys() < names.keys()
    want = {}
    for i in sorted(names):
        want.setdefault(calling.get(i, i), []).append(i)
    for c, ids in want.items():
        known = sorted(names[i] for i in ids)
        want[c] = (len(ids), ids, "Community (" + ", ".join(known[:3]) + (f", +{len(known) - 3} more)" if len(known) > 3 else ")"))
    assert {r.community: (r.member_count, r.members, r.label) for r in QUERIES["community_labels"](spark, base).collect()} == want

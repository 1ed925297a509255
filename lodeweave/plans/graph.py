"""The property graph of a code base: nodes and typed edges from files, symbols, imports and commits.

A symbol's id is ``kind:path:[class.]name``; of several symbols with one id the latest stands. Calls are
resolved to the nearest definition of the name: in the same file, folder, repository, or anywhere. Each
level is a look-up table with one row per key, aggregated before its join, so that a name with
many definitions costs no more than any other.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import ancestors, basename, dirname, extension, stem
from ..sources.parsers import parse_calls, parse_symbols
from ..sources.tables import stored, table

#: Labels that stand for symbols when symbols are counted or changed.
SYMBOL_LABELS = ("function", "method", "class", "interface", "type_alias", "enum")
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
TYPE_REF = r":\s*([A-Z][A-Za-z0-9_]*)"


def node_id(label: Column, path: Column, class_name: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), path, F.lit(":"), F.when(class_name != "", F.concat(class_name, F.lit("."))).otherwise(F.lit("")), name)


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """One node for each id, from the symbol with the greatest symbol_id; nulls become zero values."""
    rows = symbols.where("kind is not null and file_path is not null and name is not null").select(
        node_id(F.col("kind"), F.col("file_path"), F.coalesce("class_name", F.lit("")), F.col("name")).alias("id"),
        F.struct(
            "symbol_id", F.col("kind").alias("label"), "name", "file_path", "repo", F.coalesce("class_name", F.lit("")).alias("class_name"), "start_line", "end_line",
            F.coalesce("is_exported", F.lit(False)).alias("is_exported"), F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("content", F.lit("")).alias("content"),
            F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"),
        ).alias("s"),
    )
    return rows.groupBy("id").agg(F.max_by("s", F.col("s.symbol_id")).alias("s")).select("id", "s.*")


def without_texts(symbols: DataFrame) -> DataFrame:
    return symbols.withColumns({"content": F.lit(""), "signature": F.lit(""), "decorators": F.array().cast("array<string>")})


def only_calls(symbols: DataFrame) -> DataFrame:
    """Symbols with nothing left of a content but what it calls, for ``call_edges`` the same."""
    called = F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)))
    return without_texts(symbols.withColumn("called", F.array_join(F.transform(called, lambda n: F.concat(n, F.lit("("))), " "))).drop("content").withColumnRenamed("called", "content")


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and folder nodes (id, label, name, file_path), and contains edges (src, dst)."""
    paths = files.where("repo is not null and rel_path is not null").select(F.concat_ws("/", "repo", "rel_path").alias("file_path")).distinct()
    file_nodes = paths.select(F.concat(F.lit("file:"), F.col("file_path")).alias("id"), F.lit("file").alias("label"), basename(F.col("file_path")).alias("name"), "file_path")
    folders = paths.select(F.explode(ancestors(F.col("file_path"))).alias("file_path")).distinct()
    folder_nodes = folders.select(F.concat(F.lit("folder:"), F.col("file_path")).alias("id"), F.lit("folder").alias("label"), basename(F.col("file_path")).alias("name"), "file_path")
    nodes = file_nodes.union(folder_nodes)
    edges = nodes.where(F.instr("file_path", "/") > 0).select(F.concat(F.lit("folder:"), dirname(F.col("file_path"))).alias("src"), F.col("id").alias("dst"))
    return nodes, edges


def _nearest(uses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst): each use (label, file_path, tail, repo, name) with the nearest candidate (id, rank, name, ...) of its name; a row for each use.

    Most names have one candidate, which is the nearest to all; only the uses of others look for nearer ones.
    """
    ranked = F.min(F.concat_ws("|", F.col("rank").cast("string"), "id"))
    known = uses.join(candidates.groupBy("name").agg(ranked.alias("c3"), (F.count("*") > 1).alias("several")), "name")  # most names that are used are defined nowhere
    more = known.where("several").withColumn("dir", dirname(F.col("file_path")))
    for level, keys in enumerate((["file_path", "name"], ["dir", "name"], ["repo", "name"])):
        more = more.join(candidates.groupBy(*keys).agg(ranked.alias("found")), keys, "left")
        more = more.withColumn("c3" if level == 2 else "best", F.coalesce(*["best"] * (level > 0), "found", *["c3"] * (level == 2))).drop("found")
    src = F.concat_ws(":", "label", "file_path", "tail")
    out = known.where("not several").select("label", "file_path", "tail", "c3").union(more.select("label", "file_path", "tail", "c3"))
    return out.select(src.alias("src"), F.substr("c3", F.lit(3)).alias("dst")).where("dst is not null and dst != src")


def _tail() -> Column:
    """What stands in an id after its label and path."""
    return F.substr("id", F.length("label") + F.length("file_path") + F.lit(3)).alias("tail")


def _uses(nodes: DataFrame, names: Column) -> DataFrame:
    return nodes.select("label", "file_path", _tail(), "repo", F.explode(F.array_distinct(names)).alias("name"))


def _candidates(nodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    rank = F.coalesce(*(F.when(F.col("label") == label, F.lit(k + 1)) for k, label in enumerate(order)))
    return nodes.where(F.col("label").isin(*order)).select("id", rank.alias("rank"), "name", "file_path", dirname(F.col("file_path")).alias("dir"), "repo")


def call_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) of functions and methods that call something of a known name other than their own."""
    callers = nodes.where(F.col("label").isin("function", "method"))
    names = F.array_remove(F.array_remove(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)), F.lit("")), F.col("name"))
    return _nearest(_uses(callers, names), _candidates(nodes, ("function", "method", "class", "interface")))  # what is found has the name: a row for each edge


def type_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) of symbols whose signature names a class or interface as a type."""
    uses = _uses(nodes.where(F.col("label").isin("function", "method")), F.regexp_extract_all("signature", F.lit(TYPE_REF), F.lit(1)))
    return _nearest(uses, _candidates(nodes, ("class", "interface"))).distinct()


def heritage(nodes: DataFrame) -> DataFrame:
    """(id, base, type): bases that a class's signature names, ``implements`` for mixins, protocols and interfaces."""
    text = F.col("signature")
    python = F.filter(F.split(F.regexp_extract(text, r"^class\s+\w+\s*\(([^)]*)\)", 1), r"\s*,\s*"), lambda b: b.rlike(r"^[A-Za-z_]\w*$"))
    extends = F.filter(F.array(F.regexp_extract(text, r"\sextends\s+(\w+)", 1)), lambda b: b != "")
    implements = F.filter(F.array(F.regexp_extract(text, r"\simplements\s+(\w+)", 1)), lambda b: b != "")
    kind = F.when(F.col("base").rlike("(Mixin|Protocol)$"), "implements").otherwise("extends")
    classes = nodes.where("label = 'class'")
    return (
        classes.select("id", F.explode(F.concat(python, extends)).alias("base")).select("id", "base", kind.alias("type"))
        .union(classes.select("id", F.explode(implements).alias("base")).select("id", "base", F.lit("implements").alias("type"))).distinct()
    )


def heritage_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, type) of classes and their bases that are known."""
    uses = heritage(nodes).join(nodes.select("id", "label", "file_path", "repo"), "id").select(F.col("id").alias("src"), "label", "file_path", _tail(), "repo", F.col("base").alias("name"), "type")
    typed = _nearest(uses.drop("src", "type"), _candidates(nodes, ("class", "interface"))).distinct()
    names = nodes.select(F.col("id").alias("dst"), F.col("name").alias("base"))
    kinds = uses.groupBy("src", F.col("name").alias("base")).agg(F.min("type").alias("type"))
    return typed.join(names, "dst").join(kinds, ["src", "base"]).select("src", "dst", "type")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of files whose relative import names another file, whatever its extension."""
    paths = files.where("repo is not null and rel_path is not null").select(F.concat_ws("/", "repo", "rel_path").alias("file_path")).distinct()
    module = F.col("module_path")
    python = extension(F.col("file_path")) == ".py"
    ups = F.when(python, F.length(F.regexp_extract(module, r"^(\.*)", 1)) - 1).otherwise(F.floor((F.length(module) - F.length(F.replace(module, F.lit("../"), F.lit("")))) / 3))
    rest = F.when(python, F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))).otherwise(F.regexp_replace(module, r"^(\.\.?/)+", ""))
    folder = F.split(dirname(F.col("file_path")), "/")
    keep = F.size(folder) - ups.cast("int")
    target = F.concat_ws("/", F.array_join(F.slice(folder, F.lit(1), F.greatest(keep, F.lit(0))), "/"), rest)
    wanted = imports.where("is_relative and module_path is not null and file_path is not null").select(F.concat(F.lit("file:"), F.col("file_path")).alias("src"), F.when(keep > 0, target).alias("target")).distinct()
    known = paths.groupBy(stem(F.col("file_path")).alias("target")).agg(F.min("file_path").alias("file_path"))
    return wanted.join(known, "target").select("src", F.concat(F.lit("file:"), F.col("file_path")).alias("dst")).where("src != dst").distinct()


def call_sites(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, file_path, name, receiver, package) of what the symbols' contents call, each once.

    What stands before a dot is an imported package (its alias or last segment), then given as such; the
    own object (self, cls, this, or a Go method's receiver), whose class is given; or just a name.
    """
    pattern = r"(?:([A-Za-z_][A-Za-z0-9_]*)\.)?([A-Za-z_][A-Za-z0-9_]*)\("
    text = F.col("content")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("name"))
    own = F.regexp_extract(text, r"func \((\w+) ", 1)
    sites = symbols.where(F.col("label").isin("function", "method")).select(F.col("id").alias("src"), F.col("name").alias("own_name"), "file_path", "class_name", own.alias("own"), F.explode(F.array_distinct(pairs)).alias("c"))
    alias = F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias")).otherwise(last_segment(F.col("module_path")))
    known = imports.where("module_path is not null and file_path is not null").groupBy("file_path", alias.alias("before")).agg(F.min("module_path").alias("package"))
    placed = sites.select("src", "own_name", "file_path", "class_name", "own", F.col("c.before").alias("before"), F.col("c.name").alias("name")).join(known, ["file_path", "before"], "left")
    is_own = (F.col("class_name") != "") & (F.col("before").isin("self", "cls", "this") | ((F.col("before") != "") & (F.col("before") == F.col("own"))))
    receiver = F.when(F.col("package").isNotNull(), F.lit("")).when(is_own, F.col("class_name")).otherwise(F.col("before"))
    return placed.where("name != own_name").select("src", "file_path", "name", receiver.alias("receiver"), F.coalesce("package", F.lit("")).alias("package")).distinct()


def last_segment(package: Column) -> Column:
    """The last part of a package's or module's path."""
    return F.element_at(F.split(package, r"[/.]"), -1)


def resolve(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, rule): each call site (src, name, receiver, package) with the definition that it means.

    By the first rule that finds one: 1 a function of the name below a folder named as the package; 2, with
    a package, any function of the name; 3 a method of the name in the class that the receiver names; 4 the
    name among functions, classes, interfaces and type aliases, in this order. Of several the least id.
    Each rule is a look-up table with one row for each key.
    """
    functions = nodes.where("label = 'function'")
    folder = F.element_at(F.split(dirname(F.col("file_path")), "/"), -1)
    order = F.when(F.col("label") == "function", 1).when(F.col("label") == "class", 2).when(F.col("label") == "interface", 3).when(F.col("label") == "type_alias", 4)
    tables = (
        (functions.groupBy("name", folder.alias("folder")).agg(F.min("id").alias("d1")), ["name", "folder"]),
        (functions.groupBy("name").agg(F.min("id").alias("d2")), ["name"]),
        (nodes.where("label = 'method' and class_name != ''").groupBy("name", F.col("class_name").alias("receiver")).agg(F.min("id").alias("d3")), ["name", "receiver"]),
        (nodes.where(order.isNotNull()).groupBy("name").agg(F.min(F.struct(order.alias("o"), "id")).alias("best")).select("name", F.col("best.id").alias("d4")), ["name"]),
    )
    out = sites.join(nodes.select("name").distinct(), "name", "left_semi").withColumn("folder", last_segment(F.col("package")))
    for known, keys in tables:
        out = out.join(known, keys, "left")
    packaged = F.col("package") != ""
    found = F.coalesce(*(F.when(ok & F.col(d).isNotNull(), F.struct(F.lit(k).alias("rule"), F.col(d).alias("dst"))) for k, d, ok in ((1, "d1", packaged), (2, "d2", packaged), (3, "d3", F.col("receiver") != ""), (4, "d4", F.lit(True)))))
    return out.select("src", found.alias("f")).where("f.dst != src").groupBy("src", "f.dst").agg(F.min("f.rule").alias("rule"))


def parsed_graph(files: DataFrame, mode: str = "file") -> tuple[DataFrame, DataFrame]:
    """Nodes and calls (src, dst, rule) of source files alone, parsed and resolved.

    ``mode`` file: every symbol of a file calls all that its file calls; span: a symbol calls what stands
    between its lines.
    """
    parsed = stored(parse_symbols(files))
    numbered = parsed.withColumn("symbol_id", F.xxhash64("file_path", "kind", "class_name", "name", "start_line"))
    nodes = symbol_nodes(numbered)
    calls = parse_calls(files).select("file_path", "start_line", "name", "receiver", "package").distinct()
    places = parsed.select(node_id(F.col("kind"), F.col("file_path"), F.col("class_name"), F.col("name")).alias("src"), "file_path", F.col("start_line").alias("from"), F.col("end_line").alias("to"), F.col("name").alias("own_name")).distinct()
    inside = F.lit(True) if mode == "file" else (F.col("start_line") >= F.col("from")) & (F.col("start_line") <= F.col("to"))
    sites = places.join(calls, "file_path").where(inside & (F.col("name") != F.col("own_name"))).select("src", "file_path", "name", "receiver", "package").distinct()
    return nodes, resolve(sites, nodes)


@lru_cache(maxsize=4)
def _kept(application: str, base: str) -> dict[str, DataFrame]:
    return {}


class CodeGraph:
    """Nodes and edges of the tables under a folder. What several queries need is kept between them."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base
        self.kept = _kept(spark.sparkContext.applicationId, base)

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = make().persist()
        return self.kept[name]

    def release(self) -> None:
        """Lets go of what is kept, as when the tables have changed."""
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()

    @property
    def symbols(self) -> DataFrame:
        return self._keep("symbols", lambda: symbol_nodes(table(self.spark, self.base, "symbols")))

    @property
    def calls(self) -> DataFrame:
        """Of the symbols if these are kept already, else of nodes with as much of each text as calls need."""
        return self._keep("calls", lambda: call_edges(self.kept["symbols"] if "symbols" in self.kept else self._keep("callers", lambda: symbol_nodes(only_calls(table(self.spark, self.base, "symbols"))))))

    def names(self) -> DataFrame:
        """(id, label, name) of the symbols, of what is kept already if there is any."""
        kept = self.kept.get("symbols", self.kept.get("callers"))
        nodes = symbol_nodes(without_texts(table(self.spark, self.base, "symbols"))) if kept is None else kept
        return nodes.select("id", "label", "name")

    def nodes(self) -> DataFrame:
        """(id, label, name, file_path) of files, folders and symbols."""
        return structure(table(self.spark, self.base, "files"))[0].union(self.symbols.select("id", "label", "name", "file_path"))

    def edges(self) -> DataFrame:
        """(src, dst, type) of all edges that come from the tables."""
        files = table(self.spark, self.base, "files")
        typed = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("type"))
        defines = self.symbols.select(F.concat(F.lit("file:"), F.col("file_path")).alias("src"), F.col("id").alias("dst"))
        return (
            typed(structure(files)[1], "contains").union(typed(defines, "defines")).union(typed(import_edges(files, table(self.spark, self.base, "imports")), "imports"))
            .union(typed(self.calls, "calls")).union(typed(type_edges(self.symbols), "uses_type")).union(heritage_edges(self.symbols))
        )

"""Symbols that nothing calls, with exemptions, call patterns and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_entry(nodes: DataFrame) -> Column:
    """main and test functions, handlers by decorator, commands by name."""
    function = F.col("label") == "function"
    handler = F.exists("decorators", lambda d: d.rlike(r"HandleFunc|Handle|http\."))
    return (function & (F.col("name") == "main")) | (function & F.col("name").rlike("^(Test|test_)")) | handler | F.col("name").rlike("Cmd|Command")


def is_test(path: Column, label: Column, name: Column) -> Column:
    return path.rlike(r"_test\.(go|py)$") | ((label == "function") & name.rlike("^(Test|test_)"))


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def is_constructor(label: Column, name: Column, class_name: Column) -> Column:
    return (label == "method") & ((name == F.concat(F.lit("New"), class_name)) | (name == "__init__"))


def is_exempt(nodes: DataFrame) -> Column:
    c = F.col
    return is_entry(nodes) | c("is_exported") | is_test(c("file_path"), c("label"), c("name")) | is_dunder(c("name")) | is_constructor(c("label"), c("name"), c("class_name"))


def is_allowed(name: Column, path: Column, pattern: Column) -> Column:
    """Framework hooks by name and place, and what is called by dispatch."""
    return (path.contains("server.go") & name.startswith("handle")) | (path.contains("cmd.go") & name.rlike("^(setup|configure|output)")) | name.startswith("register") | F.coalesce(pattern.isin("dynamic_dispatch", "framework_dispatch", "interface_impl", "callback"), F.lit(False))


def inner_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, within) of calls within a file (intra_file) or else between the methods of a class (intra_class)."""
    ends = nodes.select("id", "label", "file_path", "class_name")
    src, dst = (ends.select(*(F.col(c).alias(f"{p}_{c}") for c in ends.columns)) for p in ("s", "d"))
    same_class = (F.col("s_label") == "method") & (F.col("d_label") == "method") & (F.col("s_class_name") != "") & (F.col("s_class_name") == F.col("d_class_name"))
    within = F.when(F.col("s_file_path") == F.col("d_file_path"), "intra_file").when(same_class, "intra_class")
    both = calls.join(src, F.col("src") == F.col("s_id")).join(dst, F.col("dst") == F.col("d_id"))
    return both.select("src", "dst", within.alias("within")).where("within is not null")


def call_patterns(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, call_pattern) of callees: dispatched by a framework or dynamically, else called within their file or class."""
    ends = nodes.select("id", "label", "name", "file_path", "class_name")
    src, dst = (ends.select(*(F.col(c).alias(f"{p}_{c}") for c in ends.columns)) for p in ("s", "d"))
    both = calls.join(src, F.col("src") == F.col("s_id")).join(dst, F.col("dst") == F.col("d_id"))
    framework = F.col("s_file_path").contains("cmd.go") & ((F.col("s_name") == "Run") | F.col("s_name").endswith("Cmd"))
    dynamic = F.col("s_file_path").contains("server.go") & F.col("s_name").contains("handle")
    same_file = F.col("s_file_path") == F.col("d_file_path")
    same_class = (F.col("s_label") == "method") & (F.col("d_label") == "method") & (F.col("s_class_name") != "") & (F.col("s_class_name") == F.col("d_class_name"))
    rank = F.when(framework, 4).when(dynamic, 3).when(same_file, 2).when(same_class, 1)
    name = F.element_at(F.array(*map(F.lit, ("intra_class", "intra_file", "dynamic_dispatch", "framework_dispatch"))), F.max("rank"))
    return both.select(F.col("dst").alias("id"), rank.alias("rank")).where("rank is not null").groupBy("id").agg(name.alias("call_pattern"))


def uncalled(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    return nodes.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def overriding(dead: DataFrame, nodes: DataFrame, heritage: DataFrame, living: DataFrame) -> DataFrame:
    """(id) of dead methods that override a living one: same name, in a class that the method's class extends."""
    classes = nodes.where("label = 'class'").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    bases = heritage.where("type = 'extends'").select(F.col("src").alias("class_id"), F.col("dst").alias("base_id"))
    base_names = nodes.where("label = 'class'").select(F.col("id").alias("base_id"), F.col("name").alias("base_name"))
    kept = living.where("label = 'method'").select(F.col("class_name").alias("base_name"), "name").distinct()
    methods = dead.where("label = 'method'").select("id", "class_name", "name")
    return methods.join(classes, "class_name").join(bases, "class_id").join(base_names, "base_id").join(kept, ["base_name", "name"], "left_semi").select("id").distinct()


def confidence(nodes: DataFrame) -> Column:
    """How sure it is that a symbol is dead: from call_pattern, place and name."""
    private = F.col("label").isin("function", "method") & F.col("name").rlike("^[a-z]")
    return (
        F.when(F.coalesce(F.col("call_pattern").isin("dynamic_dispatch", "framework_dispatch"), F.lit(False)), "low")
        .when(F.coalesce(F.col("call_pattern") == "intra_class", F.lit(False)) | F.col("file_path").contains("_test") | private, "medium").otherwise("high")
    )


def dead_code(nodes: DataFrame, calls: DataFrame, heritage: DataFrame) -> DataFrame:
    """(id, label, name, file_path, confidence) of dead symbols: uncalled, not exempt, not allowed, overriding nothing alive."""
    patterns = call_patterns(nodes, calls)
    marked = uncalled(nodes, calls).join(patterns, "id", "left")
    dead = marked.where(~is_exempt(nodes) & ~is_allowed(F.col("name"), F.col("file_path"), F.col("call_pattern")))
    living = nodes.join(dead.select("id"), "id", "left_anti")
    kept = dead.join(overriding(dead, nodes, heritage, living), "id", "left_anti")
    return kept.select("id", "label", "name", "file_path", confidence(kept).alias("confidence"))

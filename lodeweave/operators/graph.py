"""Filters, neighbourhoods, counts and changes of a property graph held as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_label(nodes: DataFrame, *labels: str) -> DataFrame:
    return nodes.where(F.col("label").isin(*labels))


def of_type(edges: DataFrame, kind: str | None) -> DataFrame:
    """Edges of a type; all if none is given."""
    return edges if not kind else edges.where(F.col("type") == kind)


def outgoing(edges: DataFrame, node: Column, kind: str | None = None) -> DataFrame:
    return of_type(edges, kind).where(F.col("src") == node)


def incoming(edges: DataFrame, node: Column, kind: str | None = None) -> DataFrame:
    return of_type(edges, kind).where(F.col("dst") == node)


def having_incoming(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    return nodes.join(of_type(edges, kind).select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def neighbours(nodes: DataFrame, calls: DataFrame, of: DataFrame, direction: str) -> DataFrame:
    """(of, id, name, file_path): callers or callees of the nodes ``of`` (id); unknown ends are dropped."""
    at, to = ("dst", "src") if direction == "callers" else ("src", "dst")
    found = calls.join(of.select(F.col("id").alias(at)), at).select(F.col(at).alias("of"), F.col(to).alias("id")).distinct()
    return found.join(nodes.select("id", "name", "file_path"), "id").select("of", "id", "name", "file_path")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; of equal keys in ``new`` any one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some nodes (id) and all edges at them."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept


def encoded(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, json): each row as a JSON text."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """The rows that ``encoded`` made texts of; what isn't right JSON gives nulls."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def property_text(properties: Column, name: str) -> Column:
    """A property of a JSON text as text; empty if it isn't there."""
    return F.coalesce(F.get_json_object(properties, f"$.{name}"), F.lit(""))


def bulk_load(nodes: DataFrame, edges: DataFrame, target: str) -> None:
    """Writes a graph as tables under ``target``, in place of what is there; nodes by label, edges by type."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{target}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{target}/edges")


def append(nodes: DataFrame | None, edges: DataFrame | None, target: str) -> None:
    """Adds nodes and edges to the tables under ``target``."""
    for rows, name, by in ((nodes, "nodes", "label"), (edges, "edges", "type")):
        if rows is not None:
            rows.write.mode("append").partitionBy(by).parquet(f"{target}/{name}")


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of the files (file_path) and all edges at them."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti"), kept


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by label and edges by type."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("label").alias("kind")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n")))


def best_name(nodes: DataFrame, query: str) -> DataFrame:
    """The one node that a name means: an exact name first, then the least id among those that contain it."""
    low = F.lit(query.lower())
    hits = nodes.where(F.contains(F.lower("name"), low))
    return hits.orderBy((F.col("name") == query).desc(), "id").limit(1)


def substring_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes whose name or path contains the query, whatever the case of ASCII letters; least ids first."""
    low = F.lit(query.lower())
    return nodes.where(F.contains(F.lower("name"), low) | F.contains(F.lower("file_path"), low)).orderBy("id").limit(limit)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

"""The registered queries of this subpackage: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import spread, table
from .broken_files import broken_files, broken_rates
from .documented_functions import documented_functions
from .eval_leaks import find_leaks
from .foreign_files import foreign_files
from .garbled_text import restore_texts
from .shared_spans import characters, shared_characters, shared_intervals
from .similar_vectors import similar_vectors
from .token_encoding import encode_corpus

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def source_records(spark: SparkSession, base: str) -> DataFrame:
    """Files and symbols as records of their file."""
    files = table(spark, base, "files").select(F.lit("file").alias("kind"), F.col("file_id").alias("record"), F.col("file_id").alias("owner"), F.col("content"))
    symbols = table(spark, base, "symbols").select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("record"), F.col("file_id").alias("owner"), F.col("content").cast("binary").alias("content"))
    return files.union(symbols)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Records with a stretch of 200 characters that a record of another file has too."""
    shared = shared_intervals(source_records(spark, base))
    return shared.select(F.col("kind").alias("record_kind"), F.col("record").alias("record_id")).distinct()


def p1_shared(spark: SparkSession, base: str) -> DataFrame:
    """For every record, its length and how many of its characters lie in shared stretches."""
    records = source_records(spark, base)
    sizes = characters(records.where("record is not null")).groupBy("kind", "record").agg(F.max("n_chars").alias("n_chars"))
    return (
        sizes.join(shared_characters(shared_intervals(records)), ["kind", "record"], "left")
        .select(F.col("kind").alias("record_kind"), F.col("record").alias("record_id"), "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    )


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return p2_verdicts(spark, base).where("broken").select("file_id").distinct()


def p2_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """Every file's verdict, with position and cause of what failed."""
    return broken_files(table(spark, base, "files"), table(spark, base, "file_types"))


def p2_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of broken files by repository and language."""
    return broken_rates(p2_verdicts(spark, base))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Files that are generated, minified, third-party copies or data."""
    return p3_reasons(spark, base).select("file_id")


def p3_reasons(spark: SparkSession, base: str) -> DataFrame:
    """Why a file is not the project's own hand-written source."""
    return foreign_files(table(spark, base, "files"))


def p3_handwritten(spark: SparkSession, base: str) -> DataFrame:
    """The files that remain as hand-written source."""
    files = table(spark, base, "files")
    return files.select("file_id", "repo", "rel_path").distinct().join(foreign_files(files), "file_id", "left_anti")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Functions and methods with a non-trivial description of their own."""
    return p4_pairs(spark, base).select("symbol_id").distinct()


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    """(name, signature, code) and description of every such function."""
    return documented_functions(table(spark, base, "symbols"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of nodes of which one is among the 10 nearest of the other, with a cosine of at least 0.9."""
    near = similar_vectors(table(spark, base, "node_vectors"), k=10, min_cosine=0.9)
    return near.select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def p5_nearest(spark: SparkSession, base: str) -> DataFrame:
    """The 10 nearest of all nodes for the twentieth of the nodes whose hash is divisible by 20."""
    near = similar_vectors(table(spark, base, "node_vectors"), k=10, factor=0.5, asked=F.pmod(F.xxhash64("node_id"), F.lit(20)) == 0)
    return near.select(F.col("id").alias("node_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(spread(table(spark, base, "documents").select("doc_id", "text")), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item's question or answer."""
    leaks = p7_leaks(spark, base)
    return leaks.where("exact_words >= 12").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, base: str) -> DataFrame:
    """Every overlap of at least 12 words, at most 2 of them exchanged, of a document with an item."""
    return find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items")).where("overlap_words >= 12")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with a garbled passage, restorable or not."""
    return p8_restored(spark, base).select("doc_id")


def p8_restored(spark: SparkSession, base: str) -> DataFrame:
    """Garbled documents with the wrong decodings that were undone and the restored text."""
    documents = table(spark, base, "documents")
    return restore_texts(spread(documents.select("doc_id", "text", "lang")), source=spread(documents.select("doc_id", "text")))


QUERIES = {"p1_found": p1_found, "p1_shared": p1_shared, "p2_found": p2_found, "p2_verdicts": p2_verdicts, "p2_rates": p2_rates, "p3_found": p3_found, "p3_reasons": p3_reasons, "p3_handwritten": p3_handwritten, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_nearest": p5_nearest, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_restored": p8_restored}
_WORDS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"

#: Given where SQL can do the same on whole tables; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "p5_found": """WITH valid AS (SELECT DISTINCT node_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM node_vectors WHERE node_id IS NOT NULL AND len(embedding) = 100
      AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    near AS (SELECT a, b, sim FROM (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM (SELECT x.node_id AS a, y.node_id AS b, list_cosine_similarity(x.v, y.v) AS sim FROM valid x JOIN valid y ON x.node_id <> y.node_id) WHERE sim >= 0.9) WHERE n <= 10)
    SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM near""",
    "p7_found": f"""WITH p AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM (SELECT item_id, question AS text FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items)),
    seeds AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS h, w[k:k + 11] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM p WHERE len(w) >= 12)),
    d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)
    SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, w[k:k + 11] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)) x JOIN seeds s ON s.h = hash(x.g) AND s.g = x.g""",
}

"""Term search, vector search, TF-IDF vectors and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import code_tokens, tokens
from ..functions.vectors import cosine
from ..sources.tables import spread, stored

#: Terms of a vocabulary at most, and so the length of a TF-IDF vector.
VOCABULARY = 100
#: What parts the words of code.
WORD_ENDS = r"[^A-Za-z0-9_.\-]+"


def postings(docs: DataFrame, key: str, *texts: Column) -> DataFrame:
    """(token, key, tf): how often each token stands in a document's texts."""
    words = F.concat(*(tokens(t) for t in texts))
    return docs.select(F.col(key), F.explode(words).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def _read(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, words): each text's tokens; a table of one file is spread over the cluster first."""
    return spread(docs.select(F.col(key), text.alias("text"))).select(F.col(key), tokens(F.col("text")).alias("words"))


def _count(term: str) -> Column:
    """How often a term stands in the column words."""
    return F.size("words") - F.size(F.array_remove("words", F.lit(term)))


def term_search(docs: DataFrame, key: str, text: Column, query: list[str], limit: int) -> DataFrame:
    """(key, score): the sum of term counts over the query's tokens, a repeated one again; greatest first, then least key.

    One narrow pass over the texts; rows of one key count together.
    """
    score = sum((_count(t).cast("long") * query.count(t) for t in dict.fromkeys(query)), F.lit(0).cast("long"))
    hits = _read(docs, key, text).select(F.col(key), score.alias("score")).where("score > 0").groupBy(key).agg(F.sum("score").alias("score"))
    return hits.orderBy(F.desc("score"), key).limit(limit)


def bm25(docs: DataFrame, key: str, text: Column, query: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) by Okapi BM25 over the rows of ``docs``, one for each key; texts without tokens are no documents.

    One narrow pass gives a few numbers for each text; from them come, in one row, the number of texts, their
    mean length and how many have each term, and then the scores.
    """
    names = {t: f"n{k}" for k, t in enumerate(dict.fromkeys(query))}
    rows = stored(_read(docs, key, text).select(F.col(key), F.size("words").alias("length"), *(_count(t).alias(n) for t, n in names.items())).where("length > 0"))
    facts = rows.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(n) > 0).alias(n) for n in names.values()))).scalar()
    score = F.lit(0.0)
    hits = rows.where(sum((F.col(n) for n in names.values()), F.lit(0)) > 0).withColumn("facts", facts)
    for n in names.values():
        tf, df = F.col(n), F.col(f"facts.{n}")
        idf = F.log(1 + (F.col("facts.n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("facts.mean")))
    return hits.select(F.col(key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, limit: int) -> DataFrame:
    """(key, similarity) of the vectors most similar to the one of ``query`` (one row, column q); only positive ones."""
    compared = vectors.withColumn("q", query.select("q").limit(1).scalar()).select(key, F.round(cosine(F.col(vector), F.col("q")), 6).alias("similarity"))
    return compared.where("similarity > 0").groupBy(key).agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), key).limit(limit)


# An index of code tokens: (token, id, n), a row for each token of a node.


def code_index(nodes: DataFrame, *texts: str) -> DataFrame:
    """(token, id, n): how often the code tokens of a node's texts occur; texts are first cut at what stands in no name."""
    text = F.concat_ws(" ", *(texts or ("name", "signature", "content")))
    words = nodes.select("id", F.explode(F.split(text, WORD_ENDS)).alias("word")).where("word != ''")
    return words.select(F.explode(code_tokens(F.col("word"))).alias("token"), "id").groupBy("token", "id").agg(F.count("*").alias("n"))


def code_search(index: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """(id, score): nodes by how many of the query's distinct code tokens they have; greatest first, then least id. No limit if 0."""
    wanted = index.sparkSession.range(1).select(F.explode(F.flatten(F.transform(F.split(F.lit(query), WORD_ENDS), code_tokens))).alias("token")).where("token != ''").distinct()
    hits = index.join(F.broadcast(wanted), "token").groupBy("id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "id")  # the tokens of one query
    return hits.limit(limit) if limit > 0 else hits


def without_nodes(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the tokens of some nodes (id)."""
    return index.join(ids.select("id").distinct(), "id", "left_anti").select("token", "id", "n")


def with_nodes(index: DataFrame, nodes: DataFrame, *texts: str) -> DataFrame:
    """The index with some nodes indexed anew: their old tokens go, those of their texts come."""
    return without_nodes(index, nodes).unionByName(code_index(nodes, *texts))


def details(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Search hits with the name, label and path of their nodes; hits of unknown nodes are dropped."""
    return hits.join(nodes.select("id", "label", "name", "file_path"), "id")


def resolve_name(index: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """The one node that a name means: of the ten best hits one of that very name, else the best."""
    hits = details(code_search(index, query, 10), nodes)
    return hits.orderBy((F.col("name") == query).desc(), F.desc("score"), "id").limit(1)


def fuse(left: DataFrame, right: DataFrame, key: str, limit: int, k: int = 60) -> DataFrame:
    """(key, score): reciprocal-rank fusion of two short result lists (key, rank from 0)."""
    both = left.select(key, "rank").union(right.select(key, "rank"))
    return both.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def ranked(hits: DataFrame, key: str, score: str) -> DataFrame:
    """A short result list with its ranks from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, first, df): where each term comes first, by key and place, and how many documents have it. One shuffle."""
    words = _read(docs.where(F.col(key).isNotNull()), key, text)
    one = words.select(F.col(key), F.explode(F.array_distinct("words")).alias("term"), "words").select(F.col(key), "term", (F.array_position("words", F.col("term")) - 1).alias("pos"))
    return one.groupBy("term").agg(F.min(F.struct(F.col(key), F.col("pos"))).alias("first"), F.count("*").alias("df"))


def vocabulary(docs: DataFrame, key: str, text: Column, size: int = VOCABULARY) -> DataFrame:
    """(term, idx): the terms that come first in the order of key and place."""
    first = terms(docs, key, text).orderBy("first", "term").limit(size)
    return first.select("term", (F.row_number().over(Window.orderBy("first", "term")) - 1).alias("idx"))


def _idf(docs: DataFrame, key: str, known: DataFrame) -> DataFrame:
    n = docs.where(F.col(key).isNotNull()).agg(F.count("*")).scalar()
    return known.withColumn("n", n).withColumn("idf", F.log(F.col("n") / F.col("df"))).drop("n")


def frequencies(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, df, idf): documents with each term, and ln(N / df) over all N documents; one row of ``docs`` for each key."""
    return _idf(docs, key, terms(docs, key, text)).select("term", "df", "idf")


def tfidf(docs: DataFrame, key: str, text: Column, size: int | None = None) -> DataFrame:
    """(key, term, weight): the non-zero parts of each document's unit vector over all terms of the corpus.

    With ``size``, over the first so many terms only, and with their numbers: (key, idx, weight). A part
    is tf / max tf * idf, where an idf of 0 counts as 1. Counts, lengths and norms of a document are
    windows over one partitioning.
    """
    own = Window.partitionBy(key)
    counted = _read(docs.where(F.col(key).isNotNull()), key, text).select(F.col(key), F.explode("words").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).withColumn("most", F.max("tf").over(own))
    known = terms(docs, key, text)
    if size is not None:
        first = known.orderBy("first", "term").limit(size)
        known = first.withColumn("idx", F.row_number().over(Window.orderBy("first", "term")) - 1)
    rated = _idf(docs, key, known).select("term", *(["idx"] if size is not None else []), F.when(F.col("idf") == 0, 1.0).otherwise(F.col("idf")).alias("idf"))
    parts = counted.join(F.broadcast(rated) if size is not None else rated, "term").withColumn("w", F.col("tf") / F.col("most") * F.col("idf"))
    unit = parts.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))).where("norm > 0")
    return unit.select(key, "term" if size is None else "idx", (F.col("w") / F.col("norm")).alias("weight"))

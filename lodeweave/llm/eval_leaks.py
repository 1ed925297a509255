"""Evaluation items that leak into a corpus, found by spaced-seed hashing.

A seed is a fixed mask over a window of words; positions where the mask has 0 are ignored, so a seed
still matches where a word there was exchanged. Seeds of all items are joined with the seeds of all
documents, of which a filter lets only those pass that some item may have; along every hit's alignment the words of both sides are then compared, which gives the
longest exact run and the longest overlap that tolerates substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread, stored
from .rolling import U, in_steps, mixed, word_hashes

#: Masks over 12 words; any two of the 12 positions are zeros of one mask, so together they meet every window of 12 words with up to two substitutions.
MASKS = (
    "101110110101", "110011111100", "111111101000", "110111000111", "001011101111", "100101111011",
    "111011010011", "111000101111", "101110011110", "011101011101", "010110111011", "011101110110",
)
#: The filter of the items' seeds has so many slots for each, 2**bits at least and at most, and looks at a seed's bits after each of these shifts.
SLOTS, LEAST_BITS, MOST_BITS, PROBES = 64, 16, 28, (0, 18, 36)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash of each window of words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k, on in enumerate(mask):
        if on == "1":
            out += words[k : k + n] * (mixed(np.array([k + 1])) | U(1))
    return mixed(out)


def _best(equal: np.ndarray, spare: int) -> tuple[int, int, int]:
    """The longest run of equal words; the longest stretch with at most ``spare`` unequal ones, and how many it has.

    The stretch begins and ends with an equal word.
    """
    off = np.flatnonzero(~equal)
    walls = np.concatenate(([-1], off, [len(equal)]))
    run = int((np.diff(walls) - 1).max())
    best = (0, 0)
    for used in range(min(spare, len(off)) + 1):
        for a in range(len(walls) - 1 - used):
            inner = np.flatnonzero(equal[walls[a] + 1 : walls[a + used + 1]])
            if len(inner):
                lo, hi = int(inner[0]), int(inner[-1])
                part = equal[walls[a] + 1 + lo : walls[a] + 2 + hi]
                if len(part) > best[0]:
                    best = (len(part), int((~part).sum()))
    return run, *best


def _hits(texts: list[str], masks: tuple[str, ...], known: np.ndarray, bits: int) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (mask, seed, place) of every seed that the filter of the items' seeds knows."""
    words, owner = word_hashes(texts)
    out: dict[int, list[tuple[int, int, int]]] = {}
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    for number, mask in enumerate(masks):
        s = seeds(words, mask)
        at = np.arange(len(s))
        for shift in PROBES:
            slot = ((s[at] << U(shift)) >> U(64 - bits)).astype(np.int64)
            at = at[((known[slot >> 6] >> (slot & 63).astype(U)) & U(1)) == 1]
        at = at[owner[at] == owner[at + len(mask) - 1]]
        for row, seed, place in zip(owner[at].tolist(), s[at].view(np.int64).tolist(), (at - begins[owner[at]]).tolist()):
            out.setdefault(row, []).append((number, seed, place))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_cols: tuple[str, ...] = ("question", "answer"),
    substitutions: int = 2,
    masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """(``id_col``, ``item_col``, passage, exact_words, overlap_words, substitutions): alignments of
    documents with passages of items that share a spaced seed, one row for each pair and passage with
    its longest exact run and longest overlap with at most so many substitutions.

    A run of at least as many words as the masks span is always found; with the default masks, so is
    every stretch of at least 12 words with at most two substitutions. Null texts and passages have
    no words; a passage shorter than the masks has no seeds; repeated rows count once. The corpus is read
    once: documents keep the seeds that a filter of a bounded size knows, which are then joined with the
    seeds of the items, and the alignments of the joined with the passages' words. The number of items
    isn't limited; the filter has 2**28 slots of a bit at most, and if they get full only lets more
    seeds pass.
    """
    spark = docs.sparkSession
    passages = (
        items.select(F.col(item_col).alias("item"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in passage_cols])).alias("p"))
        .select("item", "p.name", "p.text").where("text is not null").distinct()
        .withColumns({"p1": F.xxhash64("item", "name", "text"), "p2": F.xxhash64("text", F.lit("second"), "name", "item")})
    )

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for p1, p2, text in zip(*(c.to_pylist() for c in batch.columns)):
                words, _ = word_hashes([text])
                for number, mask in enumerate(masks):
                    rows += [(p1, p2, number, seed, place) for place, seed in enumerate(seeds(words, mask).view(np.int64).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["p1", "p2", "mask", "seed", "there"])

    wanted = stored(passages.select("p1", "p2", "text").mapInArrow(item_seeds, "p1 long, p2 long, mask int, seed long, there int"))
    bits = int(np.clip(np.ceil(np.log2(SLOTS * max(wanted.count(), 1))), LEAST_BITS, MOST_BITS))
    slots = wanted.select(F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("seed", shift), 64 - bits) for shift in PROBES))).alias("slot"))
    slot = F.col("slot")
    words = slots.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    known = np.zeros(1 << bits - 6, U)
    known[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(U)
    filtered = spark.sparkContext.broadcast(known)  # 32 MB at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at, found = [], []
            for a, b in in_steps([len(t) for t in texts]):
                for row, hits in sorted(_hits(texts[a:b], masks, filtered.value, bits).items()):
                    at.append(a + row)
                    found.append([{"mask": m, "seed": s, "here": p} for m, s, p in hits])
            if at:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(found, kind_of_hits)], ["id", "text", "d1", "d2", "hits"])

    kind_of_hits = pa.list_(pa.struct([("mask", pa.int32()), ("seed", pa.int64()), ("here", pa.int32())]))
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).withColumns({"d1": F.xxhash64("id", "text"), "d2": F.xxhash64("text", F.lit("second"), "id")})
    kind, item_kind = source.schema["id"].dataType.simpleString(), passages.schema["item"].dataType.simpleString()
    suspects = stored(source.mapInArrow(scan, f"id {kind}, text string, d1 long, d2 long, hits array<struct<mask:int,seed:long,here:int>>"))
    hits = suspects.select("d1", "d2", F.explode("hits").alias("h")).select("d1", "d2", "h.*").distinct()
    aligned = hits.join(wanted, ["mask", "seed"]).groupBy("d1", "d2", "p1", "p2").agg(F.collect_set(F.col("here") - F.col("there")).alias("shifts"))  # as many as two texts have words
    both = aligned.join(passages.select("p1", "p2", "item", "name", F.col("text").alias("passage")), ["p1", "p2"]).join(suspects.select("d1", "d2", "id", "text"), ["d1", "d2"]).select("id", "item", "name", "text", "passage", "shifts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (text, passage, shifts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                own, other = word_hashes([text])[0], word_hashes([passage])[0]
                for shift in shifts:
                    lo, hi = max(0, -shift), min(len(other), len(own) - shift)
                    if lo < hi:
                        rows.append((i, *_best(other[lo:hi] == own[lo + shift : hi + shift], substitutions)))
            if rows:
                at, *numbers = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1, 2)), *(pa.array(n, pa.int32()) for n in numbers)], ["id", "item", "passage", "exact_words", "overlap_words", "substitutions"])

    found = both.mapInArrow(compare, f"id {kind}, item {item_kind}, passage string, exact_words int, overlap_words int, substitutions int")
    return (
        found.groupBy("id", "item", "passage").agg(F.max("exact_words").alias("exact_words"), F.max(F.struct("overlap_words", (-F.col("substitutions")).alias("fewer"))).alias("best"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "passage", "exact_words", F.col("best.overlap_words").alias("overlap_words"), (-F.col("best.fewer")).alias("substitutions"))
    )

"""Long stretches of text that occur verbatim in several records.

A stretch of W characters contains W - W/2 + 1 windows of W/2 characters; the one with the least hash
is the stretch's *anchor*. Equal stretches have equal anchors, so one anchor stands for a run of about
W/4 stretches. The runs of all records are written once, without their text.

* First pass: every partition sketches how many owners have each anchor; the partitions' count-min
  sketches are summed, and can only overestimate. The sketch is cut by the range of the anchors into
  blocks of a fixed size, each of which is a row of a table, so that it grows with the input.
* Second pass: each run meets its anchor's block in a join. Only runs whose anchor is estimated to
  have two owners or more are grouped by it exactly, and only the text of those that really have is
  fetched from the records; there the stretches of length W are compared character by character.

No shared stretch is lost, since its anchor has at least two owners. Anchors of more than
``group_limit`` runs take another way: equal pieces of text become one row, aggregated before the
shuffle, and each stretch of a distinct piece is a key of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import spread, stored
from .rolling import U, code_points, in_steps, mixed, prefix_hash, stretch

#: Rows of the sketch, slots for each anchor in a row, and slots of a block (2**SLOT_BITS in each row).
ROWS, SLOTS, SLOT_BITS = 2, 8, 16
#: Blocks are summed by zones, of which a task holds one at a time: 2**ZONE_BITS blocks at most.
ZONE_BITS = 8
RUN = "anchor long, kind string, record long, owner long, start int, count int"
PIECE = "anchor long, heavy boolean, kind string, record long, owner long, start int, piece string"
SHARED = "kind string, record long, start int, end int"
#: Anchors that a task holds before it gives out their counts.
FLUSH = 2_000_000

_COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)", re.M)


def text_of(content: bytes | str | None) -> str | None:
    """A file's characters: UTF-8, else the encoding that it declares in its first lines, else Latin-1."""
    if content is None or isinstance(content, str):
        return content
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if m := _COOKIE.search(b"\n".join(content.split(b"\n", 2)[:2])):
        try:
            return content.decode(m[1].decode("ascii"))
        except (LookupError, UnicodeDecodeError):
            pass
    return content.decode("latin-1")


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` consecutive ones."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Runs:
    """Runs of stretches with one anchor: ``row`` of the text, ``start`` and number of stretches, ``anchor``."""

    def __init__(self, texts: list[str], kinds: np.ndarray, width: int) -> None:
        half = width // 2
        values = mixed(code_points("".join(texts)))
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        n = len(values) - width + 1
        at = np.arange(len(values) - half + 1)
        least = _least(stretch(prefix_hash(values), at, at + half), width - half + 1)
        row = row[:n]
        good = np.arange(n) + width <= ends[row]
        change = np.ones(n, bool)
        change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        first = np.flatnonzero(change & good)
        edges = np.flatnonzero(change | ~good)
        after = np.append(edges, n)[np.searchsorted(edges, first, side="right")]
        self.row, self.count = row[first], after - first
        self.start = first - (ends - sizes)[self.row]
        self.anchor = mixed(least[first] ^ kinds[self.row])


def _records(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list[str], np.ndarray, list[int], list[int], list[str]]]:
    """Steps of records that are long enough: texts, kind hashes, ids, owners, kinds."""
    kinds, ids, owners, contents = (c.to_pylist() for c in batch.columns)
    seeds = {k: int(mixed(np.array([int.from_bytes(k.encode()[:7], "little")]))[0]) for k in set(kinds)}
    rows = [(k, i, o, t) for k, i, o, c in zip(kinds, ids, owners, contents) if i is not None and o is not None and (t := text_of(c)) is not None and len(t) >= width]
    for a, b in in_steps([len(r[3]) for r in rows]):
        k, i, o, t = zip(*rows[a:b])
        yield list(t), np.array([seeds[x] for x in k], U), list(i), list(o), list(k)


def runs_of(records: DataFrame, width: int) -> DataFrame:
    """Every run of every record, without its text: (anchor, kind, record, owner, start, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, kinds, ids, owners, names in _records(batch, width):
                r = Runs(texts, kinds, width)
                pick = lambda values, kind: pa.array(np.array(values, kind)[r.row])
                yield pa.RecordBatch.from_arrays([pa.array(r.anchor.view(np.int64)), pa.array(names).take(pa.array(r.row)), pick(ids, np.int64), pick(owners, np.int64), pa.array(r.start.astype(np.int32)), pa.array(r.count.astype(np.int32))], ["anchor", "kind", "record", "owner", "start", "count"])

    return records.mapInArrow(run, RUN)


def block_of(anchor: Column, bits: int) -> Column:
    """The block of an anchor, of 2**bits: its uppermost bits."""
    return F.shiftrightunsigned(anchor, 64 - bits) if bits else F.lit(0).cast("long")


def sketch(runs: DataFrame, bits: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(block, words): for each of 2**bits blocks, a bit for each row and slot that counts two owners or more.

    The slot of an anchor is its lowest bits in the first row and the next ones in the second. Counts
    of all partitions are added, up to 255; blocks without such a slot have no row.
    """
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    zone_bits = max(min(bits, (4 * tasks - 1).bit_length()), bits - ZONE_BITS)
    size, mask = 1 << slot_bits, (1 << slot_bits) - 1
    inner = (1 << bits - zone_bits) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            anchors, owners = np.concatenate(held, axis=1)
            held.clear()
            _, one = np.unique(mixed(anchors ^ mixed(owners)), return_index=True)
            anchors = np.sort(anchors[one])
            blocks = (anchors >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchors), np.int64)
            zones, begin = np.unique(blocks >> bits - zone_bits, return_index=True)
            at = [((blocks & inner) << slot_bits | ((anchors >> U(r * slot_bits)).astype(np.int64) & mask)).astype("<u4") for r in range(ROWS)]
            rows = [np.split(a, begin[1:]) for a in at]
            yield pa.RecordBatch.from_arrays([pa.array(zones), *(pa.array([p.tobytes() for p in parts], pa.binary()) for parts in rows)], ["zone", *(f"row{r}" for r in range(ROWS))])

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)).view(U) for k in (0, 1)]))
            if sum(h.shape[1] for h in held) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, totals = None, np.zeros((ROWS, (inner + 1) * size), np.uint8)

        def out() -> pa.RecordBatch:
            words = np.packbits((totals > 1).reshape(ROWS, inner + 1, size).swapaxes(0, 1), axis=2, bitorder="little").reshape(inner + 1, -1).view("<i8")
            some = np.flatnonzero(words.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * words.shape[1]), pa.array(words[some].ravel()))
            return pa.RecordBatch.from_arrays([pa.array((zone << bits - zone_bits) + some), lists], ["block", "words"])

        for batch in batches:
            for z, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if z != zone:
                    if zone is not None:
                        yield out()
                    zone = z
                    totals[:] = 0
                for total, part in zip(totals, parts):
                    slots, n = np.unique(np.frombuffer(part, "<u4"), return_counts=True)
                    total[slots] = np.minimum(total[slots] + n, 255)
        if zone is not None:
            yield out()

    partial = runs.select("anchor", "owner").mapInArrow(count, "zone long, row0 binary, row1 binary")
    return partial.repartition("zone").sortWithinPartitions("zone").mapInArrow(merge, "block long, words array<long>")


def repeated(runs: DataFrame, sketched: DataFrame, bits: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The runs whose anchor is estimated to have two owners or more: a join with the sketch by block."""
    size = 1 << slot_bits
    hit = F.lit(True)
    for r in range(ROWS):
        slot = F.shiftrightunsigned("anchor", r * slot_bits).bitwiseAND(F.lit(size - 1)).cast("int")
        word = F.get("words", F.lit(r * size // 64) + F.shiftright(slot, 6))
        hit = hit & (F.call_function("getbit", word, slot.bitwiseAND(F.lit(63))) == 1)
    return runs.withColumn("block", block_of(F.col("anchor"), bits)).join(sketched, "block").where(hit).select(*runs.columns)


def _stretches(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each stretch of the texts, the number of its text and its place there."""
    values = mixed(code_points("".join(texts)))
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(texts)))[row]
    at = begin[row] + place
    return mixed(stretch(prefix_hash(values), at, at + width)), row, place


def _intervals(row: np.ndarray, place: np.ndarray, shared: np.ndarray, columns: list[list], width: int) -> pa.RecordBatch:
    """Joins neighbouring shared stretches."""
    row, place = row[shared], place[shared]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(row)) - 1 if len(row) else first
    rows = row[first].tolist()
    start = np.array(columns[2], np.int64)[row[first]] if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array([columns[0][r] for r in rows], pa.string()), pa.array([columns[1][r] for r in rows], pa.int64()), pa.array((start + place[first]).astype(np.int32)), pa.array((start + place[final] + width).astype(np.int32))], ["kind", "record", "start", "end"])


def _verbatim(pieces: list[str], row: np.ndarray, place: np.ndarray, like_row: np.ndarray, like_place: np.ndarray, width: int) -> bool:
    """Is every stretch the same text as the one it is like? Neighbouring stretches are compared together."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (like_row[1:] != like_row[:-1]) | (place[1:] != place[:-1] + 1) | (like_place[1:] != like_place[:-1] + 1)
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(row))[: len(first)] - 1
    return all(pieces[r][a : b + width] == pieces[s][c : c + b - a + width] for r, a, b, s, c in zip(row[first].tolist(), place[first].tolist(), place[final].tolist(), like_row[first].tolist(), like_place[first].tolist()))


def _compare(pieces: DataFrame, width: int) -> DataFrame:
    """(kind, record, start, end) of what pieces of one anchor share; whole groups of an anchor at a time."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a, b in _whole_groups(rows):
            anchor, kind, record, owner, start, piece = zip(*rows[a:b])
            h, row, place = _stretches(list(piece), width)
            h ^= mixed(np.array(anchor, np.int64).view(U))[row]
            while True:
                order = np.argsort(h, kind="stable")
                begin = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
                sizes = np.diff(np.append(begin, len(h)))
                who = np.array(owner, np.int64)[row[order]]
                several = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
                shared, like = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
                shared[order] = np.repeat(several, sizes)
                like[order] = np.repeat(order[begin], sizes)
                at = np.flatnonzero(shared)
                if _verbatim(list(piece), row[at], place[at], row[like[at]], place[like[at]], width):
                    break
                keys: dict[tuple[int, str], int] = {}  # two texts of one hash: group by the texts themselves
                h = np.array([keys.setdefault((anchor[r], piece[r][p : p + width]), len(keys)) for r, p in zip(row.tolist(), place.tolist())], U)
            yield _intervals(row, place, shared, [kind, record, start], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []
        for batch in batches:
            rows = left + list(zip(*(c.to_pylist() for c in batch.columns)))
            cut = len(rows)
            while cut and rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            left = rows[cut:]
            yield from solve(rows[:cut])
        yield from solve(left)

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SHARED)


def _classes(pieces: DataFrame, width: int) -> DataFrame:
    """(kind, record, start, end) of what pieces of anchors with many runs share.

    Equal pieces, by their anchor and 128 bits of hash, are one class, aggregated before the shuffle.
    A class of several owners is shared as a whole; for the others each stretch is a key.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for a, b in in_steps([len(r[5]) for r in rows]):
                h, row, place = _stretches([r[5] for r in rows[a:b]], width)
                pick = lambda k: pa.array(np.array([r[k] for r in rows[a:b]], np.int64)[row])
                yield pa.RecordBatch.from_arrays([pick(0), pick(1), pick(2), pick(3), pick(4), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32))], ["anchor", "a", "b", "least", "most", "stretch", "place"])

    same = ["anchor", "a", "b"]
    marked = pieces.select("anchor", "kind", "record", "owner", "start", F.char_length("piece").alias("n"), F.xxhash64("piece").alias("a"), F.xxhash64(F.lit("second"), "piece").alias("b"), "piece")
    classes = marked.groupBy(*same).agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.first("piece").alias("piece"))
    members = marked.select("kind", "record", "start", "n", *same)
    whole = members.join(classes.where("least != most").select(*same), same).select("kind", "record", "start", (F.col("start") + F.col("n")).alias("end"))
    stretches = classes.select(*same, "least", "most", "piece").mapInArrow(keys, "anchor long, a long, b long, least long, most long, stretch long, place int")
    several = stretches.groupBy("anchor", "stretch").agg(F.min("least").alias("x"), F.max("most").alias("y")).where("x != y").select("anchor", "stretch")
    hits = stretches.where("least = most").join(several, ["anchor", "stretch"], "left_semi").select(*same, "place")
    parts = members.join(hits, same).select("kind", "record", (F.col("start") + F.col("place")).alias("start"), (F.col("start") + F.col("place") + width).alias("end"))
    return whole.union(parts)


def shared_intervals(records: DataFrame, width: int = 200, group_limit: int = 200, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(kind, record, start, end): parts of records, each made of stretches of ``width`` characters
    that also occur in a record of the same kind with another owner.

    ``records``: kind STRING, record LONG, owner LONG, content STRING or BINARY. A record with a null
    id, owner or content and one shorter than ``width`` has none; a row that repeats another changes
    nothing; what only recurs within one owner isn't shared. The content is read twice: for the runs,
    and for the text of those that are repeated. The sketch has 2**``slot_bits`` slots in each row of a
    block and as many blocks as the runs need; none of it passes through the driver.
    """
    records = records.select("kind", F.col("record").cast("long"), F.col("owner").cast("long"), "content")
    runs = stored(runs_of(spread(records), width))
    blocks = SLOTS * runs.count() / (1 << slot_bits)
    bits = max(0, int(np.ceil(np.log2(max(blocks, 1)))))
    likely = stored(repeated(runs, sketch(runs, bits, slot_bits), bits, slot_bits))
    groups = likely.groupBy("anchor").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), (F.count("*") > group_limit).alias("heavy")).where("least != most").select("anchor", "heavy")
    wanted = likely.join(groups, "anchor").groupBy("kind", "record", "owner").agg(F.collect_set(F.struct("anchor", "heavy", "start", "count")).alias("runs"))  # as many as the record's text has

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for kind, record, owner, content, runs in zip(*(c.to_pylist() for c in batch.columns)):
                text = text_of(content)
                rows += [(r["anchor"], r["heavy"], kind, record, owner, r["start"], text[r["start"] : r["start"] + r["count"] + width - 1]) for r in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["anchor", "heavy", "kind", "record", "owner", "start", "piece"])

    pieces = stored(records.where("content is not null").join(wanted, ["kind", "record", "owner"]).select("kind", "record", "owner", "content", "runs").mapInArrow(cut, PIECE))
    few, many = (pieces.where(F.col("heavy") == heavy).drop("heavy") for heavy in (False, True))
    return _compare(few, width).union(_classes(many, width))


def _whole_groups(rows: list[tuple], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole anchor groups of about ``most`` characters."""
    at, size = 0, 0
    for i, r in enumerate(rows):
        if size > most and r[0] != rows[i - 1][0]:
            yield at, i
            at, size = i, 0
        size += len(r[5])
    if at < len(rows):
        yield at, len(rows)


def shared_characters(intervals: DataFrame) -> DataFrame:
    """(kind, record, shared_chars): how many characters of a record its intervals cover together."""
    w = Window.partitionBy("kind", "record").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(w), F.lit(0))
    return intervals.distinct().withColumn("fresh", F.greatest(F.col("end") - F.greatest(F.col("start"), reached), F.lit(0))).groupBy("kind", "record").agg(F.sum("fresh").alias("shared_chars"))


def characters(records: DataFrame) -> DataFrame:
    """(kind, record, n_chars): the length of each row's text; what isn't UTF-8 is decoded as the stretches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(text_of(c)) for c in batch.column(2).to_pylist()], pa.int32())], ["kind", "record", "n_chars"])

    content = F.col("content").cast("binary")
    valid = F.is_valid_utf8(content.cast("string"))
    plain = records.where("content is null").select("kind", "record", F.lit(None).cast("int").alias("n_chars")).union(records.where(valid).select("kind", "record", F.char_length(content.cast("string"))))
    return plain.union(records.where(~valid).select("kind", "record", content.alias("content")).mapInArrow(run, "kind string, record long, n_chars int"))

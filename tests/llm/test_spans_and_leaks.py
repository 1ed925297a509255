"""Shared spans and evaluation leaks against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeweave.llm.eval_leaks import MASKS, find_leaks
from lodeweave.llm.shared_spans import shared_characters, shared_intervals, text_of

RECORD = "kind string, record long, owner long, content string"


def brute(rows, width):
    """(kind, record) -> number of characters in stretches that another owner of the kind has too."""
    owners = {}
    for kind, record, owner, text in rows:
        if text is not None and record is not None and owner is not None:
            for i in range(len(text) - width + 1):
                owners.setdefault((kind, text[i : i + width]), set()).add(owner)
    out = {}
    for kind, record, owner, text in rows:
        if text is None or record is None or owner is None:
            continue
        hit = set()
        for i in range(len(text) - width + 1):
            if len(owners[kind, text[i : i + width]]) > 1:
                hit.update(range(i, i + width))
        if hit:
            out[kind, record] = len(hit)
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(20, 160)))
    shared = [word() for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(r.choice([word(), r.choice(shared)]) for _ in range(r.randint(1, 5)))
        rows.append((r.choice(["file", "symbol"]), i, r.randint(0, 20), text))
    return [*rows, rows[0], rows[1], ("file", 500, None, rows[2][3]), ("file", None, 7, rows[2][3]), ("file", 501, 3, None), ("file", 502, 3, ""), ("file", 503, 3, "short"), ("file", 504, 99, rows[3][3][:40])]


@pytest.mark.parametrize(("width", "limit", "bits"), [(40, 200, 16), (41, 1, 16), (40, 200, 6), (41, 1, 6)])
def test_same_as_brute_force(spark, width, limit, bits):
    rows = texts(width + limit)
    df = spark.createDataFrame(rows, RECORD).withColumn("start", F.lit(1)).withColumn("anchor", F.lit("x"))
    got = shared_characters(shared_intervals(df, width, group_limit=limit, slot_bits=bits))
    assert {(r.kind, r.record): r.shared_chars for r in got.collect()} == brute(rows, width)


def test_boundaries_of_a_stretch(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij") for _ in range(60))
    rows = [("file", 1, 1, "x" * 30 + base[:40] + "y" * 9), ("file", 2, 2, "z" * 7 + base[:40]), ("file", 3, 3, base[:39]), ("file", 4, 1, base[:40])]
    got = {x.record for x in shared_intervals(spark.createDataFrame(rows, RECORD), 40).collect()}
    assert got == {1, 2, 4}


def test_hot_stretch_and_long_text(spark):
    hot = "".join(chr(97 + i * i % 23) for i in range(50))
    rows = [("file", i, i, hot + f" own text of {i}") for i in range(300)] + [("file", 1000, 1000, "ab" * 300_000), ("file", 1001, 1001, "ba" * 30)]
    got = {r.record: r.shared_chars for r in shared_characters(shared_intervals(spark.createDataFrame(rows, RECORD), 40, group_limit=20)).collect()}
    assert set(range(300)) <= set(got)
    assert got[1000] == 600_000
    assert got[1001] == 60


def test_no_rows(spark):
    assert shared_intervals(spark.createDataFrame([], RECORD)).count() == 0


def test_encodings():
    assert text_of("é".encode()) == "é"
    assert text_of(b"# -*- coding: latin-1 -*-\n\xe9") == "# -*- coding: latin-1 -*-\né"
    assert text_of(b"\xe9") == "é"
    assert text_of(None) is None


def words(text):
    return [w.casefold() for w in re.findall(r"[^\W_]+", text or "")]


def test_leaks_same_as_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "été", "Ошибка"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randint(5, 40)), r.choice([None, "", say(25)])) for i in range(20)]
    docs = [(1000, None), (1001, ""), (1002, "   "), (1003, say(5000))]
    for i in range(80):
        item = r.choice(items)
        part = (r.choice(item[1:]) or "").split()
        a = r.randint(0, max(0, len(part) - 11))
        piece = part[a : a + r.randint(8, 16)]
        piece = [w.upper() if r.random() < 0.3 else w for w in piece]
        docs.append((i, say(r.randint(0, 30)) + " " + r.choice([" ", "_", " -- ", "\n"]).join(piece) + " " + say(5)))
    docs.append(docs[-1])
    want = set()
    for doc, text in docs:
        own = words(text)
        grams = {tuple(own[k : k + 12]) for k in range(len(own) - 11)}
        for item, *passages in items:
            for p in passages:
                w = words(p)
                if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                    want.add((doc, item))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")), spark.createDataFrame(items, "item_id long, question string, answer string"))
    assert {(x.doc_id, x.item_id) for x in got.where("exact_words >= 12").collect()} == want
    assert want


def test_leaks_tolerate_substitutions(spark):
    item = [f"word{i}" for i in range(30)]
    changed = item[5:25]
    changed[7] = "other"
    changed[14] = "else"
    docs = spark.createDataFrame([(1, "and " + " ".join(changed) + " so"), (2, " ".join(item[:11]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item), None)], "item_id long, question string, answer string")
    (row,) = find_leaks(docs, items).where("overlap_words >= 12").collect()
    assert (row.doc_id, row.item_id, row.passage, row.exact_words, row.overlap_words, row.substitutions) == (1, 7, "question", 7, 20, 2)


def test_masks_meet_any_two_substitutions():
    for pair in itertools.combinations(range(12), 2):
        assert any(len(m) == 12 and all(m[k] == "0" for k in pair) for m in MASKS)


def test_leaks_with_two_substitutions_anywhere(spark):
    item = [f"word{i}" for i in range(20)]
    docs, want = [], {}
    for n in range(12, 18):
        for pair in itertools.combinations(range(1, n - 1), 2):
            piece = [f"other{i}" if i in pair else w for i, w in enumerate(item[:n])]
            want[len(docs)] = (n, 2)
            docs.append((len(docs), "and " + " ".join(piece) + " so"))
    items = spark.createDataFrame([(7, " ".join(item), None)], "item_id long, question string, answer string")
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).where("overlap_words >= 12").collect()
    assert {r.doc_id: (r.overlap_words, r.substitutions) for r in got} == want


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 20, None)], "item_id long, question string, answer string")
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0

"""Token encoding against the public library, and restoring of texts garbled here."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm.garbled_text import Restorer, learn, restore_texts
from lodeweave.llm.token_encoding import encode_corpus
from lodeweave.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
def test_same_as_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(MODEL)
    library.encode_special_tokens = True
    r = random.Random(1)
    alphabet = list("abcdeftinghos  '.,\n\t_0123456789ABCéüßяж日本語한글🙂\u00a0\u2003\u200b\x1c\x85") + ["'s", " the", "ing", "  ", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += [None, "", " ", "\n\n", "<|endoftext|>", "a" * 20_000, "日本" * 5_000, " " * 3_000, "it's we'LL", "x \n y", "-" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df, MODEL, rows=100).collect()
    want = {i: e.ids for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert len(got) == len(rows)
    assert all(list(r.ids) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert encode_corpus(df.limit(0), MODEL).count() == 0


PROSE = {
    "de": "Die Prüfung läuft täglich über größere Mengen. Für schöne Grüße müssen wir künftig Bäume zählen. Es könnte möglich sein, dass die Änderung später überschrieben wird.",
    "fr": "La tâche était déjà terminée à côté. L’équipe a vérifié le résumé généré après coup. Où est passée la bibliothèque créée là-bas ? Ça ne marche pas très bien.",
    "es": "La función está aquí según el informe. Mañana añadirá la sección pequeña del código. ¿Cuándo quedó obsoleta la petición? El índice también falló.",
    "pt": "A solução não está disponível na página da função. Você já viu a execução que também é média? São ações e opções até amanhã.",
    "ru": "Проверьте, что функция не закрывает граф. После слияния отчёт стал больше на несколько строк. Почему индекс поздно обновляется?",
    "pl": "Gałąź została usunięta, ponieważ węzeł źródłowy był pusty. Proszę sprawdzić zależności i dołączyć łańcuch. Później pamięć wróci.",
}


@pytest.fixture(scope="module")
def restorer():
    dictionaries, pairs = {}, set()
    for lang, text in PROSE.items():
        lines = [s.strip() + "." for s in text.split(".") if s.strip()]
        dictionaries[lang], common = learn(["\n".join(lines)] * 4)
        pairs |= common
    return Restorer(dictionaries, pairs)


@pytest.mark.parametrize(
    ("lang", "written", "read"),
    [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "mac_roman"), ("pt", "utf-8", "cp437"), ("ru", "utf-8", "cp1251"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1251", "latin-1"), ("de", "mac_roman", "cp1252"), ("pl", "cp1250", "cp1252"), ("pl", "utf-8", "cp1250")],
)
def test_round_trip(restorer, lang, written, read):
    for sentence in PROSE[lang].split(". "):
        try:
            garbled = sentence.encode(written).decode(read)
        except UnicodeError:
            continue
        if garbled != sentence:
            assert restorer.restore("Plain first line.\n" + garbled)[0] == "Plain first line.\n" + sentence


def test_double_and_partial(restorer):
    twice = "Die Prüfung läuft über größere Mengen.".encode().decode("cp1252").encode().decode("cp1252")
    text, used = restorer.restore(f"{PROSE['fr']}\n{twice}")
    assert text == f"{PROSE['fr']}\nDie Prüfung läuft über größere Mengen."
    assert used == ["utf_8<cp1252+utf_8<cp1252"]


@pytest.mark.parametrize("text", [*PROSE.values(), 'The export writes "GrÃ¶ÃŸe" here.', "input `seÃ±al` fails", "SÃO REGRAS DE EXCEÇÃO", "Γειά σου Κόσμε", "नमस्ते दुनिया", "plain", "", "→ ✅ 👍 — “so” it’s 5 µs", "a\u200bb\u2028c\xa0d"])
def test_left_alone(restorer, text):
    assert restorer.restore(text) == (text, [])


def test_lost(restorer):
    assert restorer.restore("A solu��o est� na p�gina.")[1] == ["lost"]


def test_whole_operator(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate([*PROSE.items()] * 6)]
    rows += [(100, PROSE["de"].encode().decode("cp1252"), "de"), (101, None, None), (102, "", ""), (103, "  ", "en"), (104, PROSE["ru"].encode("koi8_r").decode("cp1251"), None), (105, "é" * 100_000, "fr"), (100, PROSE["de"].encode().decode("cp1252"), "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("chains", F.lit(1))
    got = {r.doc_id: r for r in restore_texts(df).collect()}
    assert set(got) == {100, 104}
    assert got[100].restored == PROSE["de"]
    assert got[104].restored == PROSE["ru"]
    assert restore_texts(df.limit(0)).count() == 0


def test_mixed_chains(restorer):
    once = PROSE["de"].split(". ")[0].encode("mac_roman").decode("cp1252", "replace")
    twice = once.encode("utf-8").decode("cp1252", "replace")
    assert twice != once
    text, used = restorer.restore(twice)
    assert used
    assert text == PROSE["de"].split(". ")[0]


@pytest.mark.parametrize("text", ["ПОЧЕМУ ИНДЕКС ПОЗДНО ОБНОВЛЯЕТСЯ?", "почему модуль всё ещё зависит от графа", "①thread 🏳️‍🌈layer 𝔘𝔫𝔦index ½plan ক্ষrelay échain"])
def test_upper_case_and_rare_letters_stay(restorer, text):
    assert restorer.restore(text) == (text, [])


def test_dictionaries_hold_the_whole_corpus(spark, monkeypatch):
    """As ``learn`` of all texts of a language: more than a few hundred of them, and a long one."""
    from lodeweave.llm import garbled_text

    r = random.Random(2)
    words = {lang: [w for w in text.split() if not w.isascii()] for lang, text in PROSE.items()}
    texts = {lang: ["\n".join(" ".join(r.choices(words[lang], k=r.randint(1, 3))) + f" plain ä{r.randint(0, 300)}" for _ in range(3)) for _ in range(900)] + ["plain", ""] for lang in ("de", "pl")}
    texts["de"] += ["Änderung GrÃ¶ÃŸe\nl�st", "„zitierte Wörter“ außen"]
    texts["fr"] = ["long " * 30_000 + PROSE["fr"]]
    learnt = []
    train = garbled_text.train
    monkeypatch.setattr(garbled_text, "train", lambda *a: learnt.append(train(*a)) or learnt[-1])
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    restore_texts(spark.createDataFrame([*rows, (-1, None, "de"), (-2, "Größe", None), (-3, "größer", "und")], "doc_id long, text string, lang string"))
    want = {lang: learn(ts) for lang, ts in texts.items()}
    assert learnt == [({lang: body for lang, (body, _) in want.items()}, want["de"][1] | want["pl"][1])]
    assert "côté".encode() in learnt[0][0]["fr"]


def test_first_lines_of_each_language_fill_a_dictionary():
    import pyarrow as pa

    from lodeweave.llm.garbled_text import DICTIONARY_BYTES, _first_lines

    line = "é" * (DICTIONARY_BYTES // 8)  # a third doesn't fit with its end of line
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"lang": k, "n": 1, "line": x} for k, x in rows], pa.schema([("lang", pa.string()), ("n", pa.int64()), ("line", pa.string())]))
    batches = [batch(("de", line), ("de", line)), batch(("de", line), ("de", line), ("de", "ä"), ("fr", line)), batch(), batch(("fr", "ô"), ("pl", line * 5), ("pl", "ż"))]
    got = [(r["lang"], len(r["line"])) for b in _first_lines(iter(batches)) for r in b.to_pylist()]
    assert got == [("de", len(line))] * 3 + [("fr", len(line)), ("fr", 1)]


def test_costs_of_a_core_are_those_of_its_words(restorer):
    """Against whole words by definition: every chain's reading, its oddities and its uncommon pairs; words of one core are priced once."""
    from lodeweave.llm import garbled_text as g

    by_definition = lambda w: g.ODDITY_COST * g._oddities(w) + g.UNSEEN_COST * len(g._pairs(w) - restorer.known)
    r = random.Random(3)
    letters = "abcXYZ'.:^07\x7f\\~äöüßçÃ©¼Σςσİıµºª²½ñŁłą—’“\xa0\xad\x85́жЯРќ日本語한글・ⅠΩ🙂ﬁ　´¨"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(3_000)]
    words += [garbled for text in PROSE.values() for written, read in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252")) for garbled in text.encode(written, "ignore").decode(read, "ignore").split()]
    words = [w for w in words if not w.isascii()]
    for word in words:
        before, number, after = restorer.word(word)
        made = dict(g.readings(word))
        assert restorer.extra(word) == by_definition(word)
        assert {k: before + text + after for k, text in restorer.readings[number].items()} == {k: text for k, text in made.items() if text is not None}
        for k, chain in enumerate(g.CHAINS):
            more = 0
            if k in made:
                more = g.ODDITY_COST if made[k] is None else g.CHANGED + by_definition(made[k]) - by_definition(word)
                if made[k] is not None and chain[0][0] == "utf_8":
                    more += g.ODDITY_COST * sum(c in word and c.isalpha() for c in made[k] if c >= "\x80")
            assert restorer.more[number, k] == more
    fresh = Restorer({"de": learn([PROSE["de"]] * 4)[0]}, restorer.known)
    fresh.restore("\n".join(f"{before}größer{after}" for before in ("", "ver", "nach") for after in ("", "n", "nd", "t")))
    assert (len(fresh.words), len(fresh.cores)) == (12, 1)


def test_one_dictionary_for_a_line_that_no_reading_can_beat(restorer):
    """Under the dictionary of its words; the least size is looked for only if a reading is shorter than that."""

    class Counting:
        calls = 0

        def __init__(self, made):
            self.made = made

        def compress(self, raw):
            Counting.calls += 1
            return self.made.compress(raw)

    counting = Restorer({}, restorer.known)
    counting.compressors = {script: [Counting(c) for c in made] for script, made in restorer.compressors.items()}
    counting.homes, counting.votes = restorer.homes, restorer.votes.copy()
    short = ["It’s", "schön", "Garde-à-vous"]
    assert [counting.restore(line) for line in short] == [(line, []) for line in short]
    assert Counting.calls == len(short)
    lines = [*short, PROSE["fr"], PROSE["pl"], *PROSE["de"].split(". ")]
    each = [restorer.lengths(lines, [k] * len(lines)) for k in range(len(restorer.compressors["latin"]))]
    assert (np.min(each, axis=0) == restorer.lengths(lines)).all()
    garbled = [line.encode().decode("cp1252") for line in PROSE["de"].split(". ")]
    assert [counting.restore(line)[0] for line in garbled] == PROSE["de"].split(". ")

"""Text that was decoded with the wrong character encoding, found and restored by description length.

A *chain* undoes wrong decodings: the text is encoded with the encoding it was read with and decoded
with the one it was written in. For the words of a line that are not plain ASCII, every chain gives a
candidate; each candidate is compressed with a zstandard dictionary of every language of its script,
and the one with the least bytes, the cost of its chain included, is taken. Only a candidate whose costs
and the least size of a compressed text together are already too long is not compressed: it can't win.
If none is shorter than the text as it stands, the text stays as it is; else what was found is looked at
again, so that chains may mix. Dictionaries hold the lines whose words are most common in the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import stored

#: The size of a language's dictionary, and the part of its texts that a common pair of characters stands in.
DICTIONARY_BYTES, COMMON = 32_768, 0.015
#: Lines that are decided together.
LINES = 1_000
#: Decisions, and counts, that a task keeps.
MEMO = 200_000

# The encodings and the confusions of them that are considered.
_UTF8_READ_AS = ("cp1252", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2")
_PAIRS = (  # written in, read as
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1254", "cp1252"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"),
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("gbk", "cp1252"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("cp949", "cp1252"), ("big5", "cp1252"),
)
_WIDE_PAIRS = (("utf_8", "gbk"), ("utf_8", "shift_jis"), ("utf_8", "cp949"), ("utf_8", "big5"), ("shift_jis", "gbk"), ("gbk", "shift_jis"), ("cp949", "gbk"), ("gbk", "cp949"), ("big5", "gbk"), ("gbk", "big5"), ("euc_jp", "gbk"))
#: Bytes that a chain costs: a step of UTF-8, which few texts allow by chance, and another.
UTF8_COST, OTHER_COST = 2, 6
#: Bytes that an oddity and a pair of characters that is not common cost, above what zstandard counts.
ODDITY_COST, UNSEEN_COST = 4, 2
LOST = "�"
#: A compressed frame has a magic number, a descriptor, a window and the head of a block, and a byte at least. In a block that
#: isn't one repeated byte stand the text as it is or two heads, the modes and the states of three codes, 18 bits at least.
FRAME = 4 + 1 + 1 + 3
LEAST_FRAME, LEAST_CODED = FRAME + 1, FRAME + 3 + 3
#: What counts the changed words of a line, in one number with their costs.
CHANGED = 1 << 40
#: Times that a restored line is looked at again.
MOST_STEPS = 3

_SEQUENCES = "[{}][{}]|[{}][{}]{{2}}|[{}][{}]{{3}}"
_QUOTED = re.compile("\"[^\"\n]{1,60}\"|`[^`\n]{1,60}`|“[^”\n]{1,60}”|«[^»\n]{1,60}»|„[^“”\n]{1,60}[“”]|‘[^’\n]{1,60}’|「[^」\n]{1,60}」|『[^』\n]{1,60}』|(?<!\\w)'[^'\n]{1,60}'(?!\\w)")

_MARK = re.compile("[\"`“«„‘「『']")
#: What a word's costs depend on: from its first character that is not ASCII to its last, with the letter before (it is cased, so that
#: lower case doesn't depend on what stands before it) and the two letters after (a wide encoding may take the first for a trail byte).
_CORE = re.compile("[A-Za-z]?[^\x00-\x7f](?:.*[^\x00-\x7f])?(?:[A-Za-z]{2})?", re.DOTALL)


def _table(codec: str) -> dict[int, int | str]:
    """Maps a character to the Latin-1 character of its byte in the encoding; undefined bytes stand for themselves."""
    out: dict[int, int | str] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(ord(bytes([b]).decode(codec)), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(b, b)
    return out | {c: c for c in range(0x80)}


class _ByteOf(dict):
    """A table for ``str.translate`` that gives U+FFFF for what an encoding lacks."""

    def __missing__(self, c: int) -> int:
        return 0xFFFF

    def sequences(self) -> re.Pattern:
        """What UTF-8 sequences look like if read with the encoding."""
        chars = lambda low, high: "".join(re.escape(chr(c)) for c, b in self.items() if low <= b < high)
        rest = chars(0x80, 0xC0)
        return re.compile(_SEQUENCES.format(chars(0xC2, 0xE0), rest, chars(0xE0, 0xF0), rest, chars(0xF0, 0xF5), rest))


_BYTES = {c: _ByteOf(_table(c)) for c in {*_UTF8_READ_AS, *(w for _, w in _PAIRS)}}
#: A garbled text that was put into lower case afterwards: its lead bytes are taken for capitals.
_RAISED = _ByteOf({**_table("cp1252"), **{b: b - 0x20 for b in range(0xE2, 0xE5)}, 0xF0: 0xD0})
_BYTES["cp1252 lower"] = _RAISED
_LIKE_UTF8 = {c: _BYTES[c].sequences() for c in (*_UTF8_READ_AS, "cp1252 lower")}
#: How a UTF-8 sequence begins if read with one of the encodings.
_LIKE_ANY = re.compile("".join("[" + "".join(re.escape(chr(c)) for r in _LIKE_UTF8 for c, b in _BYTES[r].items() if low <= b < high) + "]" for low, high in ((0xC2, 0xF5), (0x80, 0xC0))))


@lru_cache(65_536)
def _decoded(sequence: str, read_as: str) -> str:
    """What a sequence of UTF-8 means that was read with another encoding; itself if nothing."""
    try:
        return sequence.translate(_BYTES[read_as]).encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return sequence


def _utf8_step(word: str, read_as: str) -> str:
    """Decodes the UTF-8 sequences in a word that was read with another encoding; the rest stays."""
    return _LIKE_UTF8[read_as].sub(lambda m: _decoded(m[0], read_as), word)


def _bytes_of(word: str, read_as: str) -> bytes | None:
    """The bytes that a word was read from; None if the encoding lacks one of its characters."""
    try:
        if read_as in _BYTES:
            return word.translate(_BYTES[read_as]).encode("latin-1")
        return word.encode(read_as)
    except UnicodeEncodeError:
        return None


def _pair_step(word: str, written: str, read_as: str) -> str | None:
    try:
        return raw.decode(written) if (raw := _bytes_of(word, read_as)) is not None else None
    except UnicodeDecodeError:
        return None


Chain = tuple[tuple[str, str], ...]


def undo(word: str, chain: Chain) -> str:
    for written, read_as in chain:
        if written == "utf_8" and read_as in _BYTES:
            word = _utf8_step(word, read_as)
        elif (got := _pair_step(word, written, read_as)) is not None:
            word = got
    return word


def _repeat(written: str, read_as: str, n: int) -> Chain:
    return ((written, read_as),) * n


#: Every chain that is tried at a time, and its cost.
CHAINS: dict[Chain, int] = {
    **{_repeat("utf_8", r, n): UTF8_COST * n + (2 if r.endswith("lower") else 0) for r in (*_UTF8_READ_AS, "cp1252 lower") for n in (1, 2, 3)},
    **{_repeat(w, r, 1): OTHER_COST for w, r in (*_PAIRS, *_WIDE_PAIRS)},
}


_NUMBER = {chain: k for k, chain in enumerate(CHAINS)}
_LIST, _COSTS = list(CHAINS), np.array(list(CHAINS.values()))
_FROM_UTF8 = frozenset(k for k, chain in enumerate(CHAINS) if chain[0][0] == "utf_8")


_UTF8 = {read_as: [_NUMBER[_repeat("utf_8", read_as, n)] for n in (1, 2, 3)] for read_as in _LIKE_UTF8}
_NARROW, _WIDE = ([(_NUMBER[pair,], *pair) for pair in pairs] for pairs in (_PAIRS, _WIDE_PAIRS))


def readings(word: str) -> Iterator[tuple[int, str | None]]:
    """The number of every chain that changes a word, and what it gives; nothing for one that the word can't have gone through."""
    for read_as, numbers in _UTF8.items() if _LIKE_ANY.search(word) else ():
        now = word
        for k in numbers:
            after = _utf8_step(now, read_as)
            if after == now:
                break
            now = after
            yield k, now
    raw: dict[str, bytes | None] = {}
    for k, written, read_as in _NARROW if max(word) < "\u3000" else _WIDE:
        if read_as not in raw:
            raw[read_as] = _bytes_of(word, read_as)
        if (read := raw[read_as]) is None:
            after = None
        else:
            try:
                after = read.decode(written)
            except UnicodeDecodeError:
                after = None
        if after != word and (after or LOST not in word):
            yield k, after or None


_SCRIPTS = {"ru": "cyrillic", "uk": "cyrillic", "ko": "hangul", "ja": "han", "zh": "han"}


#: Letters of one script in a row: Latin, Cyrillic, Hangul, Han with Kana, others.
_RANGES = ("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\u0400-\u052f", "\uac00-\ud7af", "\u3005-\u3007\u3040-\u9fff")
_LETTERS = re.compile("|".join(f"([{r}]+)" for r in (*_RANGES, "^\\W\\d_" + "".join(_RANGES))))
_NOT_ASCII = re.compile(_LETTERS.pattern.replace("A-Za-z\xaa", "\xaa", 1))
_NOT_LATIN = re.compile("[" + "".join(_RANGES[1:]) + "]|[^\\W\\d_" + "".join(_RANGES) + "]")
#: What a text that isn't Latin has one of; quicker to look for.
_PERHAPS = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if _NOT_LATIN.match(c)) + "\u0250-\U0010ffff]")
_HAN = re.compile(f"[{_RANGES[3]}]+")
_NAMES = ("", "latin", "cyrillic", "hangul", "han", "other")
_CONTROL = re.compile("[\x7f-\x9f\ue000-\uf8ff]")


def _script(text: str) -> str:
    """The script of most letters that are not ASCII."""
    if not (_PERHAPS.search(text) and _NOT_LATIN.search(text)):
        return "latin"
    text = text.replace(" ", "")
    if 2 * len(_HAN.sub("", text)) < len(text):  # most characters
        return "han"
    seen = [0] * len(_NAMES)
    for m in _NOT_ASCII.finditer(text):
        i, j = m.span()
        seen[m.lastindex] += j - i
    return max(zip(seen, _NAMES))[1]


def _oddities(text: str) -> int:
    """Control and private characters, and letters of two scripts side by side."""
    odd = len(_CONTROL.findall(text))
    if max(text) >= "\u0250":
        end = -1
        for m in _LETTERS.finditer(text):
            odd += m.start() == end
            end = m.end()
    return odd


_ALIKE = {0xA0: " ", **dict.fromkeys(map(ord, "123456789"), "0")}


def _pairs(word: str) -> set[str]:
    """The pairs of neighbouring characters, one of them not ASCII, in lower case; all digits count as one."""
    marked = f" {word.lower().translate(_ALIKE)} "
    return {a + b for a, b in zip(marked, marked[1:]) if a >= "\x80" or b >= "\x80"}


@lru_cache(65_536)
def _character(c: str) -> tuple[int, bool, str]:
    """A letter's script, else 0; whether a character is odd; and what it is in pairs."""
    return (m.lastindex if (m := _LETTERS.match(c)) else 0), _CONTROL.match(c) is not None, c.lower().translate(_ALIKE)


class _Neighbours(dict):
    """Of two neighbouring characters: if the second is odd, if they are letters of two scripts, and their pairs that are not common; None if nothing of it."""

    def __init__(self, known: set[str]) -> None:
        self.known = known

    def __missing__(self, two: tuple[str, str]) -> tuple[bool, bool, tuple[str, ...]] | None:
        (a, _, before), (b, odd, now) = map(_character, two)
        sides = a != b and a * b > 0
        unseen = tuple([p for p in map(add, before[-1] + now, now) if not p.isascii() and p not in self.known])
        found = self[two] = (odd, sides, unseen) if odd or sides or unseen else None
        return found


def _least_size(text: str) -> int:
    """Less than this no text of its kind is when compressed."""
    if text.count(text[0]) == len(text):
        return LEAST_FRAME
    return LEAST_CODED if len(text) >= LEAST_CODED - FRAME else FRAME + len(text)


def _core(word: str) -> tuple[str, str, str]:
    """A word that is not ASCII in three: its core, and what stands before and after it, which no chain changes and no cost counts."""
    i, j = _CORE.search(word).span()
    i = i if word[i].isascii() else 0
    j = j if word[j - 1].isascii() else len(word)
    return ("", word, "") if "\x7f" in word else (word[:i], word[i:j], word[j:])


class Restorer:
    """Decides lines by description length under the languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], pairs: set[str]) -> None:
        made = {lang: zstandard.ZstdCompressionDict(d) for lang, d in dictionaries.items()}
        for d in made.values():
            d.precompute_compress(level=3)
        parameters = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False)
        self.compressors: dict[str, list] = {}
        self.homes: dict[str, list[int]] = {}
        for lang, d in made.items():
            compressors = self.compressors.setdefault(_SCRIPTS.get(lang, "latin"), [])
            for word in dictionaries[lang].decode("utf-8", "surrogatepass").split():
                self.homes.setdefault(word, []).append(len(compressors))
            compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))
        self.plain = [zstandard.ZstdCompressor(level=3, write_content_size=False)]
        self.known = pairs
        self.neighbours = _Neighbours(pairs)
        self.memo: dict[tuple[str, ...], Chain] = {}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.cores: dict[str, int] = {}
        self.readings: list[dict[int, str]] = []
        self.more = np.zeros((1_000, len(_LIST)), np.int64)
        self.votes = np.zeros((1_000, max(map(len, [*self.compressors.values(), self.plain]))), np.int64)

    def lengths(self, texts: list[str], only: list[int] | None = None) -> np.ndarray:
        """The least sizes of texts under the dictionaries of their scripts, a dictionary at a time, so that it stays in the CPU's cache.

        With ``only``, each text's size under the dictionary of that number alone.
        """
        out, of = np.full(len(texts), CHANGED), {}
        for i, text in enumerate(texts):
            of.setdefault(_script(text), []).append(i)
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        for script, at in of.items():
            compressors = self.compressors.get(script, self.plain)
            for k, made in enumerate(compressors):
                if some := at if only is None else [i for i in at if only[i] % len(compressors) == k]:
                    out[some] = np.minimum(out[some], np.fromiter(map(len, map(made.compress, [raw[i] for i in some])), np.int64, len(some)))
        return out

    def extra(self, word: str) -> int:
        """What a word costs above its compressed size: oddities, and pairs of characters that are not common."""
        if "Σ" in word:  # in lower case it depends on more than its neighbours
            return ODDITY_COST * _oddities(word) + UNSEEN_COST * len(_pairs(word) - self.known)
        if not (found := list(filter(None, map(self.neighbours.__getitem__, zip(" " + word, word + " "))))):
            return 0
        odd, sides, unseen = zip(*found)
        return ODDITY_COST * (sum(odd) + (sum(sides) if True in sides and max(word) >= "\u0250" else 0)) + UNSEEN_COST * len(set().union(*unseen))

    def word(self, word: str) -> tuple[str, int, str]:
        """A word as what stands before its core, the core's number, and what stands after it."""
        before, core, after = _core(word)
        if (number := self.cores.get(core)) is None:
            number = self._add(core)
        for k in self.homes.get(word, ()):
            self.votes[number, k] += 1
        found = self.words[word] = before, number, after
        return found

    def _add(self, core: str) -> int:
        """Numbers a core; puts into ``more``, by chain, what it costs more with it, and ``CHANGED`` if it changes; keeps its readings."""
        number = self.cores[core] = len(self.cores)
        if number == len(self.more):
            self.more = np.concatenate([self.more, np.zeros_like(self.more)])
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        self.votes[number] = 0
        own = self.extra(core)
        made: dict[str, int] = {}
        more, texts = [0] * len(_LIST), {}
        letters: set[str] | None = None
        for k, text in readings(core):
            if text is None:  # all words of a line were misread, or none
                more[k] = ODDITY_COST
                continue
            if text not in made:
                made[text] = self.extra(text) - own
            texts[k], more[k] = text, made[text] + CHANGED
            if k in _FROM_UTF8:  # and all letters of a word
                if letters is None:
                    letters = {c for c in core if c >= "\x80" and c.isalpha()}
                more[k] += ODDITY_COST * sum(map(letters.__contains__, text))
        self.more[number] = more
        self.readings.append(texts)
        return number

    def decide(self, lines: Iterable[tuple[str, ...]]) -> None:
        """Puts into ``memo`` for the words of each line the chain with the least description; none if they are best as they stand."""
        new = [words for words in dict.fromkeys(lines) if words not in self.memo]
        for i in range(0, len(new), LINES):
            part = new[i : i + LINES]
            found = dict(zip(part, self._steps(part)))
            after = {words: tuple(sorted(undo(w, chain) for w in words)) for words, chain in found.items() if chain and len(chain) < MOST_STEPS}
            if after:
                self.decide(after.values())
            self.memo.update({words: (*chain, *self.memo[after[words]]) if words in after else chain for words, chain in found.items()})

    def _steps(self, lines: list[tuple[str, ...]]) -> list[Chain]:
        """For each line the first links of its chain. What the words cost as they stand is left out, as every reading has it too.

        A line is compressed under one dictionary first, that of most of its words. Only if a reading is shorter than that is
        the line's least size looked for.
        """
        find, words = self.words.get, self.readings
        known = [[find(w) or self.word(w) for w in line] for line in lines]
        count = np.array([len(line) for line in lines])
        start, numbers = np.cumsum(count) - count, [number for line in known for _, number, _ in line]
        both = np.add.reduceat(self.more[numbers], start) + _COSTS
        many = (both + CHANGED // 2) // CHANGED
        cost = both - many * CHANGED
        chains: list[Chain] = [()] * len(lines)
        tried = np.flatnonzero(many.any(axis=1))
        least = np.zeros(len(lines), np.int64)
        least[tried] = self.lengths([" ".join(lines[i]) for i in tried.tolist()], np.add.reduceat(self.votes[numbers], start).argmax(axis=1)[tried].tolist())
        short = FRAME + np.minimum(2 * count - 1, LEAST_CODED - FRAME)  # words with spaces between them aren't one repeated character
        at, chain = np.nonzero((many > 0) & (cost + short[:, None] < least[:, None]))
        costs = cost[at, chain]
        candidates: dict[tuple[int, str], tuple[int, int]] = {}
        for i, k, c, limit in zip(at.tolist(), chain.tolist(), costs.tolist(), least[at].tolist()):
            read = " ".join([w if (core := words[number].get(k)) is None else before + core + after for w, (before, number, after) in zip(lines[i], known[i])])
            if c + _least_size(read) < limit and ((old := candidates.get((i, read))) is None or c < old[0]):
                candidates[i, read] = c, k
        likely = {i: (c, k, read) for (i, read), (c, k) in sorted(candidates.items(), key=lambda x: -x[1][0])}  # the one of least cost, as it lets others be left out
        exact: set[int] = set()
        for wave in (likely.items(), ((i, (c, k, read)) for (i, read), (c, k) in candidates.items() if k != likely[i][1])):
            left = [(i, *x) for i, x in wave if x[0] + _least_size(x[2]) <= least[i]]
            sizes = self.lengths([read for *_, read in left]).tolist()
            if new := list({i for (i, c, _, _), n in zip(left, sizes) if n + c < least[i]} - exact):
                least[new] = self.lengths([" ".join(lines[i]) for i in new])
                exact.update(new)
            for (i, c, k, _), n in zip(left, sizes):
                if n + c < least[i] or (n + c == least[i] and chains[i] and k < _NUMBER[chains[i]]):
                    chains[i], least[i] = _LIST[k], n + c
        return chains

    @staticmethod
    def _words(line: str) -> tuple[str, ...]:
        """The words of a line that are not ASCII, quoted or lost, in order."""
        bare = _QUOTED.sub(" ", line) if _MARK.search(line) else line
        words = set(filterfalse(str.isascii, bare.split(" ")))
        if LOST in bare:
            words = {w for w in words if not w.replace(LOST, "").isascii()} | {LOST}
        return tuple(sorted(words))

    def restore_all(self, texts: list[str]) -> list[tuple[str, list[str]]]:
        """The texts with garbled lines restored, and the chains used; ``lost`` for what can't be restored."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.neighbours) > MEMO:
            self.neighbours.clear()
        if len(self.words) > MEMO:
            for kept in (self.words, self.cores, self.readings):
                kept.clear()
        split = [text.split("\n") for text in texts]
        found = [[(i, self._words(line)) for i, line in enumerate(lines) if not line.isascii()] for lines in split]
        bare = lambda words: tuple([w for w in words if w != LOST]) if LOST in words else words
        self.decide(w for rows in found for _, words in rows if (w := bare(words)))
        out = []
        for lines, rows in zip(split, found):
            used = []
            for i, words in rows:
                if (w := bare(words)) and (chain := self.memo[w]):
                    lines[i] = self._outside(lines[i], chain)
                    used.append("+".join(f"{w}<{r}" for w, r in chain))
                if LOST in words:
                    used.append("lost")
            out.append(("\n".join(lines), used))
        return out

    def restore(self, text: str) -> tuple[str, list[str]]:
        return self.restore_all([text])[0]

    @staticmethod
    def _outside(line: str, chain: Chain) -> str:
        """Undoes the chain in the words of a line that don't stand in quotation marks."""
        at, out = 0, []
        for m in [*_QUOTED.finditer(line), None]:
            part = line[at : m.start() if m else len(line)]
            out.append(" ".join(w if w.isascii() else undo(w, chain) for w in part.split(" ")))
            if m:
                out.append(m[0])
                at = m.end()
        return "".join(out)


class Tally:
    """What the texts of a language hold: in how many each word and each pair of characters stands, and their distinct lines.

    Of lines only the words that are not ASCII and not quoted count. Lines that UTF-8 read with another
    encoding would explain, and those with replacement characters, are left out. Lines that several texts
    have count once, so that near-copies of a garbled text don't make it common.
    """

    def __init__(self) -> None:
        self.texts = 0
        self.words: Counter[str] = Counter()
        self.pairs: Counter[str] = Counter()
        self.lines: set[str] = set()

    def add(self, text: str, memo: dict[str, frozenset[str] | None]) -> None:
        """``memo``: the pairs of a word, None if a wrong decoding explains it."""
        self.texts += 1
        if text.isascii():
            return
        words: set[str] = set()
        for line in filterfalse(str.isascii, text.split("\n")):
            if LOST in line:
                continue
            bare = _QUOTED.sub(" ", line) if _MARK.search(line) else line
            own = list(filterfalse(str.isascii, bare.split(" ")))
            for w in own:
                if w not in memo:
                    memo[w] = None if _explained(w) else frozenset(_pairs(w))
                if memo[w] is None:
                    break
            else:
                if own:
                    self.lines.add(" ".join(own))
                    words.update(own)
        self.words.update(words)
        self.pairs.update(set().union(*[memo[w] for w in words]))

    def __len__(self) -> int:
        return len(self.words) + len(self.pairs) + len(self.lines)


def _explained(word: str) -> bool:
    return _LIKE_ANY.search(word) is not None and any(_oddities(u) <= _oddities(word) for r in ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437") if (u := _utf8_step(word, r)) != word)


def _least_texts(texts: int) -> float:
    """In so many of a language's texts a common pair of characters stands."""
    return max(2, COMMON * texts)


def _body(lines: list[str]) -> bytes:
    """The dictionary of lines, the most common first, as far as it goes: what is most common stands last, where references to it are shortest."""
    body, size = [], 0
    for line in lines:
        raw = line.encode("utf-8", "surrogatepass") + b"\n"
        if size + len(raw) > DICTIONARY_BYTES:
            break
        body.append(raw)
        size += len(raw)
    return b"".join(reversed(body))


def learn(texts: list[str]) -> tuple[bytes, set[str]]:
    """The dictionary of a language's texts, lines of more common words first, and the pairs of characters that several of them have."""
    found, memo = Tally(), {}
    for text in texts:
        found.add(text, memo)
    rated = sorted((-min(found.words[w] for w in line.split(" ")), line) for line in found.lines)
    return _body([line for _, line in rated]), {p for p, n in found.pairs.items() if n >= _least_texts(found.texts)}


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, value, n) of texts (text, lang): partial counts of texts, words and pairs, and lines."""
    found: dict[str, Tally] = {}
    memo: dict[str, frozenset[str] | None] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, t in found.items():
            for kind, n in (("text", {"": t.texts}), ("word", t.words), ("pair", t.pairs), ("line", dict.fromkeys(t.lines, 1))):
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(n), pa.string()) for x in (lang, kind)] + [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "kind", "value", "n"])

    for batch in batches:
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if lang not in found:
                found[lang] = Tally()
            found[lang].add(text, memo)
        if len(memo) > MEMO:
            memo.clear()
        if sum(map(len, found.values())) > MEMO:
            yield from rows()
            found.clear()
    yield from rows()


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, n, line) in the order of languages the first lines of each that fill a dictionary."""
    last, size = None, 0
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        sizes = pc.binary_length(batch.column(2).cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        keep = np.zeros(len(lang), bool)
        begin = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1), len(lang)]
        for i, j in zip(begin, begin[1:]):
            if i < j:
                sums = np.cumsum(sizes[i:j]) + (size if lang[i] == last else 0)
                keep[i:j] = sums <= DICTIONARY_BYTES
                last, size = lang[i], int(sums[-1])
        yield batch.filter(pa.array(keep))


def train(df: DataFrame, text: Column, lang: Column) -> tuple[dict[str, bytes], set[str]]:
    """``learn`` of all texts of each language, as groupings and joins: dictionaries, and the common pairs.

    Only what the dictionaries hold and the common pairs go through the driver: of each language
    ``DICTIONARY_BYTES``, and no more pairs than stand in so large a part of its texts.
    """
    texts = df.select(text.cast("string").alias("text"), F.lower(F.trim(lang)).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").rlike("^[a-z]{2,3}$") & (F.col("lang") != "und"))  # codes of two or three letters
    seen = stored(texts.mapInArrow(_tallied, "lang string, kind string, value string, n long").groupBy("lang", "kind", "value").agg(F.sum("n").alias("n")), "kind")
    kind = lambda k: seen.where(F.col("kind") == k)
    many = kind("text").select("lang", F.greatest(F.lit(2.0), COMMON * F.col("n")).alias("least"))
    pairs = {r.value for r in kind("pair").join(F.broadcast(many), "lang").where("n >= least").select("value").distinct().collect()}
    lines = kind("line").select("lang", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b"), F.col("value").alias("line"))
    words = lines.select("lang", "a", "b", F.explode(F.array_distinct(F.split("line", " "))).alias("value"))
    rates = words.join(kind("word").select("lang", "value", "n"), ["lang", "value"]).groupBy("lang", "a", "b").agg(F.min("n").alias("n"))
    rated = lines.join(rates, ["lang", "a", "b"]).select("lang", "n", "line")
    first = lambda rows: rows.sortWithinPartitions("lang", F.desc("n"), "line").mapInArrow(_first_lines, rows.schema)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in first(first(rated).repartition("lang")).collect():
        found.setdefault(r.lang, []).append((-r.n, r.line))
    bodies = {code: _body([line for _, line in sorted(rows)]) for code, rows in found.items()}
    return {code: body for code, body in bodies.items() if len(body) >= 64}, pairs


_RESTORERS: list[tuple[tuple, Restorer]] = []


def restore_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source: DataFrame | None = None) -> DataFrame:
    """(``id_col``, chains, lost, restored): the records with garbled lines.

    One pass counts what the dictionaries are made of and one narrow pass restores; only the dictionaries
    and the common pairs of characters, whose sizes are bounded, go through the driver. Words in quotation marks or backticks are taken for quoted and left out. Null, empty and
    ASCII texts are never garbled; ``lost`` says that replacement characters remain.
    """
    spark = df.sparkSession
    learnt = spark.sparkContext.broadcast(train(df, F.col(text_col), F.col(lang_col)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _RESTORERS or _RESTORERS[0][0] is not learnt.value:  # tasks of one worker share what they decided
            _RESTORERS[:] = [(learnt.value, Restorer(*learnt.value))]
        restorer = _RESTORERS[0][1]
        for batch in batches:
            at, chains, lost, texts = [], [], [], []
            given = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t and not t.isascii()]
            for (i, _), (text, used) in zip(given, restorer.restore_all([t for _, t in given])):
                if used:
                    at.append(i)
                    chains.append(sorted(set(used) - {"lost"}))
                    lost.append("lost" in used)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(lost, pa.bool_()), pa.array(texts, pa.string())], [id_col, "chains", "lost", "restored"])

    return (source or df).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, chains array<string>, lost boolean, restored string")

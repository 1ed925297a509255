"""Byte-level BPE encoding of a whole corpus by a prefix-sharing trie traversal.

Every task collects the words of a batch that it has not met yet, sorts them as bytes and walks
them in that order, which is the depth-first order of their trie. For each trie position it keeps
the *last-token state*: the one token with which the encoding of the prefix read so far ends. A
prefix that many words share is therefore encoded once, and a word's ids follow by stepping back
from its end over the last tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words at which a task's memory of encoded words is emptied, so that it stays bounded.
CACHE_ENTRIES = 300_000

_INF = 1 << 60
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public pre-tokenizer pattern
#: Before a space that a visible character follows, the pattern always starts a new word.
_CHUNK = re.compile(r"(?= \S)")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieEncoder:
    """Encodes words by depth-first traversal of their trie. ``model``: text of a byte-level BPE JSON file."""

    def __init__(self, model: str) -> None:
        data = json.loads(model)["model"]
        letters = _byte_letters()
        vocab = data["vocab"]
        self.tokens = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.merges: dict[tuple[int, int], int] = {}  # pair -> rank
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._states, self._index, self._go = [b""], {b"": 0}, {}  # bounded by the vocabulary's prefixes
        self._ends: list[list[tuple[int, int]]] = [[]]  # by state: its suffixes that are tokens, longest first

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is merged, each with the rank at which it is absorbed."""
        known = self._right if side else self._left
        if (out := known.get(token)) is None:
            out, until, t = [], _INF, token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.merges[self.parts[t]], self.parts[t][side]
            known[token] = out
        return out

    def _joint(self, left: int, right: int, but: int = _INF) -> bool:
        """Does the border between two adjacent tokens survive every merge of a rank below ``but``?"""
        for x, x_until in self._edge(left, 1):
            for y, y_until in self._edge(right, 0):
                rank = self.merges.get((x, y))
                if rank is not None and rank < but and rank < x_until and rank <= y_until:
                    return False
        return True

    def fits(self, pair: int) -> bool:
        """May the second token of the pair follow the first in an encoding?"""
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        out = self._fits[pair] = self._joint(pair >> 20, pair & 0xFFFFF)
        return out

    def _step(self, key: int) -> int:
        """The state after one more byte: the longest suffix of the text that begins a token."""
        text = self._states[key >> 8] + bytes([key & 255])
        while text and text not in self.prefixes:
            text = text[1:]
        if (state := self._index.get(text)) is None:
            state = self._index[text] = len(self._states)
            self._states.append(text)
            suffixes = ((len(text) - k, self.tokens.get(text[k:])) for k in range(len(text)))
            self._ends.append([(n, t) for n, t in suffixes if t is not None and self.whole(t)])
        self._go[key] = state
        return state

    def whole(self, token: int) -> bool:
        """Is the token's own text encoded as just that token?"""
        if (out := self._whole.get(token)) is None:
            if token not in self.parts:
                out = True
            else:
                a, b = self.parts[token]
                out = self.whole(a) and self.whole(b) and self._joint(a, b, self.merges[a, b])
            self._whole[token] = out
        return out

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of each word, in the order of the trie."""
        go, ends, known, joint = self._go, self._ends, self._fits, self.fits
        last: list[int] = [-1]  # by depth: the last token of the prefix
        sizes: list[int] = [0]  # by depth: that token's length
        states: list[int] = [0]  # by depth: the longest suffix that begins a token
        before = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            depth, most = 0, min(len(raw), len(before))
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], sizes[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for end in range(depth + 1, len(raw) + 1):
                key = state << 8 | raw[end - 1]
                state = go[key] if key in go else self._step(key)
                states.append(state)
                for size, token in ends[state]:
                    if size != end:
                        pair = last[end - size] << 20 | token
                        if not (known[pair] if pair in known else joint(pair)):
                            continue
                    last.append(token)
                    sizes.append(size)
                    break
                else:
                    raise ValueError(f"the vocabulary lacks the byte {raw[end - 1]:#x}")
            ids, at = [], len(raw)
            while at:
                ids.append(last[at])
                at -= sizes[at]
            ids.reverse()
            yield word, ids
            before = raw


class CorpusEncoder:
    """Encodes texts; keeps, within a bound, what it has encoded before."""

    def __init__(self, model: str) -> None:
        self.trie = TrieEncoder(model)
        self.words = regex.compile(_WORD)
        self.known: dict[str, bytes] = {}

    def learn(self, texts: list[list[str]]) -> None:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        chunks = set().union(*texts).difference(known)
        split = {c: self.words.findall(c) for c in chunks}
        new = set().union(*split.values())
        ids = {w: np.array(i, "<i4").tobytes() for w, i in self.trie.encode(new)}
        for c, ws in split.items():
            known[c] = b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """One list of ids for each text; an empty or null text has an empty list."""
        chunks = [_CHUNK.split(t) if t else [] for t in texts]
        self.learn(chunks)
        get = self.known.__getitem__
        rows = [b"".join(map(get, c)) for c in chunks]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))


_ENCODERS: dict[int, CorpusEncoder] = {}


def encode_corpus(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", rows: int = 1000) -> DataFrame:
    """``id_col`` and the token ids of ``text_col`` for every row, without special tokens.

    One narrow stage without a shuffle. What looks like a special token is ordinary text. A null or
    empty text gives an empty list; repeated rows stay repeated; other columns are left out. The
    vocabulary file at ``model_path`` is read by the driver and broadcast, its size being fixed.
    ``rows`` texts are encoded at a time.
    """
    with open(model_path, encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = CorpusEncoder(model.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], [id_col, ids_col])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")

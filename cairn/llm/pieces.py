"""SentencePiece ids of whole texts and back, without the library's encoder.

A model of the merge type joins neighbouring symbols, best score first and the
leftmost of equals, until no joined pair is a piece. The result is the one
sequence in which every two neighbours, merged again from their characters, come
out as they are. ``Pieces.encode`` looks for this sequence from the left: an
Aho-Corasick automaton gives the run of longest pieces, a piece is taken if it goes
with the one before it, else its next shorter prefix is tried, and a place that no
piece can leave is marked in a bitfield and never entered again.

No piece holds a blank behind another character, and the line end is no part of
any piece, so texts are cut there without changing the result, and each worker
keeps the ids of the words it met lately.

Nulls count as empty texts; an empty text has the end id alone. Every row, with
repeated or null ids too, gives one row. Texts of any length are encoded whole;
words over ``WORD`` characters are not kept.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import no_collections, slices
from cairn.llm.tokens import public_file

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
WORD = 64  # longer words are encoded each time they occur
KEPT_WORDS = 300_000  # words of one generation in a worker's cache; ids do not depend on it
KEPT_PAIRS = 1_000_000  # pairs of neighbours whose answer is kept

_PARTS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n[^{BLANK}\n]*")


@cache
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's model, one per Python worker and file."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The pieces of a model of the merge type, and texts to ids by them."""

    def __init__(self, path: str):
        self.library = lib = library(path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        code = struct.Struct("<i").pack
        self.codes = {piece: code(i) for piece, i in self.ids.items()}
        self.bytes = [code(lib.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.end = code(lib.eos_id())
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("a piece reaches over a blank or a line end")
        # a piece that its own characters do not merge to can never come out
        reached = {p for p in self.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in reached:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.widest = max(map(len, reached))
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), "") for p in reached}
        # the longest piece that every beginning of a piece begins with
        self.inner: dict[str, str] = {}
        for piece in sorted(reached, key=len):
            for n in range(1, len(piece)):
                self.inner.setdefault(piece[:n], self.inner.get(piece[: n - 1], ""))
            self.inner[piece] = piece
        self.bonds = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[str, dict[str, str]] = defaultdict(dict)
        self.kept = 0
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that merging leaves, straight from the definition."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _fit(self, left: str, piece: str) -> str:
        """The longest of a piece and its shorter prefixes that goes with ``left``, else nothing."""
        if self.kept >= KEPT_PAIRS:
            self.pairs.clear()
            self.kept = 0
        known = self.pairs[left]
        tried = []
        while piece:
            if piece in known:
                piece = known[piece]
                break
            tried.append(piece)
            if self.merged(left + piece) == [left, piece]:
                break
            piece = self.shorter.get(piece, "")
        for t in tried:
            known[t] = piece
        self.kept += len(tried)
        return piece

    def _run(self, word: str) -> list[str]:
        """Longest pieces from the left, none of them checked; a character that is no piece stands alone."""
        run: list[str] = []
        at = 0
        for end, length in self.automaton.iter_long(word):
            start = end - length + 1
            if at < start:
                run += word[at:start]
            at = end + 1
            run.append(word[start:at])
        if at < len(word):
            run += word[at:]
        return run

    def _longest(self, word: str, at: int) -> str:
        """The longest piece at a place, by the longest path of the automaton from there."""
        path = word[at : at + self.widest]
        path = path[: self.automaton.longest_prefix(path)]
        return self.inner.get(path) or word[at]

    def split(self, word: str) -> list[str]:
        """The pieces of one word; a character that is no piece stands alone."""
        pairs = self.pairs
        taken = self._run(word)
        # the run is right up to the first pair that does not go together
        good, piece = 1, ""
        for left, right in zip(taken, taken[1:]):
            piece = pairs[left].get(right)
            if piece is None:
                piece = self._fit(left, right)
            if piece != right:
                break
            good += 1
        if good >= len(taken):
            return taken
        del taken[good:]
        at, size = sum(map(len, taken)), len(word)
        failed = bytearray(size // 8 + 1)
        while True:
            while piece:  # the longest one that fits and leads to a place that is not marked
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    break
                piece = self.shorter.get(piece, "")
                if piece and taken:
                    fits = pairs[taken[-1]].get(piece)
                    piece = self._fit(taken[-1], piece) if fits is None else fits
            if piece:
                taken.append(piece)
                if to == size:
                    return taken
                at = to
                piece = self._longest(word, at)
            else:  # nothing leads on from here: go back to a shorter piece before it
                failed[at >> 3] |= 1 << (at & 7)
                before = taken.pop()
                at -= len(before)
                piece = self.shorter.get(before, "")
            if piece and taken:
                fits = pairs[taken[-1]].get(piece)
                piece = self._fit(taken[-1], piece) if fits is None else fits

    def _code(self, word: str) -> bytes:
        """The ids of the pieces of a word."""
        coded = list(map(self.codes.get, parts := self.split(word)))
        while None in coded:  # no piece: the bytes of the character
            at = coded.index(None)
            coded[at] = b"".join([self.bytes[b] for b in parts[at].encode()])
        return b"".join(coded)

    def _cut(self, word: str) -> list[str]:
        """Parts of a word between characters that stand side by side in no piece."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.bonds]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._code(part)
            if len(part) <= WORD:
                if len(self.parts) >= KEPT_WORDS // 4:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _word(self, key: str) -> bytes:
        """Ids of a key: blanks and a word, a line end and a word, or a word behind one blank."""
        word = key if key[:1] in ("\n", BLANK) else BLANK + key
        if key.isalpha():
            return self._code(word)
        first, *rest = self._cut(word)
        plain = first[1:]
        ids = (self.words.get(plain) or self.older.get(plain)) if rest and plain.isalpha() else None
        return b"".join([self._code(first) if ids is None else ids, *map(self._part, rest)])

    def _keys(self, text: str) -> list[str]:
        text = text.replace(BLANK, " ")
        keys = text.replace("\n", " \n").split(" ")
        if "" not in keys:
            return keys
        parts = _PARTS.findall(BLANK + text.replace(" ", BLANK))
        return [p[1:] if p[0] == BLANK and p[1:2] not in ("", BLANK) else p for p in parts]

    def coded(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, closed by the end id."""
        if not text:
            return self.end
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        known, keys = self.words, self._keys(text)
        found = list(map(known.get, keys))
        if None in found:
            older = self.older
            for i, ids in enumerate(found):
                if ids is None:
                    key = keys[i]
                    ids = known.get(key) or older.get(key) or self._word(key)
                    if len(key) <= WORD:
                        known[key] = ids
                    found[i] = ids
        found.append(self.end)
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, closed by the end id."""
        return np.frombuffer(self.coded(text), "<i4").tolist()


@cache
def pieces(path: str) -> Pieces:
    """One model per Python worker and file."""
    return Pieces(path)


def encoded(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """``doc_id, ids``: the ids of every text as the library encodes it, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(public_file(name))
        for batch in slices(batches):
            with no_collections():
                rows = [model.coded(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(rows), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), flat)], ["doc_id", "ids"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, name: str = MODEL) -> DataFrame:
    """``doc_id, ids, text``: the library's text of every row of ids; none or null give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library(public_file(name))
        for batch in slices(batches):
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().tolist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()).tolist()
            rows = [flat[a:b] for a, b in zip([0, *ends], ends)]
            with no_collections():
                texts = pa.array(model.decode(rows, num_threads=1) if rows else [], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "text"])

    source = tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digest(tokens: DataFrame) -> DataFrame:
    """One row per document with the count of its ids and hashes of ids and text."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )

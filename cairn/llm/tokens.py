"""Token ids of whole texts from a public tokenizer file, with a cache of words.

The library's own encoder decides every id. Words recur far more often than
texts, so each worker keeps the ids of the pieces it has met and hands only
unknown pieces to the library. A text is cut only where the tokenizers cut
anyway: between runs of Latin letters, digits and ASCII signs. A text with
apostrophes or other characters is cut at single blanks and line ends, and one
with runs of white space or a special token goes whole to the library.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_PIECES = 200_000  # pieces of one generation in a worker's cache; ids do not depend on it
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIGNS = r"!-&(-/:-@\[-`{-~"
_UNUSUAL = rf"[^{_LETTERS}{_SIGNS}0-9 \n]|  |\n\n| \n|\n "
_RUNS = re.compile(r"\s\s")
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_CUT, _END = "\x01", "\x02"


class Encoder:
    """Texts to 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what may stand between words of one call so that their ids can be told apart
        self.between = next(s for s in ("\n", " 7 ") if len(self._ids("a" + s + "b")) == 3)
        self.mark = self._ids("a" + self.between + "b")[1]
        self.blanks_count = self._ids("a b") != self._ids("a\nb")
        # pieces met lately, and those of the generation before
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _bytes(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if _WORD.fullmatch(p)]
        groups = [words[at : at + 50] for at in range(0, len(words), 50)]
        coded = self.tokenizer.encode_batch_fast([self.between.join(g) for g in groups], add_special_tokens=False)
        for part, e in zip(groups, coded):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:  # a word holds the mark: one by one
                self.pieces.update((w, self._bytes(self._ids(w))) for w in part)
                continue
            data, start = ids.tobytes(), 0
            for w, cut in zip(part, [*cuts.tolist(), len(ids)]):
                self.pieces[w] = data[4 * start : 4 * cut]
                start = cut + 1
        rest = list(set(pieces).difference(words))
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.pieces[p] = self._bytes(e.ids)

    def _found(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        found = list(map(known.get, pieces))
        if None in found:
            missing = [p for p, f in zip(pieces, found) if f is None]
            again = list(map(self.older.get, missing))
            known.update((p, f) for p, f in zip(missing, again) if f is not None)
            self._learn([p for p, f in zip(missing, again) if f is None])
            found = list(map(known.__getitem__, pieces))
        return found

    def _usual(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts of Latin letters, digits and signs, as columns."""
        cut = texts
        for old, new in ((" ", _CUT + " "), ("\n", f"{_CUT}\n{_CUT}")):
            cut = pc.replace_substring(cut, old, new if self.blanks_count else _CUT)
        cut = pc.replace_substring_regex(cut, rf"( ?[{_SIGNS}]+| ?[0-9]+)", rf"{_CUT}\1{_CUT}")
        if end:
            cut = pc.binary_join_element_wise(cut, _END, _CUT)
        lists = pc.split_pattern(cut, _CUT)
        coded = lists.flatten().dictionary_encode()
        self.pieces[""], self.pieces[_END] = b"", end
        found = self._found(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        lengths = size[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(at[index] - (ends - lengths), lengths) + np.arange(total)]
        bounds = lists.offsets.to_numpy()
        return ids, np.diff(np.append(0, ends)[bounds - bounds[0]])

    def _unusual(self, text: str) -> bytes:
        if _RUNS.search(text) or any(s in text for s in self.specials) or "\0" in text or _END in text:
            return self._bytes(self._ids(text))
        if not self.blanks_count:
            parts = text.replace("\n", " ").split(" ")
        else:  # a blank belongs to the word behind it; a line end is a piece of its own
            parts = text.replace("\n", " \n ").replace(" ", "\0 ").replace("\0 \n\0 ", "\0\n\0").split("\0")
        return b"".join(self._found(parts))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by ``end_id``, and the number of ids of each."""
        if len(self.pieces) > CACHE_PIECES:
            self.older, self.pieces = self.pieces, {}
        texts = pc.fill_null(texts, "")
        end = b"" if end_id is None else self._bytes([end_id])
        odd = pc.match_substring_regex(texts, "|".join([_UNUSUAL, *map(re.escape, self.specials)]))
        usual = texts.filter(pc.invert(odd))
        ids, lengths = self._usual(usual, end)
        if len(usual) == len(texts):
            return ids, lengths
        rest = (np.frombuffer(self._unusual(t) + end, "<u4") for t in texts.filter(odd).to_pylist())
        common = iter(np.split(ids, np.cumsum(lengths)[:-1])) if len(lengths) else iter(())
        parts = [next(rest if o else common) for o in odd.to_pylist()]
        return np.concatenate([*parts, np.zeros(0, "<u4")]), np.array([len(p) for p in parts], np.int64)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def public_file(name: str) -> str:
    """Where the tokenizer file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)

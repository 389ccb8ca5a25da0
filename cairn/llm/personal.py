"""Personal data: exact base patterns, and a semi-Markov CRF that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers. Around
marks that the base leaves open (digits, also in groups, long mixed or hex words,
what follows the name of a secret, spelt-out addresses) the
semi-Markov model scores whole candidate segments of up to ``LONGEST`` tokens:
their shape, digit and letter counts, checksum, octets and the word before.
Dynamic programming picks boundaries and kinds of a window together.

The model is trained by the likelihood of windows whose spans the base finds,
and of rewritten ones (a phone without its plus, a spelt-out address, a card
with a wrong digit as a negative), and of passages without any span. Training takes at most ``WINDOWS`` windows
of texts chosen by a hash.

Nulls: a null text is an empty one and has no spans; a null doc_id stays. Every
row gives a row. An empty table gives no rows; texts without base spans leave
the model untrained, and it adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("other", *KINDS)
WINDOWS = 300
AROUND = 6  # tokens on either side of a mark
LONGEST = 12
SPELT = 60  # characters between a spelt-out dot and its at, at most
GROUPED = 6  # digits of groups that make a mark together
EPOCHS, STEP = 6, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?i:[(\[{](?:at|dot)[)\]}])|\w(?:[\w.%+@-]*\w)?|[^\w\s]")
_BRACKETED = re.compile(r"(?i)[(\[{](?:at|dot)[)\]}]")
_SIGNS = [o + w + c for w in ("at", "dot") for o in "([{" for c in ")]}"]
_NAMES = ("token", "key", "secret", "password")
_AT_HOST = re.compile(r"(?i)(?<!\w)at [a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?!\w)")
_DOT = re.compile(r"(?i)(?<!\w)dot(?!\w)")
_AT = re.compile(r"(?i)(?<!\w)at(?!\w)|@")
_GAP = re.compile(r"[^\w\n]{1,3}")
_LONG = re.compile(r"[A-Za-z0-9_/+-]{16,}")
_NAMED = re.compile(r"(?i)\b(?:token|key|secret|password)[\"']?\s*[=:]\s*[\"']?\S+")
_KEYED = re.compile(r"\b(?:token|key|secret|password)\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{16,})")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if i % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = after = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", after)


def _numbers(text: str) -> Iterator[Span]:
    """IP addresses and cards, from the runs of digits."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) < 3 or len(p) == 3 and int(p) <= 255 for p in parts):
                yield four[0][0], four[3][1], "ip"
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        count = sum(e - s for s, e in runs[i : j + 1])
        if 14 <= count <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            yield runs[i][0], runs[j][1], "card"
        i = j + 1


def base_spans(text: str) -> list[Span]:
    """Start, end and kind of what the base patterns find, by start, then kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        found += _numbers(text)
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdecimal, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(100_000)
def span_features(part: str, before: str, tokens: int) -> tuple[str, ...]:
    """Features of a whole segment and the token before it."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", part))
    digits = re.sub(r"[^0-9]", "", part)
    letters = sum(map(str.isalpha, part))
    found = ["bias", f"shape {shape[:24]}", f"digits {min(len(digits), 20)}", f"letters {min(letters.bit_length(), 6)}", f"tokens {tokens}"]
    if 14 <= len(digits) <= 19 and not letters:
        found.append(f"luhn {luhn(digits)}")
    if len(part) >= 16 and re.fullmatch(r"[0-9A-Fa-f]+", part) and letters and digits:
        found.append("hex")
    if len(part) >= 16 and letters and digits and part.isalnum():
        found.append("mixed")
    if re.fullmatch(r"[0-9]{1,9}(\.[0-9]{1,9}){3}", part):
        found.append(f"octets {all(int(p) <= 255 for p in part.split('.'))}")
    if "@" in part or re.search(r"(?i)\bat\b.*\bdot\b|\bdot\b.*(?:\bat\b|@)", part):
        found.append("address")
    if 10 <= len(digits) <= 15 and re.fullmatch(r"[+0-9(). -]+", part):
        found.append(f"dial {part[0] == '+'} {part[0] == '('}")
    found.append(f"before {before.lower()}" if re.fullmatch(r"(?i)token|key|secret|password|[=:+\"'(]", before) else "before word" if before else "before none")
    return tuple(found)


class SemiCrf:
    """Weights by feature and label, and between neighbouring labels."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights = weights or {}
        self.moves = np.array(moves) if moves else np.zeros((len(LABELS), len(LABELS)))

    def table(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[np.ndarray, tuple[str, ...]]]]:
        """For every end token, the scores and features of the segments of 1, 2, ... tokens that end there."""
        rows = []
        for j in range(1, len(tokens) + 1):
            row = []
            for n in range(1, min(LONGEST, j) + 1):
                i = j - n
                before = text[slice(*tokens[i - 1])] if i else ""
                features = span_features(text[tokens[i][0] : tokens[j - 1][1]], before, n)
                score = np.zeros(len(LABELS))
                for f in features:
                    if f in self.weights:
                        score += self.weights[f]
                if n > 1:
                    score[0] = -np.inf  # "other" is always one token
                row.append((score, features))
            rows.append(row)
        return rows

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's spans."""
        best, back = [np.zeros(len(LABELS))], []
        for j, row in enumerate(self.table(text, tokens), 1):
            scores = np.full(len(LABELS), -np.inf)
            came = [(0, 0)] * len(LABELS)
            for n, (score, _) in enumerate(row, 1):
                step = best[j - n][:, None] + (self.moves if j > n else np.zeros_like(self.moves))
                prior = step.argmax(axis=0)
                total = step.max(axis=0) + score
                for y in np.flatnonzero(total > scores):
                    scores[y], came[y] = total[y], (n, int(prior[y]))
            best.append(scores)
            back.append(came)
        spans, j = [], len(tokens)
        y = int(best[j].argmax())
        while j:
            n, prior = back[j - 1][y]
            if y:
                spans.append((tokens[j - n][0], tokens[j - 1][1], LABELS[y]))
            j, y = j - n, prior
        return spans[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], truth: list[tuple[int, int, int]], step: float) -> None:
        """One likelihood step. ``truth``: first token, end token and label of every segment."""
        rows, size = self.table(text, tokens), len(LABELS)
        end = len(tokens)
        into = [np.zeros(size)] + [None] * end
        ahead: list = [None] * end + [np.zeros(size)]
        lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
        for j in range(1, end + 1):
            parts = []
            for n, (score, _) in enumerate(rows[j - 1], 1):
                prior = lse(into[j - n][:, None] + self.moves, 0) if j > n else np.zeros(size)
                parts.append(prior + score)
            into[j] = lse(np.array(parts), 0)
        for i in range(end - 1, 0, -1):
            parts = [self.moves + (rows[i + n - 1][n - 1][0] + ahead[i + n])[None, :] for n in range(1, min(LONGEST, end - i) + 1)]
            ahead[i] = lse(np.array([lse(p, 1) for p in parts]), 0)
        whole = lse(into[end], 0)
        slope = np.zeros_like(self.moves)
        change: dict[str, np.ndarray] = {}
        for j in range(1, end + 1):
            for n, (score, features) in enumerate(rows[j - 1], 1):
                if j > n:
                    pair = np.exp(into[j - n][:, None] + self.moves + (score + ahead[j])[None, :] - whole)
                    slope -= pair
                    chance = pair.sum(axis=0)
                else:
                    chance = np.exp(score + ahead[j] - whole)
                if chance.max() > 1e-4:
                    for f in features:
                        change[f] = change.get(f, 0) - chance
        last = None
        for i, j, y in truth:
            for f in rows[j - 1][j - i - 1][1]:
                one = np.zeros(size)
                one[y] = 1
                change[f] = change.get(f, 0) + one
            if last is not None:
                slope[last, y] += 1
            last = y
        self.moves += step * (slope - 0.01 * self.moves)
        for f, c in change.items():
            old = self.weights.get(f, np.zeros(size))
            self.weights[f] = old + step * (c - 0.01 * old)


def windows(text: str, marks: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Token places around the marks; windows that meet are joined, so no two share a place."""
    reach, joined = 14 * AROUND, []
    for s, e in sorted(marks):
        s, e = max(0, s - reach), min(len(text), e + reach)
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    found, before = [], 0
    for s, e in joined:
        least = max(before, s - 64)
        while s > least and not text[s - 1].isspace() and not text[s].isspace():
            s -= 1
        found.append([m.span() for m in _TOKEN.finditer(text, s, e)])
        before = e
    return [w for w in found if w]


class _Covered:
    """Whether a place lies within, or touches, what spans cover; overlapping spans count as one."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def holds(self, s: int, e: int) -> bool:
        at = bisect_right(self.starts, s) - 1
        return at >= 0 and e <= self.ends[at]

    def meets(self, s: int, e: int) -> bool:
        at = bisect_left(self.starts, e) - 1
        return at >= 0 and s < self.ends[at]


def open_marks(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Digits, long words, named secrets and spelt-out signs that no base span covers."""
    taken = iter(sorted((s, e) for s, e, _ in base))
    now = next(taken, None)
    marks, groups = [], []
    for m in _DIGITS.finditer(text):
        while now and now[1] <= m.start():
            now = next(taken, None)
        if now and now[0] <= m.start():
            continue
        if m.end() - m.start() >= 3:
            marks.append(m.span())
        if groups and _GAP.fullmatch(text, groups[-1][1], m.start()):
            groups[-1] = (groups[-1][0], m.end(), groups[-1][2] + m.end() - m.start())
        else:
            groups.append((*m.span(), m.end() - m.start()))
    marks += [(s, e) for s, e, n in groups if n >= GROUPED]
    for m in _LONG.finditer(text):
        letters = sum(map(str.isalpha, m[0]))
        if letters and any(map(str.isdigit, m[0])) or re.fullmatch(r"[0-9A-Fa-f]+", m[0]):
            marks.append(m.span())
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        marks += [m.span() for m in _NAMED.finditer(text)]
    if any(sign in lower for sign in _SIGNS):
        marks += [m.span() for m in _BRACKETED.finditer(text)]
    if " at " in lower:
        marks += [m.span() for m in _AT_HOST.finditer(text)]
    for m in _DOT.finditer(text) if "dot" in lower else ():  # a plain "dot" needs an "at" near it, and a plain "at" alone is a word
        s, e = max(0, m.start() - SPELT), m.end() + SPELT
        if near := [a.span() for a in _AT.finditer(text, s, e)]:
            marks.append((min(m.start(), near[0][0]), max(m.end(), near[-1][1])))
    covered = _Covered(base)
    return [m for m in marks if not covered.holds(*m)]


def all_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """Base spans and those of the model that touch none of them."""
    if not model.weights:
        return base
    covered = _Covered(base)
    added = [
        (s, e, kind)
        for tokens in windows(text, open_marks(text, base))
        for s, e, kind in model.decode(text, tokens)
        if not covered.meets(s, e)
    ]
    return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def _examples(texts: list[str]) -> Iterator[tuple[str, list[Span]]]:
    """Short texts with their spans: as found, and rewritten."""
    for text in texts:
        known = base_spans(text) + [(*m.span(1), "secret") for m in _KEYED.finditer(text)]
        if not known:  # numbers that are nothing
            yield text, []
        for s, e, kind in known:
            left, part, right = text[max(0, s - 40) : s], text[s:e], text[e : e + 40]
            left, right = left[left.find(" ") + 1 :] if " " in left else left, right[: right.rfind(" ")] if " " in right else right
            ways = [(part, kind)]
            if kind == "email" and "." in part:
                user, _, host = part.partition("@")
                name = user.strip(".") or "a"
                for at, dot in ((" at ", " dot "), (" [at] ", " [dot] "), (" AT ", " DOT "), ("(at)", "(dot)")):
                    ways.append((f"{name}{at}{dot.join(host.split('.'))}", kind))
                ways.append((f"{'(dot)'.join(name.split('.')) if '.' in name else name + '(dot)a'} @ {host.split('.')[0]}", kind))
                left = left if left[-1:].isspace() or not left else left + " "
            elif kind == "phone":
                ways.append((part[part.find("(") :] if "(" in part else part[1:], kind))
                digits = re.sub(r"[^0-9]", "", part)[-9:]
                ways.append((" ".join(re.findall("..", "0" + digits)), kind))
            elif kind == "card":
                ways += [(part[:-1] + str((int(part[-1]) + 1) % 10), "other"), (part[:5] + part[-3:], "other")]
            elif kind == "ip":
                ways += [(part + "9" * (3 - len(part.rpartition(".")[2])) + "9", "other"), (part.rpartition(".")[0], "other")]
            for new, what in ways:
                yield left + new + right, [] if what == "other" else [(len(left), len(left) + len(new), what)]


def train(texts: list[str], limit: int = WINDOWS) -> SemiCrf:
    """A model from the texts; they are sorted first, so that their order does not matter."""
    ready = []
    for text, spans in _examples(sorted(texts)):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        truth, j = [], 0
        while j < len(tokens):
            hit = next((s for s in spans if s[0] <= tokens[j][0] < s[1]), None)
            n = sum(s < hit[1] for s, _ in tokens[j:]) if hit else 1
            if hit and n > LONGEST:
                break
            truth.append((j, j + n, LABELS.index(hit[2]) if hit else 0))
            j += n
        if tokens and j == len(tokens):
            ready.append((text, tokens, truth))
    by_kind: dict[int, list] = {}
    for x in ready:
        by_kind.setdefault(max(y for *_, y in x[2]), []).append(x)
    share = max(1, limit // max(1, len(by_kind)))
    chosen = [x for k in sorted(by_kind) for x in by_kind[k][:: max(1, len(by_kind[k]) // share)][:share]]
    order = np.random.default_rng(7)
    model = SemiCrf()
    for epoch in range(EPOCHS if chosen else 0):
        for k in order.permutation(len(chosen)):
            model.learn(*chosen[k], STEP / (1 + epoch))
    return model


def fit(docs: DataFrame, limit: int = WINDOWS) -> SemiCrf:
    """Train on passages with digits from at most ``4 * limit`` texts, chosen by a hash of the text."""
    some = (
        docs.filter(F.col("text").rlike("[0-9]{3}|@"))
        .select(F.xxhash64("text").alias("h"), F.expr(r"regexp_extract_all(text, '(?s)[^\n]{0,60}(?:\\+[0-9]|[0-9]{3}|@)[^\n]{0,80}', 0)").alias("parts"))
        .select("h", F.slice("parts", 1, 4).alias("parts"))
        .distinct()
        .orderBy("h")
        .limit(4 * limit)
        .collect()
    )
    return train([p for r in some for p in r.parts], limit)


SPANS = "array<struct<start:int,end:int,kind:string,base:boolean>>"


def personal_data(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """``doc_id`` and ``found``: every span with its code point places, kind and whether the base found it."""
    weights, moves = {f: w.tolist() for f, w in model.weights.items()}, model.moves.tolist()
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCrf({f: np.array(w) for f, w in weights.items()}, moves)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                both = all_spans(text, base, own) if text else []
                sure = set(base)
                rows.append([{"start": s, "end": e, "kind": k, "base": (s, e, k) in sure} for s, e, k in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, f"doc_id long, found {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["base"])
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", told), ",").alias("spans")
    )

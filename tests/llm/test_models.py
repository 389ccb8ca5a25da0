import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import languages, personal, toxicity, url_rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = lambda t: re.sub(r"[^0-9]", "", t)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(DIGITS(m[0])) <= 19 and personal.luhn(DIGITS(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS(m[0])) <= 15]
    return [(s, e, personal.BASE[k]) for s, k, e in sorted(found)]


def test_base_spans():
    source = random.Random(3)
    bits = ["1", "2", "55", "0", ".", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "4111111111111111", "%", "_", "\n", "é", "٣"]
    for _ in range(5000):
        text = "".join(source.choice(bits) for _ in range(source.randint(0, 25)))
        assert personal.base_spans(text) == brute_spans(text), text


def test_best_segmentation_is_the_best():
    """The decoder against all segmentations of short texts."""
    values = np.random.default_rng(1)
    text = "+1 555 2671"
    tokens = [m.span() for m in personal._TOKEN.finditer(text)]
    weights = {}
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens) + 1):
            for f in personal.span_features(text[tokens[i][0] : tokens[j - 1][1]], text[slice(*tokens[i - 1])] if i else "", j - i):
                weights.setdefault(f, values.normal(size=len(personal.LABELS)))
    model = personal.SemiCrf(weights, values.normal(size=(6, 6)).tolist())
    table = model.table(text, tokens)

    def all_ways(i, last):
        if i == len(tokens):
            yield 0.0, []
            return
        for j in range(i + 1, len(tokens) + 1):
            for y in range(6):
                if y == 0 and j > i + 1:
                    continue
                move = 0 if last is None else model.moves[last, y]
                for total, rest in all_ways(j, y):
                    yield table[j - 1][j - i - 1][0][y] + move + total, ([(tokens[i][0], tokens[j - 1][1], personal.LABELS[y])] if y else []) + rest

    assert model.decode(text, tokens) == max(all_ways(0, None), key=lambda w: w[0])[1]


def test_personal_data(spark, documents):
    source = random.Random(8)
    words = "the of and to in that is was for with".split()
    prose = lambda: " ".join(source.choice(words) for _ in range(12))
    key = lambda: "".join(source.choice("0123456789abcdef") for _ in range(40))
    texts = []
    for _ in range(60):
        texts.append(f'{prose()} token = "{key()}" {prose()} +1 (415) 555-{source.randint(1000, 9999)} {prose()} 10.{source.randint(0, 255)}.3.4 {prose()} a{source.randint(1, 99)}@mail.example.com {prose()} 4111111111111111 {prose()}')
    extra = [None, "", "no data", f'{prose()} token = "{key()}" end', "é" * 5 + " x@y.zz", "1" * 5000]
    docs = documents([*texts, *extra], [*range(65), None])
    model = personal.fit(docs)
    rows = personal.personal_data(docs, model).collect()
    told = personal.digest(personal.personal_data(docs, model)).collect()
    for r, d, text in zip(rows, told, [*texts, *extra]):
        base = [(x.start, x.end, x.kind) for x in r.found if x.base]
        assert base == brute_spans(text or "")
        assert d.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert d.n_email == sum(k == "email" for *_, k in base)
    added = [(x.kind, (texts + extra)[i][x.start : x.end]) for i, r in enumerate(rows) for x in r.found if not x.base]
    assert sum(k == "secret" and len(t) == 40 for k, t in added) >= 55 and not rows[62].found
    assert personal.personal_data(docs.limit(0), personal.fit(docs.limit(0))).count() == 0


def test_url_rules(spark):
    values = np.random.default_rng(9)
    hosts = ["example.com", "a.example.com", "b.a.example.com", "xample.com", "example.net", "org", "x.org", "net", "com", ""]
    paths = ["", "/", "/de/", "/de", "/de/x", "/en/1?q#f", "/fr/#a", "?x=/de/"]
    urls = [f"https://{h.upper() if values.random() < 0.3 else h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c", "HTTP://Example.COM/De/"]
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "", ""), (0, urls[0], "", "")], "page_id long, url string, html string, part string")
    rules = [("example.com", "/de/", "block"), ("a.example.com", "", "allow"), ("com", "/", "block"), ("net", "/", "block"), ("org", "/fr/", "allow"), ("x.org", "", "block"), ("", "", "allow"), ("com", "/", "block")]

    def judge(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 and url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect())
    assert got == sorted((str(i), *judge(u)) for i, u in [*enumerate(urls), (None, urls[0]), (0, urls[0])])
    assert url_rules.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_url_rules_over_ranges(spark):
    """Many ranges, a rule that spans them all, and a host with a third of all rows."""
    urls = [f"http://h{i % 50}.example.net/en/{i}" for i in range(2000)] + ["http://hot.example.net/"] * 1000
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("h7.example.net", "/en/7", "allow")], "host string, path string, action string")
    got = {r.page_id: r.rule for r in url_rules.judged(pages, rules).collect()}
    assert all(got[i] == ("h7.example.net/en/7" if "//h7." in u and "/en/7" in u else "net/") for i, u in enumerate(urls))


def test_languages(documents):
    source = random.Random(2)
    syllables = {"en": "th er on an re he in ed".split(), "de": "ei ch sch en ung ver ge be".split(), "fr": "ou ai eau en tre qu la é".split()}
    texts, langs = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        texts.append(" ".join("".join(source.choice(syllables[lang]) for _ in range(3)) for _ in range(30)))
        langs.append(lang)
    docs = documents([*texts, None, "", "123 !!", texts[0]], [*range(243), None], [*langs, None, "en", "de", None])
    rows = languages.languages(docs, languages.fit(docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 244 and all(got[i].lang_pred == langs[i] for i in range(240) if got[i].held_out)
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(243))
    assert all(0 <= r.score <= 1 for r in rows)
    assert languages.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in languages.languages(docs, None).collect()} == {"und"}


def test_rare_languages_keep_their_share_of_the_sample(documents):
    texts = [f"the river and the hill number {i} are there" for i in range(400)] + [f"zwq xkv zwq jqx {i} xkv" for i in range(6)]
    docs = documents(texts, [*range(406)], ["en"] * 400 + ["rare"] * 6)
    model = languages.fit(docs, sample=40)
    assert set(model.languages) == {"en", "rare"}
    got = {r.doc_id: r.lang_pred for r in languages.languages(docs, model).collect()}
    assert all(got[i] == ("en" if i < 400 else "rare") for i in range(406))
    assert set(languages.fit(docs, sample=30).languages) == {"en"}  # room for one language


def test_clauses():
    weights = toxicity.Weights({"fool": 4.0, "clod*": 3.0})
    told = lambda t: toxicity.clause_weights(toxicity._TOKEN.findall(t.lower()), weights)
    assert told("A fool.") == [4.0] and told("you fool") == [5.0] and told("not a fool") == [2.0]
    assert told("he said fool!") == pytest.approx([4 * 1.25 * 0.7]) and told("cloddish; fool") == [3.0, 4.0]
    assert told("not here, a fool") == [4.0] and told("i kill you") == [3.75] and told("kill time") == []
    assert told("") == [] and told("clod") == [] and told("isn't a fool") == [2.0]


def test_toxicity(spark, documents):
    source = random.Random(4)
    words = ["".join(source.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    bad = ["fool", "moron", "scumlike"]
    texts, marks = [], []
    for i in range(300):
        body = [source.choice(words) for _ in range(40)]
        if i % 6 == 0:
            for _ in range(4):
                body.insert(source.randint(0, 40), source.choice(bad))
        texts.append(" ".join(body) + ".")
        marks.append(int(i % 6 == 0))
    docs = documents([*texts, None, ""], range(302))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(5, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 302
    assert all(got[i].predicted == marks[i] for i in range(300) if got[i].held_out)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(302))
    assert got[300].predicted == got[301].predicted == 0
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == 252
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


OPEN = [
    "write jane [at] example [dot] com soon", "write jane(dot)doe @ example soon", "write Jane AT example DOT com soon", "please call 06 12 34 56 78 today",
    "password: xK9dLmQ2wZtRb7YpVn", 'token = "bbad1ecab5a43ebe9e8f8ce17ceff21e10f09c08"', "jane at example.com", "the digest abcdefabcdefabcdefab of it",
]


@pytest.mark.parametrize("text", OPEN)
def test_open_marks_of_all_kinds(text):
    marks = personal.open_marks(text, personal.base_spans(text))
    assert marks and personal.windows(text, marks)


def test_marks_leave_base_spans_alone():
    for text in ("4111111111111111", "+1 (415) 555-0100", "a@mail.example.com", "10.20.30.40", "1 2 3", "none of them here"):
        assert not personal.open_marks(text, personal.base_spans(text)), text


def test_all_planted_secrets_are_found(spark, documents):
    source = random.Random(18)
    words = "the of and to in that is was for with".split()
    prose = lambda: " ".join(source.choice(words) for _ in range(12))
    key = lambda: "".join(source.choice("0123456789abcdef") for _ in range(40))
    broken = lambda: "".join(source.choice("abcdef") + (source.choice("0123456789abcdef") if i % 2 else source.choice("abcdef")) for i in range(20))
    keys = [key() if i % 2 else broken() for i in range(60)]
    texts = [f'{prose()} token = "{k}" {prose()} +1 (415) 555-{source.randint(1000, 9999)} {prose()} 10.{source.randint(0, 255)}.3.4 {prose()} a{source.randint(1, 99)}@mail.example.com {prose()} 4111111111111111 {prose()}' for k in keys]
    texts += OPEN[:6]
    docs = documents(texts)
    rows = personal.personal_data(docs, personal.fit(docs)).collect()
    found = [[(x.kind, text[x.start : x.end]) for x in r.found if not x.base] for r, text in zip(rows, texts)]
    missed = [k for k, f in zip(keys, found) if ("secret", k) not in f]
    assert not missed


def test_plain_prose_opens_no_window():
    text = "He looked at the dot on the wall, at the key of the house, and at 10 to 9 went home at last. " * 40
    assert not personal.open_marks("At the end he sat at home. " * 50, []) and not personal.windows("at", [])
    assert len(personal.open_marks(text, [])) <= 40  # a dot near an at, and nothing else


def test_long_text_without_blanks():
    """Windows of one text share no place, and their number does not slow the search."""
    model = personal.SemiCrf({"hex": [0.0, 0, 0, 0, 0, 5.0], "mixed": [0.0, 0, 0, 0, 0, 5.0]})
    text = "".join("x" * 200 + "12345," for _ in range(2000))
    found = personal.windows(text, personal.open_marks(text, []))
    places = [t for w in found for t in w]
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
    spans = personal.all_spans("a1b2c3d4e5f6a7b8c9d0," * 3000, [], model)
    assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_held_out_secrets(spark, documents):
    """Trained on some texts, graded on others: planted secrets, and prose with numbers that are none."""
    source = random.Random(28)
    words = "the of and to in that is was for with at".split()
    prose = lambda: " ".join(source.choice(words) for _ in range(12))
    key = lambda: "".join(source.choice("0123456789abcdef") for _ in range(40))
    planted = lambda k: f'{prose()} token = "{k}" {prose()} +1 (415) 555-{source.randint(1000, 9999)} {prose()} a{source.randint(1, 99)}@mail.example.com {prose()} in {source.randint(1900, 2024)} {prose()}'
    model = personal.fit(documents([planted(key()) for _ in range(60)]))
    keys = [key() for _ in range(40)]
    texts = [planted(k) for k in keys] + [f"{prose()} {source.randint(100, 9999)} {prose()} 12 of 345 {prose()}" for _ in range(40)]
    rows = personal.personal_data(documents(texts), model).collect()
    added = [[texts[i][x.start : x.end] for x in r.found if not x.base] for i, r in enumerate(rows)]
    right = sum(k in a for k, a in zip(keys, added))
    assert right / len(keys) >= 0.9
    assert right / max(1, sum(map(len, added))) >= 0.9

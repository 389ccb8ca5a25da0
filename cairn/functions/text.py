"""String helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DASHES = "[–—]"


def plain_dashes(s: Column) -> Column:
    return F.regexp_replace(s, DASHES, "-")


def slug(s: Column) -> Column:
    """Region slug: lower case, blanks to hyphens, everything else dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+", "-"), "[^a-z0-9-]", "")


def file_slug(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", "-"))


def has_word(text: Column, word: str) -> Column:
    """Case-blind whole-word test with ASCII word edges."""
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def geo_center_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2fN, %.2fW", lat, F.abs(lon))


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(
        F.concat_ws("-", first.cast("string"), last.cast("string"))
    )


def grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct character grams of up to three, used as join keys for substring tests.

    The text is cut into characters once and shifted copies are zipped, so the
    cost grows with the length of the text and not with its square.
    """
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    rest = F.greatest(F.size(chars), F.lit(1))
    rows = F.arrays_zip(
        chars.alias("a"), F.slice(chars, F.lit(2), rest).alias("b"), F.slice(chars, F.lit(3), rest).alias("c")
    )
    of = {
        1: chars,
        2: F.transform(F.filter(rows, lambda r: r["b"].isNotNull()), lambda r: F.concat(r["a"], r["b"])),
        3: F.transform(F.filter(rows, lambda r: r["c"].isNotNull()), lambda r: F.concat(r["a"], r["b"], r["c"])),
    }
    return F.array_distinct(F.concat(*[of[n] for n in sizes]))

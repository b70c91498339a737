"""Book-number expressions: check digits, scans of free text, and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that find candidates.
SCAN10 = r"(?i)(?:ISBN(?:-10)?:?\s*)?(\d{1,5}[-\s]?\d{1,7}[-\s]?\d{1,7}[-\s]?[\dX])"
SCAN13 = r"(?i)(?:ISBN(?:-13)?:?\s*)?(97[89][-\s]?\d{1,5}[-\s]?\d{1,7}[-\s]?\d{1,7}[-\s]?\d)"
FROM_TEXT = {
    "isbn": r"(?i)isbn:([0-9X-]+)",
    "amazon": r"amazon:([A-Z0-9]+)",
    "goodreads": r"goodreads:(\d+)",
    "asin": r"\b(B[A-Z0-9]{9})\b",
    "isbn13": r"\b(97[89]\d{10})\b",
    "isbn10": r"\b(\d{9}[\dX])\b",
}


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[-\s]", "")


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), then), 1)


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def valid10(c: Column) -> Column:
    """Nine digits and a digit or capital X whose weighted sum is a multiple of 11; hyphens and spaces don't count."""
    total = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + (F.lit(11) - i) * F.when(_digit(s, i) == "X", 10).otherwise(_digit(s, i).try_cast("int")))
    return once(bare(c), lambda s: F.coalesce(F.when(s.rlike(r"^\d{9}[\dX]$"), total(s) % 11 == 0), F.lit(False)))


def valid13(c: Column) -> Column:
    total = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, 1).otherwise(3) * _digit(s, i).try_cast("int"))
    return once(bare(c), lambda s: F.coalesce(F.when(s.rlike(r"^97[89]\d{10}$"), total(s) % 10 == 0), F.lit(False)))


def valid(c: Column) -> Column:
    n = F.length
    return once(bare(c), lambda s: F.coalesce(F.when(n(s) == 10, valid10(s)).when(n(s) == 13, valid13(s)), F.lit(False)))


def extract(c: Column) -> Column:
    """All valid ten-digit numbers in order, then all valid thirteen-digit ones, bare; repeats stay; null gives none."""
    t = F.coalesce(c, F.lit(""))
    ten = F.filter(F.transform(F.regexp_extract_all(t, F.lit(SCAN10), F.lit(1)), bare), valid10)
    thirteen = F.filter(F.transform(F.regexp_extract_all(t, F.lit(SCAN13), F.lit(1)), bare), valid13)
    return F.concat(ten, thirteen)


def isbn13_of(key: Column) -> Column:
    """A valid thirteen-digit number made of 978, the key in nine digits, and the check digit."""
    s = F.concat(F.lit("978"), F.lpad(key.cast("string"), 9, "0"))
    total = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, 1).otherwise(3) * _digit(s, i).cast("int"))
    return once(s, lambda s: F.concat(s, ((F.lit(10) - total(s) % 10) % 10).cast("string")))


def first_match(c: Column, kind: str) -> Column:
    """The first identifier of a kind in free text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), FROM_TEXT[kind], 1), F.lit(""))


def pick_for_batch(isbn: Column, amazon: Column, title: Column) -> Column:
    """Stored numbers first, then what the title itself is."""
    return F.coalesce(
        F.when(F.coalesce(isbn, F.lit("")) != "", F.concat(F.lit("isbn:"), F.replace(isbn, F.lit("-")))),
        F.when(F.coalesce(amazon, F.lit("")) != "", F.concat(F.lit("amazon:"), amazon)),
        F.concat(F.lit("asin:"), first_match(title, "asin")),
        F.concat(F.lit("isbn:"), first_match(title, "isbn13")),
    )


def pick_for_tool(isbn: Column, amazon: Column, goodreads: Column, title: Column) -> Column:
    """What the title is first, then stored numbers."""
    return F.coalesce(
        F.concat(F.lit("asin:"), first_match(title, "asin")),
        F.concat(F.lit("isbn:"), first_match(title, "isbn13")),
        F.concat(F.lit("isbn:"), first_match(title, "isbn10")),
        F.concat(F.lit("amazon:"), F.nullif(amazon, F.lit(""))),
        F.concat(F.lit("isbn:"), F.nullif(isbn, F.lit(""))),
        F.concat(F.lit("goodreads:"), F.nullif(goodreads, F.lit(""))),
    )

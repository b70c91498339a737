"""Text expressions. All are plain Column functions; null stays null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Lower case, without punctuation, white space squeezed; null as ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


#: All characters but letters and white space, written out: the complement of a class is looked up far more slowly. White
#: space is that of SQL's engine, without the vertical tab; upper case is among the others once a text is lower-cased.
_CONTROLS, _BEYOND = r"\x00-\x08\x0b\x0e-\x1f", r"{-\x{10ffff}"
NOT_LETTERS, NOT_LOWER = rf"[{_CONTROLS}!-@\[-`{_BEYOND}]+", rf"[{_CONTROLS}!-`{_BEYOND}]+"


def letters_then_lower(c: Column) -> Column:
    """ASCII letters and white space only, lower case: other letters go before the case changes."""
    return F.lower(F.regexp_replace(c, NOT_LETTERS, ""))


def lower_then_letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOT_LOWER, "")


def alpha_only(c: Column) -> Column:
    """ASCII letters only, lower case. White space, of which there is some behind every word, goes without a pattern."""
    kept = lower_then_letters(c)
    for space in " \t\n\f\r":
        kept = F.replace(kept, F.lit(space), F.lit(""))
    return kept


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def spaced_tokens(c: Column) -> Column:
    """A space before each ASCII punctuation mark, then a line for each space-separated part."""
    return F.replace(F.regexp_replace(c, r"(\p{Punct})", " $1"), F.lit(" "), F.lit("\n"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def first_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def or_default(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def names_from_sort(c: Column) -> Column:
    """'Last, First & Last, First' as 'First Last & First Last'; a name without a comma stays; null and '' give ''."""

    def turn(name: Column) -> Column:
        last, first = F.trim(F.substring_index(name, ",", 1)), F.trim(F.regexp_replace(name, "^[^,]*,?", ""))
        return F.when(name.contains(","), F.when(first == "", last).otherwise(F.concat(first, F.lit(" "), last))).otherwise(F.trim(name))

    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), " & "), turn), " & ")


def labelled_parts(parts: dict[str, Column], sep: str = " | ") -> Column:
    """'Label: value' of each part that isn't empty, joined."""
    return F.concat_ws(sep, *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])


def stars(c: Column, most: int = 5) -> Column:
    return F.concat(F.repeat(F.lit("★"), c), F.repeat(F.lit("☆"), F.lit(most) - c))


def char_ngrams(c: Column, n: int) -> Column:
    """All runs of n characters, in one scan of the text; shorter texts have none."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def subwords(c: Column, low: int = 3, high: int = 6) -> Column:
    """Character runs of the word in angle brackets, shortest first."""
    marked = F.concat(F.lit("<"), c, F.lit(">"))
    return F.flatten(F.array(*[char_ngrams(marked, n) for n in range(low, high + 1)]))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", "_"))


def camel_case(c: Column) -> Column:
    parts = F.split(F.trim(F.lower(c)), r"\s+")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")


def field_value(line: Column) -> tuple[Column, Column]:
    """Key and value of a 'Key : value' line, parted at the first colon."""
    return F.trim(F.substring_index(line, ":", 1)), F.trim(F.regexp_replace(line, "^[^:]*:", ""))


def sentences(c: Column) -> Column:
    """Parts that end with a run of stops before white space, trimmed; empty ones are left out."""
    parts = F.split(F.regexp_replace(c, r"([.!?]+)\s+", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Words, with what follows an apostrophe, and single marks."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*|[^\p{L}\p{N}\s]"), F.lit(0))


#: Prompts by name: the text, and what stands for arguments that aren't given; others are required.
PROMPTS: dict[str, tuple[str, dict[str, str]]] = {
    "analyze-menu": ("Menu: {menu}\nFocus: {focus}", {"focus": "all"}),
    "translate-order": ('Order: "{order}"', {}),
    "recommend-dish": ("Wanted: {preference}\nBudget: {budget}", {"budget": "medium"}),
    "explain-dish": ("Dish: {dish}", {}),
}


def filled(name: Column, arguments: Column, prompts: dict[str, tuple[str, dict[str, str]]] = PROMPTS) -> Column:
    """The named prompt with its arguments, a map of strings, filled in; an unknown name, or a missing argument, is an error."""
    out = None
    for key, (text, defaults) in prompts.items():
        parts: list[Column] = []
        for k, piece in enumerate(re.split(r"\{(\w+)\}", text)):
            if k % 2:
                given = F.try_element_at(arguments, F.lit(piece))
                parts.append(F.coalesce(given, F.lit(defaults[piece]) if piece in defaults else F.raise_error(F.lit(f"{key} needs {piece}")).cast("string")))
            elif piece:
                parts.append(F.lit(piece))
        out = F.when(name == key, F.concat(*parts)) if out is None else out.when(name == key, F.concat(*parts))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown prompt: "), F.coalesce(name, F.lit("null")))).cast("string"))


def menu_items(menus: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, section, item, price) of the 'item - ¥price' lines of a menu; a line in 【】 begins a section, 無料 costs 0."""
    parts = menus.select(key, F.explode(F.split(text, r"\n\s*(?=【)")).alias("part"))
    rows = parts.select(key, F.regexp_extract("part", r"^\s*(【[^】\n]*】)", 1).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    item, price = (F.regexp_extract(F.trim("line"), r"^(.*) - (\S+)$", k) for k in (1, 2))
    yen = F.when(price == "無料", 0).otherwise(F.regexp_replace(price, "[¥,]", "").try_cast("int"))
    return rows.filter(item != "").select(key, "section", item.alias("item"), yen.alias("price"))


def escaped(c: Column) -> Column:
    """Text as it stands in XML."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def opf(title: Column, authors: Column, publisher: Column, isbn: Column) -> Column:
    """A metadata record as XML; what is missing has no element."""
    element = lambda name, c, more="": F.coalesce(F.concat(F.lit(f"<dc:{name}{more}>"), escaped(c), F.lit(f"</dc:{name}>")), F.lit(""))
    creators = F.array_join(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda x: element("creator", x)), "")
    return F.concat(F.lit('<?xml version="1.0"?>\n<package><metadata>'), element("title", title), creators, element("publisher", publisher), element("identifier", isbn, ' scheme="isbn"'), F.lit("</metadata></package>"))

"""Text cleaning, tokens, phrases, identifiers and hashes, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
# Words left out of keywords beside the stop words, and of phrases.
STOP_WORDS = ("the", "of", "and", "in", "to", "for", "a", "an", "on", "by", "with", "or", "at", "from", "is", "are", "as", "be", "was", "were", "that", "this", "it", "not")
RESERVED_WORDS = ("estimate", "total", "universe")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def lower_of(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def keywords(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct alphabetic tokens of three letters or more, in order, without stop words and reserved words."""
    words = F.filter(tokens(text), lambda t: t.rlike("^[a-z]+$") & (F.length(t) > 2) & ~t.isin(*stop, *RESERVED_WORDS))
    return F.array_distinct(words)


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by blanks."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags dropped, common entities resolved, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeezed(entities(F.regexp_replace(bare, r"<[^>]+>", " ")))


def html_stripped(html: Column) -> Column:
    """Every tag as a blank, entities resolved, white space kept."""
    return entities(F.regexp_replace(html, r"<[^>]+>", " "))


def markdown_text(text: Column) -> Column:
    """Visible text of Markdown: marks of headings, quotes, lists, fences, rules, emphasis and code dropped, links as their words, images as nothing; white space collapsed."""
    for mark, kept in (
        (r"(?m)^[ \t]*(```|~~~).*$", " "), (r"(?m)^[ \t]*([-*_][ \t]*){3,}$", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^[ \t]*(#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|[0-9]+\.[ \t]+)", ""), (r"\*\*|__|`", ""), (r"\*([^*\n]+)\*", "$1"),
    ):
        text = F.regexp_replace(text, mark, kept)
    return squeezed(entities(F.regexp_replace(text, r"<[^>]+>", " ")))


def entities(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def table_id(variable: Column) -> Column:
    return F.when(variable.contains("_"), F.substring_index(variable, "_", 1)).otherwise(F.substring(variable, 1, 6))


def table_family(variable: Column) -> Column:
    return F.when(F.length(variable) >= 3, F.substring(variable, 1, 3)).otherwise("OTHER")


def is_base_table(table: Column) -> Column:
    return table.rlike("[0-9]$")


def compound_key(flavor: Column, year: Column, variable: Column) -> Column:
    return F.concat_ws("_", flavor, year.cast("string"), variable)


def slug(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_ \t\r\n]", "")
    return F.regexp_replace(F.regexp_replace(clean, r"[_ \t\r\n]+", "_"), "^_+|_+$", "")


def chunk_id(stem: Column, path: Column, number: Column, text: Column) -> Column:
    return F.concat_ws("_", stem, F.substring(F.md5(path), 1, 6), number.cast("string"), F.substring(F.md5(text), 1, 8))


def camel_id(text: Column, most: int = 50) -> Column:
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.substring(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200)))), ""), 1, most)


def turtle_string(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(text.rlike('[\n"]'), F.concat(F.lit('"""'), plain, F.lit('"""'))).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def phrases(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[:;/\n]+"), lambda x: F.trim(x)), lambda p: p != "")


def fenced_json(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"```(?:json)?[ \t\r\n]*((?s:.*?))[ \t\r\n]*```", 1), F.lit(""))


def repaired_json(text: Column) -> Column:
    """A JSON object from a model's answer: as it is, from a fence, from the outer braces, without trailing commas; or null."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    mended = F.regexp_replace(F.regexp_replace(inner, r",([ \t\r\n]*[}\]])", "$1"), "'", '"')
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(text), valid(fenced_json(text)), valid(inner), valid(mended))


def first_filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def weight_summary(pairs: Column) -> Column:
    """`name: 0.12` of an array of (key, value), joined by commas."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(": ", p["key"], F.format_string("%.2f", p["value"]))), ", ")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)

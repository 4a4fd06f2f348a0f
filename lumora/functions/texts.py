"""Text expressions: cleaning, tokens, type normalisation and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted text types, the aliases that stand for them, and tags that say nothing.
TEXT_TYPES = ("ocr", "subtitle_ocr", "asr", "manual_text", "document_text")
TEXT_TYPE_ALIASES = {"subtitle": "subtitle_ocr", "subtitles": "subtitle_ocr", "document": "document_text", "doc": "document_text", "speech": "asr", "audio": "asr", "whisper": "asr"}
JUNK_TAGS = ("none", "null", "undefined", "image", "photo")


def clean_text(text: Column, limit: int = 2000) -> Column:
    """White space (also beyond ASCII) becomes one space, three or more equal marks become one."""
    spaced = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(F.regexp_replace(spaced, r"(?U)([^\w\s])\1{2,}", "$1"), 1, limit)


def clean_document_text(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_unescape(text: Column) -> Column:
    """Five entities, the ampersand first, so that a doubly escaped mark is decoded twice."""
    for entity, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def strip_tags(html: Column) -> Column:
    """Tags go without a trace, so what stands around them moves together; then entities are decoded."""
    return html_unescape(F.regexp_replace(html, "<[^>]+>", ""))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_-]{2,})"), 1)


def cjk_runs(text: Column, most: int = 20) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1), 1, most)


def normalize_text_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ({t: t for t in TEXT_TYPES} | TEXT_TYPE_ALIASES).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(kind, F.lit(""))))), F.lit("ocr"))


def split_engine(engine: Column) -> tuple[Column, Column]:
    """`type:engine` -> text type and engine; without a colon all of it is the engine. Any type but the five is ocr: aliases
    are for input, what is stored has none."""
    parts = F.split(F.coalesce(engine, F.lit("")), ":", 2)
    typed = F.size(parts) == 2
    name = F.trim(F.when(typed, F.get(parts, F.lit(1))).otherwise(parts[0]))
    kind = F.lower(F.trim(parts[0]))
    return F.when(typed & kind.isin(*TEXT_TYPES), kind).otherwise("ocr"), F.when(name == "", "unknown").otherwise(name)


def compact_text(text: Column, limit: int = 260, least: int = 90) -> Column:
    """At most `limit` characters, up to the last sentence end at or after place `least` (from 0), else cut with dots behind it."""
    plain = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    head = F.substring(plain, 1, limit)
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.。!?])", 1))
    ended = stop - 1 >= least
    return F.when(F.length(plain) <= limit, plain).when(ended, F.substring(head, F.lit(1), stop)).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def is_useful_tag(tag: Column) -> Column:
    return F.length(tag).between(2, 40) & ~tag.isin(*JUNK_TAGS)


def zero_filled(number: Column, width: int) -> Column:
    """Zeros before a number up to `width` characters; a longer one stays whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def unique_texts(texts: Column) -> Column:
    """An array of texts cleaned, without blanks and without those that equal an earlier one but for case, joined by spaces."""
    cleaned = F.filter(F.transform(texts, lambda t: clean_text(t)), lambda t: t != "")
    lower = F.transform(cleaned, F.lower)
    first = F.filter(cleaned, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)
    return F.array_join(first, " ")

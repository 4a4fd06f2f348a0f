"""Expressions over names, numbers and short codes: normal forms, safe filenames, person ids, search reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.functions.texts import zero_filled

#: The libraries.
LIBRARIES = ("public", "personal")


def _plain(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def normalize_library(value: Column) -> Column:
    """One of the libraries; anything else is public."""
    plain = _plain(value)
    return F.when(plain.isin(*LIBRARIES), plain).otherwise("public")


def normalize_library_filter(value: Column) -> Column:
    plain = _plain(value)
    return F.when(plain.isin("all", *LIBRARIES), plain).otherwise("all")


def bounded_int(value: Column, default: int, low: int, high: int) -> Column:
    """A whole number within bounds; `default` where the text is none."""
    number = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("decimal(38,0)"))
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high))).cast("long")


def stem_of(name: Column) -> Column:
    """The last part of a path without its suffix. A dot at either end of the part starts no suffix."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]+$", "")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=[^.])(\.[^.]+)$", 1))


def safe_filename(name: Column) -> Column:
    stem = F.trim(F.regexp_replace(stem_of(name), r"[^0-9A-Za-z\x{4e00}-\x{9fff}_-]+", "_"), F.lit("_"))
    return F.concat(F.when(stem == "", "asset").otherwise(stem), suffix_of(name))


def person_id(value: Column) -> Column:
    """`person_N` of the first person that a text names, N of four digits or more; the text itself where it names none."""
    number = F.regexp_extract(value, r"(?i)person[_-]?(\d+)", 1)
    return F.when(number == "", value).otherwise(F.concat(F.lit("person_"), zero_filled(number, 4)))


def relation_prompt(relation: Column) -> Column:
    """A relation in words: person numbers without zeros, left of, right of."""
    words = F.regexp_replace(relation, r"(?i)person[_-]?0*(\d+)", "person $1")
    return F.replace(F.replace(words, F.lit("left_of"), F.lit("left of")), F.lit("right_of"), F.lit("right of"))


def person_relation(relation: Column) -> Column:
    """struct(subject, predicate, target) of a relation between two persons, else null."""
    shape = r"(?i)^person[_-]?(\d+)\s+(.+?)\s+person[_-]?(\d+)$"
    text = F.trim(relation)
    part = [F.regexp_extract(text, shape, k) for k in (1, 2, 3)]
    ids = [F.concat(F.lit("person_"), zero_filled(part[k], 4)) for k in (0, 2)]
    return F.when(text.rlike(shape), F.struct(ids[0].alias("subject"), F.trim(part[1]).alias("predicate"), ids[1].alias("target")))


def containing(words: tuple[str, ...], text: Column) -> Column:
    """Those of `words` that a text contains, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def title_score(title: Column, mime: Column, preferred: tuple[str, ...]) -> Column:
    return 3 * F.size(containing(preferred, title)) + F.when(F.contains(mime, F.lit("webm")), 1).otherwise(0)


def usable_candidate(title: Column, mime: Column, url: Column, size: Column, blocked: tuple[str, ...], mimes: tuple[str, ...], suffixes: tuple[str, ...], max_mb: float) -> Column:
    path = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    return (F.size(containing(blocked, title)) == 0) & mime.isin(*mimes) & suffix_of(path).isin(*suffixes) & (size > 0) & (size <= max_mb * 1024 * 1024)


def strong_result(display: Column, tag_hits: Column, text_hits: Column, metadata_hits: Column, filename: Column) -> Column:
    return (display >= 0.72) | (F.size(tag_hits) > 0) | (F.size(text_hits) > 0) | (F.size(metadata_hits) > 0) | (filename >= 0.5)


def reasons(clip: Column, prompt: Column, tag_hits: Column, relation_hits: Column, text_hits: Column, metadata_hits: Column, filename: Column) -> Column:
    """Why a row was found: at most four reasons, in a fixed order."""

    def listed(name: str, hits: Column, most: int) -> Column:
        return F.when(F.size(hits) > 0, F.concat(F.lit(name + ": "), F.array_join(F.slice(hits, 1, most), ", ")))

    seen = F.when(prompt.startswith("tag:"), F.concat(F.lit("tag recall: "), F.substring(prompt, F.lit(5), F.length(prompt)))).otherwise(F.concat(F.lit("looks like: "), prompt))
    every = [F.when(clip >= 0.18, seen), listed("tags", tag_hits, 5), listed("relations", relation_hits, 3), listed("texts", text_hits, 5), listed("metadata", metadata_hits, 5), F.when(filename >= 0.5, "filename")]
    found = F.slice(F.array_compact(F.array(*every)), 1, 4)
    return F.when(F.size(found) == 0, F.array(F.lit("overall likeness"))).otherwise(found)


def share_of_terms(hits: Column, terms: Column) -> Column:
    return F.least(F.size(hits) / F.greatest(F.size(terms), F.lit(1)), F.lit(1.0))


def tag_hits(tags: Column, terms: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform(tags, lambda t: F.lower(t)), terms)))


def text_hits(text: Column, terms: Column) -> Column:
    """Terms of two characters or more that a text contains."""
    return F.array_sort(F.filter(terms, lambda t: (F.length(t) >= 2) & F.contains(F.lower(text), t)))


def padded_crop(box: list[Column], width: Column, height: Column) -> list[Column]:
    """A box (x1, y1, x2, y2) widened by 18 % and heightened by 22 % on each side, within the image."""
    x1, y1, x2, y2 = box
    x, y = F.floor((x2 - x1) * 0.18), F.floor((y2 - y1) * 0.22)
    return [F.greatest(x1 - x, F.lit(0)), F.greatest(y1 - y, F.lit(0)), F.least(x2 + x, width), F.least(y2 + y, height)]


def area_quality(box: list[Column], width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = box
    return F.least(F.greatest(F.greatest((x2 - x1) * (y2 - y1), F.lit(1)) / F.greatest(width * height, F.lit(1)) * 18.0, F.lit(0.05)), F.lit(1.0))

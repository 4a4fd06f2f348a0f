"""Scoring expressions of search, rules and boxes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The weights of each ranking profile.
PROFILES = {
    "clip_only": {"clip": 1.0},
    "clip_tags": {"clip": 0.82, "tag": 0.18},
    "full": {"clip": 0.63, "tag": 0.14, "metadata": 0.06, "filename": 0.09, "ocr": 0.03, "relation": 0.05},
}
SEASONS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11), "winter": (12, 1, 2)}


def weighted(features: dict[str, Column], profile: str = "full") -> Column:
    weights = PROFILES.get(profile, PROFILES["full"])
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.coalesce(features.get(name, F.lit(0.0)), F.lit(0.0)) * weight
    return out


def display_score(score: Column, query: str, rank: Column) -> Column:
    """Spread over the scores of all candidates of a query and the rank from 0; at most 0.98."""
    every = Window.partitionBy(query)
    return display_in(score, F.min(score).over(every), F.max(score).over(every), rank)


def display_in(score: Column, low: Column, high: Column, rank: Column) -> Column:
    relative = F.try_divide(score - low, F.greatest(high - low, F.lit(1e-6)))
    raw = F.lit(0.55) + 0.35 * relative + 0.10 * F.greatest(F.lit(0.0), 1 - 0.035 * rank)
    return F.round(F.least(F.lit(0.98), raw), 4)


def margin_score(margin: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (margin + 0.03) / 0.11))


def metadata_match(created: Column, year: Column, months: Column) -> Column:
    """The share of the expected year and season that the date meets; 0 where nothing is expected."""
    expected = F.when(year.isNotNull(), 1).otherwise(0) + F.when(months.isNotNull(), 1).otherwise(0)
    met = F.when(F.coalesce(F.year(created) == year, F.lit(False)), 1).otherwise(0)
    met = met + F.when(F.coalesce(F.array_contains(months, F.month(created)), F.lit(False)), 1).otherwise(0)
    return F.coalesce(F.try_divide(met, expected), F.lit(0.0))


def query_quality(text: Column, signals: Column) -> Column:
    long = F.when(F.length(text) >= 4, 10).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.least(F.lit(100), 28 + 14 * signals + long))


def query_level(text: Column, score: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").otherwise(grade(score, 76, 52))


def grade(score: Column, good: int, medium: int) -> Column:
    return F.when(score >= good, "good").when(score >= medium, "medium").otherwise("weak")


def asset_health(n_tags: Column, archived: Column, video_without_text: Column, people_without_faces: Column, min_side: Column, favorite: Column) -> Column:
    def lose(flag, points):
        return F.when(flag, points).otherwise(0)

    raw = 100 - lose(n_tags <= 3, 18) - lose(~archived, 10) - lose(video_without_text, 24) - lose(people_without_faces, 14) - lose(min_side < 320, 12) + lose(favorite, 4)
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def archive_confidence(n_signals: Column) -> Column:
    return F.when(n_signals == 0, 0.0).otherwise(F.least(F.lit(0.94), 0.28 + 0.22 * n_signals))


def overlap(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Intersection over union, and over the smaller box, of boxes (x, y, width, height)."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    inter, areas = w * h, (a[2] * a[3], b[2] * b[3])
    return (F.coalesce(F.try_divide(inter, areas[0] + areas[1] - inter), F.lit(0.0)), F.coalesce(F.try_divide(inter, F.least(*areas)), F.lit(0.0)))


def box_relation(predicate: str, a: list[Column], b: list[Column]) -> Column:
    """Whether boxes (x1, y1, x2, y2) are in a relation: their centres differ by more than max(0.08 * (sqrt areas), 6)."""
    areas = [F.greatest((c[2] - c[0]) * (c[3] - c[1]), F.lit(1.0)) for c in (a, b)]
    tolerance = F.greatest(0.08 * (F.sqrt(areas[0]) + F.sqrt(areas[1])), F.lit(6.0))
    dx, dy = (b[0] + b[2]) / 2 - (a[0] + a[2]) / 2, (b[1] + b[3]) / 2 - (a[1] + a[3]) / 2
    relations = {
        "left_of": dx > tolerance,
        "right_of": -dx > tolerance,
        "above": dy > tolerance,
        "under": -dy > tolerance,
        "inside": (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3]),
        "beside": F.abs(dx) > tolerance,
    }
    return relations.get({"on": "above", "below": "under"}.get(predicate, predicate), F.lit(False))

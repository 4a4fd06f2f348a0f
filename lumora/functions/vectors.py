"""Vector expressions over array columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """A zero vector stays as it is. The norm is bound once, not once for each element."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))
    return scaled[0]


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Words of the lite text vector and what they stand for: red, green and blue; then brightness (place 29),
#: complexity (places 30 to 32) and aspect (place 33).
LITE_COLOURS = (
    (("红", "red", "晚霞", "夕阳", "火"), (0.9, 0.2, 0.15)),
    (("绿", "green", "草地", "森林", "树"), (0.2, 0.75, 0.25)),
    (("蓝", "blue", "天空", "海", "湖", "水"), (0.2, 0.35, 0.9)),
    (("白", "white", "雪", "冬天", "冬季"), (0.9, 0.9, 0.85)),
    (("黑", "black", "夜晚", "夜景"), (0.08, 0.08, 0.1)),
    (("黄", "yellow", "金色", "阳光"), (0.9, 0.75, 0.2)),
)
LITE_SIGNS = (
    (("明亮", "晴天", "阳光", "白天"), (29,), 1.0),
    (("暗", "夜晚", "夜景", "黑"), (29,), -0.5),
    (("复杂", "建筑", "城市", "街道", "人群"), (30, 31, 32), 0.8),
    (("横屏", "风景", "全景"), (33,), 0.7),
    (("竖屏", "自拍", "人像"), (33,), -0.7),
)


def lite_text_vector(text: Column) -> Column:
    """A unit vector of 34 places from the colours and signs that a text names; grey where it names none."""
    lower = F.lower(F.coalesce(text, F.lit("")))

    def named(words):
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))

    places = [F.lit(0.0)] * 34
    for words, rgb in LITE_COLOURS:
        for k, x in enumerate(rgb):
            places[k] = places[k] + F.when(named(words), x).otherwise(0.0)
    for words, at, x in LITE_SIGNS:
        for k in at:
            places[k] = places[k] + F.when(named(words), x).otherwise(0.0)
    grey = [0.5] * 3 + [0.0] * 26 + [0.3] * 4 + [0.0]
    raw = F.array(*places)
    return normalize(F.when(F.exists(raw, lambda x: x != 0), raw).otherwise(F.array(*[F.lit(x) for x in grey])))

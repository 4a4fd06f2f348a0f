"""Tag operators: upserts with provenance, facets, fusion, zero-shot tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.texts import ascii_tokens, is_useful_tag

FUSED_MOST, TEXT_MOST = 40, 30


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot: rows of `new` replace rows of `old` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_source(edges: DataFrame, new: DataFrame) -> DataFrame:
    """All tags that an asset has from a source give way to the new ones of that source, once for each source."""
    return edges.join(new.select("asset_id", "source").distinct(), ["asset_id", "source"], "left_anti").unionByName(new)


def facets(edges: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """tag, asset_count, sources of edges that name each asset, tag and source once: two aggregations of counts. Where sources
    are several, an asset that has a tag from more than one of them must count once, so only such tags are told apart."""
    shown = edges.filter(~F.col("tag").isin(*hidden)) if hidden else edges
    counts = shown.groupBy("tag", "source").agg(F.count("*").alias("n"))
    by_tag = counts.groupBy("tag").agg(F.sum("n").alias("asset_count"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.count("*").alias("_s"))
    several = by_tag.filter("_s > 1").select("tag")
    exact = shown.join(several, "tag").groupBy("tag", "asset_id").agg(F.lit(1).alias("one")).groupBy("tag").agg(F.count("*").alias("exact"))
    return by_tag.join(exact, "tag", "left").select("tag", F.coalesce("exact", "asset_count").alias("asset_count"), "sources")


def text_tags(texts: DataFrame, stop: tuple[str, ...] = (), most: int = TEXT_MOST) -> DataFrame:
    """The `most` frequent tokens of each text (asset_id, text), ties by first occurrence."""
    tokens = texts.select("asset_id", F.posexplode(ascii_tokens(F.col("text"))).alias("pos", "tag"))
    counts = tokens.filter(~F.col("tag").isin(*stop)) if stop else tokens
    counts = counts.groupBy("asset_id", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("asset_id").orderBy(F.desc("n"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def fuse(edges: DataFrame, most: int = FUSED_MOST) -> DataFrame:
    """asset_id and its useful tags over all sources but fusion itself, the first `most` by alphabet."""
    useful = edges.filter((F.col("source") != "fusion") & is_useful_tag(F.col("tag")))
    return useful.groupBy("asset_id").agg(F.slice(F.array_sort(F.collect_set("tag")), 1, most).alias("tags"))


def within_margin(scored: DataFrame, k: int, least: float, margin: float) -> DataFrame:
    """Of (asset_id, tag, score) the k best of each asset that reach `least` and lie within `margin` of the best."""
    order = Window.partitionBy("asset_id").orderBy(F.desc("score"), F.desc("tag"))
    best = F.max("score").over(Window.partitionBy("asset_id"))
    ranked = scored.withColumns({"rank": F.row_number().over(order), "best": best})
    return ranked.filter((F.col("rank") <= k) & (F.col("score") >= least) & (F.col("score") >= F.col("best") - margin)).drop("best")

"""Search for a whole table of plans at once: recall, filters, features, fusion and display, without a loop over queries.

plans and prompts as `planner.plan_rows` makes them, prompts with their unit vector `q`. assets: asset_id (which stands for
the order of the library), kind, library, filename, created and a unit vector `v`. tags: asset_id, tag. texts: asset_id, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions import names, scores
from lumora.functions.vectors import dot

TAG_SCORE, TAG_SCORE_BESIDE_RELATIONS = 0.32, 0.18


def _first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; Spark cuts each group before it is shuffled."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def _side(prompts: DataFrame, side: str) -> DataFrame:
    return prompts.filter(F.col("side") == side)


def recall(plans: DataFrame, prompts: DataFrame, assets: DataFrame, tags: DataFrame, most: int) -> DataFrame:
    """query_id, asset_id, clip, prompt: the best of each prompt's nearest assets and of the assets with a tag among the
    terms, the first prompt and the first term on ties; all assets for plans that find none of either."""
    asked = F.broadcast(_side(prompts, "query").select("query_id", "position", "prompt", "q"))
    pairs = assets.select("asset_id", "v").crossJoin(asked).select("query_id", "position", "prompt", "asset_id", dot(F.col("v"), F.col("q")).alias("clip"))
    near = _first(pairs, ["query_id", "position"], [F.desc("clip"), F.col("asset_id")], most)
    constant = F.when(F.size("relations") > 0, TAG_SCORE_BESIDE_RELATIONS).otherwise(TAG_SCORE)
    terms = F.broadcast(plans.select("query_id", constant.alias("clip"), F.explode("terms").alias("tag")))
    tagged = _first(tags.select("asset_id", "tag").distinct().join(terms, "tag"), ["query_id", "tag"], [F.desc("asset_id")], most)
    by_tag = tagged.select("query_id", F.lit(1 << 30).alias("position"), F.concat(F.lit("tag:"), "tag").alias("prompt"), "asset_id", "clip")
    best = F.min_by("prompt", F.struct(-F.col("clip"), F.col("position"), F.col("prompt")))
    every = near.unionByName(by_tag).groupBy("query_id", "asset_id").agg(F.max("clip").alias("clip"), best.alias("prompt"))
    return _first(every, ["query_id"], [F.desc("clip"), F.col("asset_id")], most)


def relation_margins(candidates: DataFrame, prompts: DataFrame, assets: DataFrame) -> DataFrame:
    """query_id, asset_id, margin: how much nearer an asset is to the relations asked for than to their contrasts. Only
    candidates are compared."""
    sides = F.broadcast(prompts.filter("side <> 'query'").select("query_id", "side", "q"))
    pairs = candidates.select("query_id", "asset_id").join(assets.select("asset_id", "v"), "asset_id").join(sides, "query_id")
    near = pairs.select("query_id", "asset_id", "side", dot(F.col("v"), F.col("q")).alias("s"))
    best = near.groupBy("query_id", "asset_id").agg(F.max(F.when(F.col("side") == "relation", F.col("s"))).alias("pos"), F.max(F.when(F.col("side") == "contrast", F.col("s"))).alias("neg"))
    return best.select("query_id", "asset_id", (F.col("pos") - F.coalesce("neg", "pos")).alias("margin"))


def _relation_score(prompt: Column) -> Column:
    """The margin's score, and more where the prompt that found the asset says the relation or all its words."""
    low = F.lower(prompt)
    said = F.exists("relations", lambda r: F.contains(low, F.lower(r)) | F.contains(low, F.lower(names.relation_prompt(r))))
    words = F.exists("relations", lambda r: (F.size(F.split(names.relation_prompt(r), " ")) >= 3) & F.forall(F.split(F.lower(names.relation_prompt(r)), " "), lambda w: F.contains(low, w)))
    base = scores.margin_score(F.coalesce("margin", F.lit(0.0)))
    more = F.when(said, 0.15).when(words, 0.08).otherwise(0.0)
    return F.when(F.size("relations") == 0, 0.0).otherwise(F.least(base + more, F.lit(1.0)))


def search(plans: DataFrame, prompts: DataFrame, assets: DataFrame, tags: DataFrame, texts: DataFrame, limit: int, profile: str = "full", geometry: DataFrame | None = None) -> DataFrame:
    """query_id, rank, asset_id, score, display, features and hits of the `limit` best assets of each plan.

    Filters on kind and library follow recall, as they always have; year and season only score. Scores are rounded before
    they rank, ties keep the order of recall, and display values span all candidates that the filters leave. `geometry`
    (query_id, asset_id) names assets whose faces stand in a relation that was asked for.
    """
    found = recall(plans, prompts, assets, tags, max(8 * limit, 64))
    facts = assets.select("asset_id", "kind", "library", "filename", "created")
    rows = found.join(facts, "asset_id").join(F.broadcast(plans.withColumnsRenamed({"kind": "asked_kind", "library": "asked_library"})), "query_id")
    rows = rows.filter("(asked_library = 'all' OR library = asked_library) AND (asked_kind IS NULL OR kind = asked_kind)")
    held = found.select("asset_id").distinct()
    lists = tags.join(held, "asset_id", "left_semi").groupBy("asset_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    said = texts.join(held, "asset_id", "left_semi").select("asset_id", F.col("text").alias("signal"))
    rows = rows.join(lists, "asset_id", "left").join(said, "asset_id", "left").join(relation_margins(found, prompts, assets), ["query_id", "asset_id"], "left")
    near = F.lit(False)
    if geometry is not None:
        rows = rows.join(geometry.select("query_id", "asset_id", F.lit(True).alias("near")), ["query_id", "asset_id"], "left")
        near = F.coalesce("near", F.lit(False))
    none = F.array().cast("array<string>")
    tag_hits = names.tag_hits(F.coalesce("tags", none), F.col("terms"))
    text_hits = names.text_hits(F.coalesce("signal", F.lit("")), F.col("terms"))
    filename = F.size(F.filter("tokens", lambda t: F.contains(F.lower("filename"), t))) / F.greatest(F.size("tokens"), F.lit(1))
    relation = F.greatest(_relation_score(F.col("prompt")), F.when(near, 1.0).otherwise(0.0))
    rows = rows.withColumns({"tag_hits": tag_hits, "text_hits": text_hits, "filename_score": filename, "relation_score": relation, "metadata_score": scores.metadata_match(F.col("created"), F.col("year"), F.col("months"))})
    rows = rows.withColumns({"tag_score": names.share_of_terms(F.col("tag_hits"), F.col("terms")), "text_score": names.share_of_terms(F.col("text_hits"), F.col("terms"))})
    features = {"clip": F.col("clip"), "tag": F.col("tag_score"), "metadata": F.col("metadata_score"), "filename": F.col("filename_score"), "ocr": F.col("text_score"), "relation": F.col("relation_score")}
    scored = rows.withColumn("score", F.round(scores.weighted(features, profile), 4))
    # No query has more than the recall limit of rows, so each window is small whatever the library.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("clip"), F.col("asset_id"))
    ranked = scored.withColumn("place", F.row_number().over(order) - 1)
    shown = ranked.withColumn("display", scores.display_score(F.col("score"), "query_id", F.col("place"))).filter(F.col("place") < limit)
    why = names.reasons(F.col("clip"), F.col("prompt"), F.col("tag_hits"), none, F.col("text_hits"), none, F.col("filename_score"))
    return shown.select(
        "query_id", (F.col("place") + 1).cast("long").alias("rank"), "asset_id", "score", "display", "prompt", F.round("clip", 4).alias("clip"), F.round("tag_score", 4).alias("tag_score"), "metadata_score",
        F.round("text_score", 4).alias("text_score"), F.round("filename_score", 4).alias("filename_score"), F.round("relation_score", 4).alias("relation_score"), "tag_hits", "text_hits", why.alias("reasons"),
    )

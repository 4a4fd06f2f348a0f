"""Assets and what hangs on them: tag edges, text signals, faces, archive rules and health, each for all assets at once.

assets: asset_id, kind, library, width, height and more. tags: asset_id, tag, source, confidence. signals: asset_id, id,
text_type, engine, text, confidence. faces: face_id, asset_id, person_id, quality. Mutations return new snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions import scores
from lumora.functions.texts import cjk_runs, is_useful_tag
from lumora.operators import graph
from lumora.operators import tags as tag_ops

#: Words that are no tags of a text.
TEXT_STOP_WORDS = (
    "about add after again all also and are because before being better between but can could did didn does done each every "
    "for far feel final from going good get got great had has have here how into just like lot many make more much not only "
    "out pretty over really seem sort that the their them then there they this time trying was were what when which with work "
    "would you your"
).split()
#: Chinese words that stand for an English tag.
TEXT_ALIASES = {"咖啡": "coffee", "美食": "food", "食物": "food", "风景": "landscape", "天空": "sky", "城市": "city", "街道": "street", "人物": "person"}
#: Tags that speak of people.
PEOPLE_TAGS = ("has_face", "person", "people", "portrait", "people_material", "portrait_material")
#: The rules' key, tests on tags, words looked for in texts, further tests, and the tags that they write.
SUBTITLE_TAGS = ("subtitle", "caption", "asr", "transcript")
TALK_TAGS = ("interview", "talk", "lecture", "presentation", "speaker", "conversation")
TALK_WORDS = ("interview", "speaker", "talk", "presentation", "lecture")
FOOD_TAGS = ("food", "meal", "coffee", "fruit", "pizza", "cake", "cooking")
NATURE_TAGS = ("landscape", "nature", "mountain", "ocean", "waterfall", "lake", "sky", "flower")
CITY_TAGS = ("city", "street", "building", "architecture", "traffic", "vehicle")
ARCHIVE_TAGS = {
    "archive_text_rich_video": ("archive:text-rich-video", "text_rich", "subtitle_material"),
    "archive_interview_talk": ("archive:interview-talk", "interview_material", "talking_head"),
    "archive_people": ("archive:people", "people_material", "portrait_material"),
    "archive_food": ("archive:food", "food_material"),
    "archive_nature": ("archive:nature", "nature_material", "landscape_material"),
    "archive_city": ("archive:city", "city_material", "urban_material"),
    "archive_review_needed": ("archive:review-needed", "needs_review"),
}
FUSED, FAVORITE, ARCHIVED, CLUSTERED = "fusion", "favorite", "auto_archive", "person_cluster"


def clean_edges(new: DataFrame) -> DataFrame:
    """Tags stripped and lower-cased, blanks left out, confidence within 0 and 1; of equal edges the most certain stays."""
    rows = new.select("asset_id", F.lower(F.trim("tag")).alias("tag"), "source", F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)).alias("confidence"))
    return rows.filter("tag <> ''").groupBy("asset_id", "tag", "source").agg(F.max("confidence").alias("confidence"))


def set_tags(edges: DataFrame, new: DataFrame, assets: DataFrame, replace_source: bool = False) -> DataFrame:
    """New edges of known assets are put over old ones of the same tag and source, or take the place of all of the source."""
    known = clean_edges(new).join(assets.select("asset_id"), "asset_id", "left_semi")
    return tag_ops.replace_source(edges, known) if replace_source else tag_ops.upsert(edges, known, ["asset_id", "tag", "source"])


def parse_tags(payloads: DataFrame, source: str, confidence: float) -> DataFrame:
    """Edges of (asset_id, payload): a JSON array of names and of objects {name, source, confidence}."""
    items = payloads.select("asset_id", F.explode(F.from_json("payload", "array<string>")).alias("item"))
    of = lambda key: F.when(F.startswith("item", F.lit("{")), F.get_json_object("item", f"$.{key}"))
    name = F.when(F.startswith("item", F.lit("{")), F.coalesce(of("name"), F.lit(""))).otherwise(F.col("item"))
    named = F.coalesce(F.nullif(F.trim(of("source")), F.lit("")), F.lit(source))
    return clean_edges(items.select("asset_id", name.alias("tag"), named.alias("source"), F.coalesce(of("confidence").try_cast("double"), F.lit(confidence)).alias("confidence")))


def tag_lists(edges: DataFrame) -> DataFrame:
    """asset_id and its distinct tags by alphabet."""
    return edges.groupBy("asset_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def with_flags(assets: DataFrame, edges: DataFrame, signals: DataFrame, faces: DataFrame) -> DataFrame:
    """`assets` with its tags, and how many signals and faces it has: one aggregate a side, no look-up for each asset."""
    by_asset = edges.groupBy("asset_id").agg(
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.coalesce(F.bool_or(F.col("source") == ARCHIVED), F.lit(False)).alias("archived"),
        F.coalesce(F.bool_or((F.col("source") == FAVORITE) & (F.col("tag") == FAVORITE)), F.lit(False)).alias("favorite"),
    )
    texts = signals.groupBy("asset_id").agg(F.count("*").alias("n_signals"))
    held = faces.groupBy("asset_id").agg(F.count("*").alias("n_faces"), F.array_sort(F.collect_set("person_id")).alias("persons"))
    rows = assets.join(by_asset, "asset_id", "left").join(texts, "asset_id", "left").join(held, "asset_id", "left")
    none = F.array().cast("array<string>")
    empty = {c: F.coalesce(c, none) for c in ("tags", "persons")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_signals", "n_faces")} | {c: F.coalesce(c, F.lit(False)) for c in ("archived", "favorite")}
    return rows.withColumns(empty)


def any_of(tags: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted]))


def health() -> Column:
    """The health of a row of `with_flags`, 0 to 100."""
    people = (F.col("kind") == "image") & (F.col("library") == "personal") & (F.col("n_faces") == 0) & any_of(F.col("tags"), PEOPLE_TAGS)
    silent = (F.col("kind") == "video") & (F.col("n_signals") == 0)
    return scores.asset_health(F.size("tags"), F.col("archived"), silent, people, F.least("width", "height"), F.col("favorite"))


def recommendations(flagged: DataFrame, limit: int = 6) -> DataFrame:
    """key, priority, n: what is to be done, for how many assets; what nothing is to be done for is left out."""
    scored = flagged.withColumn("health", health())
    tasks = {
        "video_text_signals": (92, (F.col("kind") == "video") & (F.col("n_signals") == 0)),
        "fusion_tags": (76, F.size("tags") <= 3),
        "archive_suggestions": (68, ~F.col("archived")),
        "personal_face_clusters": (64, (F.col("library") == "personal") & any_of(F.col("tags"), PEOPLE_TAGS) & (F.col("n_faces") == 0)),
        "weak_health_review": (58, F.col("health") < 60),
    }
    counted = scored.agg(*[F.count_if(test).alias(key) for key, (_, test) in tasks.items()])
    rows = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(priority).alias("priority"), F.col(key).alias("n")) for key, (priority, _) in tasks.items()])
    return counted.select(F.inline(rows)).filter("n > 0").orderBy(F.desc("priority")).limit(limit)


def archive_suggestions(flagged: DataFrame, signals: DataFrame, limit: int = 4) -> DataFrame:
    """asset_id, key, confidence, rank: the rules that an asset meets, the surest first, in the rules' order on ties; a review
    where it meets none."""
    words = F.bool_or(F.arrays_overlap(F.array(F.lit(True)), F.transform(F.array(*[F.lit(w) for w in TALK_WORDS]), lambda w: F.contains(F.lower("text"), w))))
    talked = signals.groupBy("asset_id").agg(words.alias("talked"))
    rows = flagged.join(talked, "asset_id", "left")
    tags, video = F.col("tags"), F.col("kind") == "video"
    rules = {
        "archive_text_rich_video": [video, F.col("n_signals") > 0, any_of(tags, SUBTITLE_TAGS)],
        "archive_interview_talk": [video, any_of(tags, TALK_TAGS), F.coalesce("talked", F.lit(False))],
        "archive_people": [F.col("n_faces") > 0, any_of(tags, ("has_face", "person", "people", "portrait")), F.col("library") == "personal"],
        "archive_food": [any_of(tags, FOOD_TAGS)],
        "archive_nature": [any_of(tags, NATURE_TAGS)],
        "archive_city": [any_of(tags, CITY_TAGS)],
    }
    met = [F.struct((-scores.archive_confidence(sum((s.cast("int") for s in signs), F.lit(0)))).alias("by"), F.lit(k).alias("place"), F.lit(key).alias("key")) for k, (key, signs) in enumerate(rules.items())]
    found = F.slice(F.array_sort(F.filter(F.array(*met), lambda r: r["by"] <= -0.34)), 1, limit)
    review = F.array(F.struct(F.lit(-0.32).alias("by"), F.lit(9).alias("place"), F.lit("archive_review_needed").alias("key")))
    ranked = rows.select("asset_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(review)).alias("rank", "r"))
    return ranked.select("asset_id", F.col("r.key").alias("key"), F.round(-F.col("r.by"), 4).alias("confidence"), (F.col("rank") + 1).alias("rank"))


def apply_suggestions(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The tags of the chosen suggestions (asset_id, key, confidence) take the place of earlier ones of automatic archiving."""
    written = F.create_map(*[x for key, names in ARCHIVE_TAGS.items() for x in (F.lit(key), F.array(*[F.lit(n) for n in names]))])
    new = chosen.select("asset_id", F.explode(F.try_element_at(written, F.col("key"))).alias("tag"), F.lit(ARCHIVED).alias("source"), "confidence")
    return tag_ops.replace_source(edges, clean_edges(new))


def set_favorite(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(asset_id, favorite) switches the favorite tag of each asset on or off."""
    rest = edges.join(marks.select("asset_id", F.lit(FAVORITE).alias("source")), ["asset_id", "source"], "left_anti")
    return rest.unionByName(marks.filter("favorite").select("asset_id", F.lit(FAVORITE).alias("tag"), F.lit(FAVORITE).alias("source"), F.lit(1.0).alias("confidence")))


def person_tags(faces: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of source person_cluster: has_face, the persons of each asset and their names (person_id, display_name, alias)."""
    held = faces.select("asset_id", "person_id").distinct().join(names, "person_id", "left")
    found = F.array_compact(F.array(F.lit("has_face"), F.col("person_id"), F.trim("display_name"), F.trim("alias")))
    return clean_edges(held.select("asset_id", F.explode(found).alias("tag"), F.lit(CLUSTERED).alias("source"), F.lit(0.9).alias("confidence")))


def signal_tags(texts: DataFrame) -> DataFrame:
    """(asset_id, tag) of texts (asset_id, text): the 30 commonest tokens but stop words and negations, the first 20 Chinese
    runs, and the tags that Chinese words stand for."""
    tokens = tag_ops.text_tags(texts, tuple(TEXT_STOP_WORDS)).select("asset_id", "tag")
    runs = texts.select("asset_id", F.explode(cjk_runs(F.col("text"))).alias("tag"))
    aliased = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(k)), v) for k, v in TEXT_ALIASES.items()]))
    return tokens.unionByName(runs).unionByName(texts.select("asset_id", F.explode(aliased).alias("tag"))).distinct()


def fuse_assets(assets: DataFrame, edges: DataFrame, texts: DataFrame, faces: DataFrame, most: int = 40) -> DataFrame:
    """asset_id, tags: all that is known of each asset but earlier fusions, useful tags only, the first `most` by alphabet."""
    own = F.array_compact(F.array("kind", "library", F.when(F.col("kind").isin("video", "image"), F.concat("kind", F.lit("_material")))))
    held = faces.select("asset_id", F.explode(F.array(F.lit("has_face"), F.col("person_id"))).alias("tag"))
    parts = [edges.filter(F.col("source") != FUSED).select("asset_id", F.lower(F.trim("tag")).alias("tag")), signal_tags(texts), assets.select("asset_id", F.explode(own).alias("tag")), held]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    useful = every.filter(is_useful_tag(F.col("tag"))).join(assets.select("asset_id"), "asset_id", "left_semi")
    return useful.groupBy("asset_id").agg(F.slice(F.array_sort(F.collect_set("tag")), 1, most).alias("tags"))


def signal_summary(signals: DataFrame, limit: int = 260) -> DataFrame:
    """Per asset and bucket (asr, visual, manual): how many signals, their engines in order and their joined text, cut."""
    from lumora.functions.texts import compact_text

    bucket = F.when(F.col("text_type") == "asr", "asr").when(F.col("text_type").isin("manual_text", "document_text"), "manual").otherwise("visual")
    parts = F.sort_array(F.collect_list(F.struct("id", "engine", "text")))
    grouped = signals.groupBy("asset_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), parts.alias("parts"))
    engines = F.array_distinct(F.filter(F.transform("parts", lambda p: p["engine"]), lambda e: e.isNotNull() & (e != "")))
    return grouped.select("asset_id", "bucket", "n", engines.alias("engines"), compact_text(F.array_join(F.transform("parts", lambda p: p["text"]), " "), limit).alias("summary"))


def accepted_signals(signals: DataFrame, least: float) -> DataFrame:
    """Signals whose cleaned text has two characters or more and whose confidence is unknown or `least` at the least."""
    from lumora.functions.texts import clean_text

    cleaned = signals.withColumn("text", clean_text(F.coalesce("text", F.lit(""))))
    return cleaned.filter((F.length("text") >= 2) & (F.col("confidence").isNull() | (F.col("confidence") >= least)))


def cleanup_signals(signals: DataFrame, engine: str, below: float) -> tuple[DataFrame, DataFrame]:
    """The signals left when an engine's unsure ones go, and the assets whose fusion is to be renewed. Unknown confidence stays."""
    gone = F.coalesce((F.col("engine") == engine) & (F.col("confidence") < below), F.lit(False))
    return signals.filter(~gone), signals.filter(gone).select("asset_id").distinct()


def person_rows(faces: DataFrame) -> DataFrame:
    """person_id, face_count, prototype (best quality, then face_id) and assets."""
    best = F.min_by("face_id", F.struct(-F.col("quality"), F.col("face_id")))
    return faces.groupBy("person_id").agg(F.count("*").alias("face_count"), best.alias("prototype"), F.array_sort(F.collect_set("asset_id")).alias("assets"))


def stable_persons(faces: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """The faces of persons with `least` faces or a name; all of them where one face suffices."""
    if least <= 1:
        return faces
    kept = faces.groupBy("person_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("person_id")
    return faces.join(kept.union(named.select("person_id")).distinct(), "person_id", "left_semi")


def renumbered(faces: DataFrame) -> DataFrame:
    """Persons are numbered anew in the order of their ids."""
    numbers = graph.numbered(faces.select("person_id").distinct(), [F.col("person_id")], "number")
    ids = numbers.select("person_id", F.format_string("person_%04d", "number").alias("new_id"))
    return faces.join(ids, "person_id").withColumn("person_id", F.col("new_id")).drop("new_id")


def normalized_faces(faces: DataFrame, least: float) -> DataFrame:
    """Faces of `least` quality and a box of four numbers, rounded half to even; one without an id is named by its asset and
    its place among those kept, in the order of `position`."""
    boxed = faces.filter(F.coalesce("quality", F.lit(0.0)) >= least).withColumn("bbox", F.transform(F.slice("bbox", 1, 4), lambda x: F.rint(x).cast("int")))
    kept = graph.numbered(boxed.filter(F.size("bbox") == 4), [F.col("position")], "number")
    own = F.concat(F.lit("face_"), F.col("asset_id").cast("string"), F.lit("_"), F.format_string("%04d", "number"))
    return kept.withColumn("face_id", F.coalesce(F.nullif("face_id", F.lit("")), own)).drop("number")


def geometric_relations(faces: DataFrame, subject: str, predicate: str, target: str) -> DataFrame:
    """Assets where any face of `subject` stands in a relation to any face of `target`; boxes are x1, y1, x2, y2."""
    box = ["x1", "y1", "x2", "y2"]
    a = faces.filter(F.col("person_id") == subject).select("asset_id", *[F.col(c).alias(f"a_{c}") for c in box])
    b = faces.filter(F.col("person_id") == target).select("asset_id", *box)
    near = scores.box_relation(predicate, [F.col(f"a_{c}") for c in box], [F.col(c) for c in box])
    return a.join(b, "asset_id").groupBy("asset_id").agg(F.bool_or(near).alias("holds")).filter("holds").select("asset_id")

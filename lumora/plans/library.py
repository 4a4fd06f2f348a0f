"""Registered queries over a whole media library: tags and their life cycle, signals, faces, archive, health and names.

As in the catalog, documents are assets and embeddings faces; conversations are text signals. Tags follow from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.functions import names, scores, vectors
from lumora.functions.texts import zero_filled
from lumora.operators import assets as ops
from lumora.operators import graph
from lumora.operators import tags as tag_ops
from lumora.plans.catalog import KIND, LIBRARY, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORDS = ("Person", " food ", "city", "nature", "interview", "subtitle", "sky", "portrait", "none", "has_face")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


MEDIA = f"media AS (SELECT doc_id AS asset_id, {KIND} AS kind, {LIBRARY} AS library, n_chars AS width, 100 + doc_id % 700 AS height, 'file_' || doc_id || '.' || lang AS filename, text FROM documents)"
RAW = f"""raw AS (SELECT doc_id AS asset_id, {_list(WORDS)}[doc_id % 10 + 1] AS tag, 'manual' AS source, (5 + doc_id % 5) / 10.0::DOUBLE AS confidence FROM documents
  UNION ALL SELECT doc_id, {_list(WORDS)}[doc_id // 10 % 10 + 1], 'upload', 0.82 FROM documents UNION ALL SELECT doc_id, 'favorite', 'favorite', 1.0 FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'archive:food', 'auto_archive', 0.5 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'old', 'fusion', 0.88 FROM documents WHERE doc_id % 4 = 0)"""
TAGS = f"{RAW}, tags AS (SELECT asset_id, lower(trim(tag)) AS tag, source, max(confidence) AS confidence FROM raw GROUP BY ALL)"
FACES = """faces AS (SELECT 'face_' || vec_id AS face_id, vec_id % 100 AS asset_id, 'person_' || lpad(label::VARCHAR, 4, '0') AS person_id, floor(abs(embedding[1]::DOUBLE) * 1000) / 1000 AS quality,
  (vec_id * 37 % 300)::DOUBLE AS x1, (vec_id * 53 % 200)::DOUBLE AS y1, (vec_id * 37 % 300 + 20 + vec_id % 60)::DOUBLE AS x2, (vec_id * 53 % 200 + 30 + vec_id % 40)::DOUBLE AS y2 FROM embeddings)"""
SIGNALS = """signals AS (SELECT conv_id AS asset_id, turn AS id, CASE role WHEN 'assistant' THEN 'asr' WHEN 'user' THEN 'manual_text' ELSE 'ocr' END AS text_type,
  CASE WHEN turn % 3 = 2 THEN '' ELSE 'e' || turn % 3 END AS engine, text, CASE WHEN turn % 4 > 0 THEN (turn % 10) / 10.0::DOUBLE END AS confidence FROM conversations)"""


def media(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS asset_id", f"{KIND} AS kind", f"{LIBRARY} AS library", "n_chars AS width", "100 + doc_id % 700 AS height", "concat('file_', doc_id, '.', lang) AS filename", "text")


def raw_tags(spark, sf_dir) -> DataFrame:
    words = "array(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
    edge = lambda tag, source, sure, when: f"if({when}, struct({tag} AS tag, '{source}' AS source, CAST({sure} AS DOUBLE) AS confidence), null)"
    edges = [
        edge(f"{words}[CAST(doc_id % 10 AS INT)]", "manual", "(5 + doc_id % 5) / 10D", "true"),
        edge(f"{words}[CAST(doc_id div 10 % 10 AS INT)]", "upload", "0.82D", "true"),
        edge("'favorite'", "favorite", "1D", "doc_id % 7 = 0"),
        edge("'archive:food'", "auto_archive", "0.5D", "doc_id % 3 = 0"),
        edge("'old'", "fusion", "0.88D", "doc_id % 4 = 0"),
    ]
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS asset_id", f"inline(array_compact(array({', '.join(edges)})))")


def tags(spark, sf_dir) -> DataFrame:
    return ops.clean_edges(raw_tags(spark, sf_dir))


def faces(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("face_"), "vec_id").alias("face_id"),
        (F.col("vec_id") % 100).alias("asset_id"),
        F.concat(F.lit("person_"), zero_filled(F.col("label"), 4)).alias("person_id"),
        (F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000) / 1000).alias("quality"),
        *[F.expr(f"CAST({x} AS DOUBLE)").alias(c) for c, x in (("x1", "vec_id * 37 % 300"), ("y1", "vec_id * 53 % 200"), ("x2", "vec_id * 37 % 300 + 20 + vec_id % 60"), ("y2", "vec_id * 53 % 200 + 30 + vec_id % 40"))],
    )


def signals(spark, sf_dir) -> DataFrame:
    kind = "CASE role WHEN 'assistant' THEN 'asr' WHEN 'user' THEN 'manual_text' ELSE 'ocr' END AS text_type"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS asset_id", "turn AS id", kind, "if(turn % 3 = 2, '', concat('e', turn % 3)) AS engine", "text", "if(turn % 4 > 0, (turn % 10) / 10D, null) AS confidence")


def flagged(spark, sf_dir) -> DataFrame:
    return ops.with_flags(media(spark, sf_dir), tags(spark, sf_dir), signals(spark, sf_dir), faces(spark, sf_dir))


PEOPLE = _list(ops.PEOPLE_TAGS)
FLAGGED = f"""{MEDIA}, {TAGS}, {FACES}, {SIGNALS},
  t AS (SELECT asset_id, list_sort(list(DISTINCT tag)) AS tags, bool_or(source = 'auto_archive') AS archived, bool_or(source = 'favorite' AND tag = 'favorite') AS favorite FROM tags GROUP BY 1),
  flagged AS (SELECT m.*, t.tags, t.archived, t.favorite, coalesce(s.n, 0) AS n_signals, coalesce(f.n, 0) AS n_faces FROM media m LEFT JOIN t USING (asset_id)
    LEFT JOIN (SELECT asset_id, count(*) AS n FROM signals GROUP BY 1) s USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) AS n FROM faces GROUP BY 1) f USING (asset_id)),
  healthy AS (SELECT *, greatest(0, least(100, 100 - 18 * (len(tags) <= 3)::INT - 10 * (NOT archived)::INT - 24 * (kind = 'video' AND n_signals = 0)::INT
    - 14 * (kind = 'image' AND library = 'personal' AND n_faces = 0 AND list_has_any(tags, {PEOPLE}))::INT - 12 * (least(width, height) < 320)::INT + 4 * favorite::INT)) AS health FROM flagged)"""


@query(f"""WITH {MEDIA}, {TAGS}, t AS (SELECT asset_id, list_sort(list(DISTINCT tag)) AS tags, bool_or(source = 'favorite') AS favorite FROM tags GROUP BY 1)
SELECT asset_id, favorite, array_to_string(tags[:8], ',') AS tags FROM media JOIN t USING (asset_id) WHERE library = 'public' ORDER BY asset_id DESC LIMIT 96""")
def library_list(spark, sf_dir):
    """The newest assets of a library first, with their first tags; the page is cut before anything is joined."""
    page = media(spark, sf_dir).filter("library = 'public'").orderBy(F.desc("asset_id")).limit(96).select("asset_id")
    held = tags(spark, sf_dir).join(F.broadcast(page), "asset_id")
    return held.groupBy("asset_id").agg(F.bool_or(F.col("source") == "favorite").alias("favorite"), F.array_join(F.slice(F.array_sort(F.collect_set("tag")), 1, 8), ",").alias("tags"))


@query(f"WITH {TAGS} SELECT asset_id, tag, source, row_number() OVER (PARTITION BY asset_id ORDER BY source, confidence DESC, tag) AS place FROM tags")
def tag_rows_in_order(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("source", (-F.col("confidence")).alias("by"), "tag")))
    listed = tags(spark, sf_dir).groupBy("asset_id").agg(rows.alias("rows")).select("asset_id", F.posexplode("rows").alias("k", "r"))
    return listed.select("asset_id", "r.tag", "r.source", (F.col("k") + 1).cast("long").alias("place"))


@query(f"WITH {TAGS} SELECT asset_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, bool_or(tag = 'sky' AND source = 'upload') AS has_sky, bool_or(tag IN ('has_face', 'person', 'people', 'portrait', 'people_material', 'portrait_material')) AS people FROM tags GROUP BY asset_id")
def tag_lists_and_flags(spark, sf_dir):
    by_asset = tags(spark, sf_dir).groupBy("asset_id").agg(F.array_sort(F.collect_set("tag")).alias("list"), F.bool_or((F.col("tag") == "sky") & (F.col("source") == "upload")).alias("has_sky"))
    return by_asset.select("asset_id", F.array_join("list", ",").alias("tags"), "has_sky", ops.any_of(F.col("list"), ops.PEOPLE_TAGS).alias("people"))


PAYLOAD = """'["  A' || doc_id % 3 || ' ", {"name": "B", "source": "api", "confidence": 1.7}, {"name": " "}, {"confidence": 0.4, "name": "c d"}, {"name": "B", "source": "api", "confidence": -1}]'"""


@query(f"""WITH p AS (SELECT doc_id AS asset_id, unnest(json_extract(({PAYLOAD})::JSON, '$[*]')) AS x FROM documents),
r AS (SELECT asset_id, lower(trim(CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.name') ELSE json_extract_string(x, '$') END)) AS tag,
  coalesce(CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.source') END, 'manual') AS source,
  greatest(0, least(1, coalesce(CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.confidence')::DOUBLE END, 0.7::DOUBLE))) AS confidence FROM p)
SELECT asset_id, tag, source, max(confidence) AS confidence FROM r WHERE tag <> '' GROUP BY ALL""")
def written_tags(spark, sf_dir):
    payload = F.concat(F.lit('["  A'), F.col("doc_id") % 3, F.lit(' ", {"name": "B", "source": "api", "confidence": 1.7}, {"name": " "}, {"confidence": 0.4, "name": "c d"}, {"name": "B", "source": "api", "confidence": -1}]'))
    return ops.parse_tags(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), payload.alias("payload")), "manual", 0.7)


NEW = "new AS (SELECT DISTINCT doc_id AS asset_id, CASE WHEN doc_id % 2 = 0 THEN 'sky' ELSE 'fresh' END AS tag, 'upload' AS source, 0.9::DOUBLE AS confidence FROM labels)"


def _new(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id AS asset_id", "if(doc_id % 2 = 0, ' Sky', 'fresh') AS tag", "'upload' AS source", "0.9D AS confidence")
    return rows.unionByName(spark.createDataFrame([(-5, "lost", "upload", 1.0)], "asset_id long, tag string, source string, confidence double"))


@query(f"WITH {TAGS}, {NEW} SELECT * FROM tags ANTI JOIN new USING (asset_id, tag, source) UNION ALL SELECT * FROM new")
def set_tags(spark, sf_dir):
    return ops.set_tags(tags(spark, sf_dir), _new(spark, sf_dir), media(spark, sf_dir))


@query(f"WITH {TAGS}, {NEW} SELECT * FROM tags ANTI JOIN new USING (asset_id, source) UNION ALL SELECT * FROM new")
def set_tags_of_source(spark, sf_dir):
    return ops.set_tags(tags(spark, sf_dir), _new(spark, sf_dir), media(spark, sf_dir), replace_source=True)


@query(f"WITH {TAGS} SELECT asset_id, tag, source FROM tags WHERE source <> 'fusion' AND NOT (source = 'upload' AND asset_id % 2 = 1)")
def delete_tags(spark, sf_dir):
    """Two deletes: a whole source, and a source of some assets."""
    some = media(spark, sf_dir).filter("asset_id % 2 = 1").select("asset_id", F.lit("upload").alias("source"))
    return tags(spark, sf_dir).filter("source <> 'fusion'").join(some, ["asset_id", "source"], "left_anti").select("asset_id", "tag", "source")


@query(f"WITH {TAGS} SELECT asset_id, tag, source FROM tags WHERE source <> 'favorite' OR asset_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'favorite', 'favorite' FROM labels WHERE quality = 1")
def favorite_switch(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), (F.col("quality") == 1).alias("favorite"))
    return ops.set_favorite(tags(spark, sf_dir), marks).select("asset_id", "tag", "source")


NAMES = "names AS (SELECT 'person_' || lpad((s_suppkey % 6)::VARCHAR, 4, '0') AS person_id, ' ' || s_name AS display_name FROM supplier WHERE s_suppkey < 6)"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_suppkey < 6").select(F.concat(F.lit("person_"), zero_filled(F.col("s_suppkey") % 6, 4)).alias("person_id"), F.concat(F.lit(" "), "s_name").alias("display_name"), F.lit(None).cast("string").alias("alias"))


@query(f"""WITH {FACES}, {NAMES}, h AS (SELECT DISTINCT asset_id, person_id FROM faces), x AS (SELECT asset_id, 'has_face' AS tag FROM h UNION SELECT asset_id, person_id FROM h UNION SELECT asset_id, lower(trim(display_name)) FROM h JOIN names USING (person_id))
SELECT asset_id, tag, 'person_cluster' AS source, 0.9::DOUBLE AS confidence FROM x""")
def person_cluster_tags(spark, sf_dir):
    return ops.person_tags(faces(spark, sf_dir), _names(spark, sf_dir))


@query(f"""WITH {MEDIA}, {TAGS}, {FACES}, {SIGNALS}, j AS (SELECT asset_id, string_agg(text, ' ' ORDER BY id DESC) AS text FROM signals GROUP BY 1),
w AS (SELECT asset_id, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM (SELECT asset_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}') AS l FROM j)),
c AS (SELECT asset_id, tag, count(*) AS n, min(pos) AS p FROM w WHERE tag NOT IN ({", ".join(f"'{x}'" for x in ops.TEXT_STOP_WORDS)}) GROUP BY ALL),
k AS (SELECT asset_id, tag FROM c QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, p) <= 30),
u AS (SELECT asset_id, tag FROM tags WHERE source <> 'fusion' UNION SELECT * FROM k UNION SELECT asset_id, unnest([kind, library]) FROM media UNION SELECT asset_id, kind || '_material' FROM media WHERE kind IN ('video', 'image')
  UNION SELECT asset_id, unnest(['has_face', person_id]) FROM faces)
SELECT asset_id, array_to_string(list_sort(list(DISTINCT tag))[:40], ',') AS tags FROM u SEMI JOIN media USING (asset_id) WHERE length(tag) BETWEEN 2 AND 40 AND tag NOT IN ('none', 'null', 'undefined', 'image', 'photo') GROUP BY 1""")
def fused_library(spark, sf_dir):
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text")), False), lambda s: s["text"]), " ")
    joined = signals(spark, sf_dir).groupBy("asset_id").agg(texts.alias("text"))
    return ops.fuse_assets(media(spark, sf_dir), tags(spark, sf_dir), joined, faces(spark, sf_dir)).select("asset_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {FLAGGED} SELECT asset_id, health, CASE WHEN health >= 82 THEN 'good' WHEN health >= 60 THEN 'medium' ELSE 'weak' END AS level FROM healthy")
def library_health(spark, sf_dir):
    return flagged(spark, sf_dir).withColumn("health", ops.health()).select("asset_id", "health", scores.grade(F.col("health"), 82, 60).alias("level"))


@query(f"""WITH {FLAGGED}, c AS (SELECT count(*) FILTER (WHERE kind = 'video' AND n_signals = 0) AS a, count(*) FILTER (WHERE len(tags) <= 3) AS b, count(*) FILTER (WHERE NOT archived) AS c,
  count(*) FILTER (WHERE library = 'personal' AND n_faces = 0 AND list_has_any(tags, {PEOPLE})) AS d, count(*) FILTER (WHERE health < 60) AS e FROM healthy)
SELECT * FROM (SELECT 'video_text_signals' AS key, 92 AS priority, a AS n FROM c UNION ALL SELECT 'fusion_tags', 76, b FROM c UNION ALL SELECT 'archive_suggestions', 68, c FROM c
  UNION ALL SELECT 'personal_face_clusters', 64, d FROM c UNION ALL SELECT 'weak_health_review', 58, e FROM c) WHERE n > 0""")
def agent_recommendations(spark, sf_dir):
    return ops.recommendations(flagged(spark, sf_dir))


def _rule(key: str, *signs: str) -> str:
    return f"SELECT asset_id, '{key}' AS key, {' + '.join(f'({s})::INT' for s in signs)} AS n FROM talking"


ARCHIVE = f"""{FLAGGED}, talking AS (SELECT *, asset_id IN (SELECT asset_id FROM signals WHERE regexp_matches(lower(text), '{"|".join(ops.TALK_WORDS)}')) AS talked FROM flagged),
rules AS ({" UNION ALL ".join((
    _rule("archive_text_rich_video", "kind = 'video'", "n_signals > 0", f"list_has_any(tags, {_list(ops.SUBTITLE_TAGS)})"),
    _rule("archive_interview_talk", "kind = 'video'", f"list_has_any(tags, {_list(ops.TALK_TAGS)})", "talked"),
    _rule("archive_people", "n_faces > 0", "list_has_any(tags, ['has_face', 'person', 'people', 'portrait'])", "library = 'personal'"),
    _rule("archive_food", f"list_has_any(tags, {_list(ops.FOOD_TAGS)})"), _rule("archive_nature", f"list_has_any(tags, {_list(ops.NATURE_TAGS)})"), _rule("archive_city", f"list_has_any(tags, {_list(ops.CITY_TAGS)})")))}),
met AS (SELECT asset_id, key, round(least(0.28::DOUBLE + n * 0.22::DOUBLE, 0.94::DOUBLE), 4) AS confidence, list_position({_list(ops.ARCHIVE_TAGS)}, key) AS place FROM rules WHERE n > 0),
found AS (SELECT asset_id, key, confidence, place FROM met UNION ALL SELECT asset_id, 'archive_review_needed', 0.32, 9 FROM media ANTI JOIN met USING (asset_id)),
suggested AS (SELECT asset_id, key, confidence, row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, place) AS rank FROM found QUALIFY rank <= 4)"""


@query(f"WITH {ARCHIVE} SELECT * FROM suggested")
def archive_suggestions(spark, sf_dir):
    return ops.archive_suggestions(flagged(spark, sf_dir), signals(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {ARCHIVE}, of(key, tag) AS (VALUES {", ".join(f"('{k}', '{t}')" for k, ts in ops.ARCHIVE_TAGS.items() for t in ts)}), chosen AS (SELECT * FROM suggested WHERE rank = 1 AND asset_id % 2 = 0)
SELECT asset_id, tag, source FROM tags WHERE source <> 'auto_archive' OR asset_id NOT IN (SELECT asset_id FROM chosen) UNION ALL SELECT asset_id, tag, 'auto_archive' FROM chosen JOIN of USING (key)""")
def archive_applied(spark, sf_dir):
    chosen = ops.archive_suggestions(flagged(spark, sf_dir), signals(spark, sf_dir)).filter("rank = 1 AND asset_id % 2 = 0")
    return ops.apply_suggestions(tags(spark, sf_dir), chosen).select("asset_id", "tag", "source")


@query(f"""WITH {SIGNALS}, b AS (SELECT *, CASE WHEN text_type = 'asr' THEN 'asr' WHEN text_type IN ('manual_text', 'document_text') THEN 'manual' ELSE 'visual' END AS bucket FROM signals),
e AS (SELECT asset_id, bucket, engine, min(id) AS first FROM b WHERE engine <> '' GROUP BY ALL), l AS (SELECT asset_id, bucket, string_agg(engine, ',' ORDER BY first) AS engines FROM e GROUP BY ALL),
g AS (SELECT asset_id, bucket, count(*) AS n, trim(regexp_replace(string_agg(text, ' ' ORDER BY id), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM b GROUP BY ALL),
h AS (SELECT *, length(regexp_extract(t[:260], '(?s)^(.*[.。!?])', 1)) AS stop FROM g)
SELECT asset_id, bucket, n, coalesce(engines, '') AS engines, CASE WHEN length(t) <= 260 THEN t WHEN stop - 1 >= 90 THEN t[:stop] ELSE rtrim(t[:260]) || '...' END AS summary FROM h LEFT JOIN l USING (asset_id, bucket)""")
def signal_summaries(spark, sf_dir):
    return ops.signal_summary(signals(spark, sf_dir)).withColumn("engines", F.array_join("engines", ","))


@query(f"WITH {SIGNALS} SELECT asset_id, id FROM signals WHERE length(trim(text)) >= 2 AND (confidence IS NULL OR confidence >= 0.45)")
def accepted_signals(spark, sf_dir):
    return ops.accepted_signals(signals(spark, sf_dir), 0.45).select("asset_id", "id")


@query(f"""WITH {SIGNALS}, gone AS (SELECT * FROM signals WHERE engine = 'e1' AND confidence < 0.6)
SELECT asset_id, id, 'kept' AS what FROM signals ANTI JOIN gone USING (asset_id, id) UNION ALL SELECT DISTINCT asset_id, NULL, 'refresh' FROM gone""")
def cleaned_signals(spark, sf_dir):
    kept, touched = ops.cleanup_signals(signals(spark, sf_dir), "e1", 0.6)
    return kept.select("asset_id", "id", F.lit("kept").alias("what")).unionByName(touched.select("asset_id", F.lit(None).cast("long").alias("id"), F.lit("refresh").alias("what")))


@query(f"WITH {SIGNALS} SELECT asset_id, string_agg(text, ' ' ORDER BY id DESC) FILTER (WHERE text_type IN ('asr', 'ocr')) AS text, round(avg(confidence) FILTER (WHERE text_type = 'ocr'), 4) AS ocr_confidence FROM signals GROUP BY 1")
def text_by_type(spark, sf_dir):
    """The texts of some types, the latest first, and the mean confidence of recognised text, null where there is none."""
    chosen = F.sort_array(F.collect_list(F.when(F.col("text_type").isin("asr", "ocr"), F.struct("id", "text"))), False)
    joined = F.array_join(F.transform(chosen, lambda s: s["text"]), " ")
    mean = F.round(F.avg(F.when(F.col("text_type") == "ocr", F.col("confidence"))), 4)
    return signals(spark, sf_dir).groupBy("asset_id").agg(F.when(F.size(chosen) > 0, joined).alias("text"), mean.alias("ocr_confidence"))


@query(f"WITH {FACES}, p AS (SELECT person_id, count(*) AS face_count, arg_min(face_id, (-quality, face_id)) AS prototype, array_to_string(list_sort(list(DISTINCT asset_id)), ',') AS assets FROM faces GROUP BY 1) SELECT *, row_number() OVER (ORDER BY face_count DESC, person_id) AS place FROM p")
def person_albums(spark, sf_dir):
    """Persons with their faces, prototype and assets, the largest first."""
    rows = ops.person_rows(faces(spark, sf_dir)).withColumn("assets", F.array_join(F.col("assets").cast("array<string>"), ","))
    return graph.numbered(rows, [F.desc("face_count"), F.col("person_id")], "place")


@query(f"WITH {FACES}, {NAMES}, k AS (SELECT person_id FROM faces GROUP BY 1 HAVING count(*) >= 50 UNION SELECT person_id FROM names WHERE display_name LIKE '%3') SELECT face_id, person_id FROM faces SEMI JOIN k USING (person_id)")
def stable_persons(spark, sf_dir):
    named = _names(spark, sf_dir).filter("display_name LIKE '%3'")
    return ops.stable_persons(faces(spark, sf_dir), named, 50).select("face_id", "person_id")


@query(f"WITH {FACES}, k AS (SELECT *, dense_rank() OVER (ORDER BY person_id) AS n FROM faces WHERE person_id > 'person_0003') SELECT face_id, printf('person_%04d', n) AS person_id FROM k")
def renumbered_persons(spark, sf_dir):
    return ops.renumbered(faces(spark, sf_dir).filter("person_id > 'person_0003'")).select("face_id", "person_id")


@query("""WITH f AS (SELECT vec_id % 100 AS asset_id, vec_id AS position, CASE WHEN vec_id % 3 > 0 THEN 'f' || vec_id ELSE '' END AS face_id, floor(abs(embedding[1]::DOUBLE) * 1000) / 1000 AS quality, vec_id % 7 AS n, list_transform([vec_id % 9 + 0.5::DOUBLE, 1.5, 2.5, 3.49, 9.0][:CASE WHEN vec_id % 7 = 0 THEN 3 ELSE 5 END], lambda x: round_even(x, 0)::INT)[:4] AS bbox FROM embeddings),
k AS (SELECT *, row_number() OVER (ORDER BY position) AS i FROM f WHERE quality >= 0.05 AND len(bbox) = 4)
SELECT asset_id, CASE WHEN face_id = '' THEN 'face_' || asset_id || '_' || printf('%04d', i) ELSE face_id END AS face_id, array_to_string(bbox, ',') AS bbox FROM k""")
def normalized_faces(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id % 100 AS asset_id", "vec_id AS position", "if(vec_id % 3 > 0, concat('f', vec_id), '') AS face_id", "floor(abs(CAST(embedding[0] AS DOUBLE)) * 1000) / 1000 AS quality",
        "slice(array(vec_id % 9 + 0.5D, 1.5D, 2.5D, 3.49D, 9D), 1, if(vec_id % 7 = 0, 3, 5)) AS bbox",
    )
    return ops.normalized_faces(rows, 0.05).select("asset_id", "face_id", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))


@query(f"""WITH {FACES} SELECT DISTINCT a.asset_id FROM faces a JOIN faces b USING (asset_id) WHERE a.person_id = 'person_0001' AND b.person_id = 'person_0002'
AND (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 > greatest(0.08::DOUBLE * (sqrt(greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1)) + sqrt(greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1))), 6)""")
def left_of_relation(spark, sf_dir):
    return ops.geometric_relations(faces(spark, sf_dir), "person_0001", "left_of", "person_0002")


@query("SELECT c_custkey, CASE WHEN x IN ('public', 'personal') THEN x ELSE 'public' END AS library, CASE WHEN x IN ('all', 'public', 'personal') THEN x ELSE 'all' END AS library_filter FROM (SELECT c_custkey, coalesce(lower(trim([' Public', 'PERSONAL ', 'all', 'other', '', NULL][c_custkey % 6 + 1])), '') AS x FROM customer)")
def library_names(spark, sf_dir):
    raw = F.array(*[F.lit(x) for x in (" Public", "PERSONAL ", "all", "other", "", None)])[(F.col("c_custkey") % 6).cast("int")]
    return table(spark, sf_dir, "customer").select("c_custkey", names.normalize_library(raw).alias("library"), names.normalize_library_filter(raw).alias("library_filter"))


@query("SELECT c_custkey, CASE WHEN try_cast(trim(x) AS HUGEINT) IS NULL THEN 20 ELSE greatest(1, least(100, try_cast(trim(x) AS HUGEINT))) END::BIGINT AS n FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN '-7' WHEN 2 THEN 'x9' WHEN 3 THEN '' ELSE '99999999999999999999' END AS x FROM customer)")
def bounded_numbers(spark, sf_dir):
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN concat(' ', c_custkey, ' ') WHEN 1 THEN '-7' WHEN 2 THEN 'x9' WHEN 3 THEN '' ELSE '99999999999999999999' END")
    return table(spark, sf_dir, "customer").select("c_custkey", names.bounded_int(raw, 20, 1, 100).alias("n"))


@query("""WITH f AS (SELECT page_id, regexp_extract(n, '([^/]*)/*$', 1) AS n FROM (SELECT page_id, replace(url, '?', '_x.JPG') AS n FROM pages)), s AS (SELECT *, regexp_extract(n, '.(\\.[^.]+)$', 1) AS suffix FROM f),
t AS (SELECT page_id, lower(suffix) AS suffix, trim(regexp_replace(n[:length(n) - length(suffix)], '[^0-9A-Za-z_-]+', '_', 'g'), '_') AS stem FROM s) SELECT page_id, CASE WHEN stem = '' THEN 'asset' ELSE stem END || suffix AS name FROM t""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.safe_filename(F.replace("url", F.lit("?"), F.lit("_x.JPG"))).alias("name"))


RELATION = "CASE c_custkey % 4 WHEN 0 THEN 'Person' || c_custkey || ' left_of person_' || c_custkey * 100003 WHEN 1 THEN 'person-7  right_of  PERSON_' || c_custkey WHEN 2 THEN 'cat on table' ELSE 'person_1 beside dog' END"


@query(f"""WITH r AS (SELECT c_custkey, {RELATION} AS r FROM customer), p AS (SELECT *, regexp_extract(r, '(?i)person[_-]?(\\d+)', 1) AS n, regexp_extract(trim(r), '(?i)^person[_-]?(\\d+)\\s+(.+?)\\s+person[_-]?(\\d+)$', ['a', 'b', 'c']) AS m FROM r)
SELECT c_custkey, CASE WHEN n = '' THEN r ELSE 'person_' || CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END END AS person, replace(replace(regexp_replace(r, '(?i)person[_-]?0*(\\d+)', 'person \\1', 'g'), 'left_of', 'left of'), 'right_of', 'right of') AS prompt,
  CASE WHEN m.a <> '' THEN 'person_' || lpad(m.a, greatest(4, length(m.a))::INT, '0') END AS subject, CASE WHEN m.a <> '' THEN trim(m.b) END AS predicate, CASE WHEN m.a <> '' THEN 'person_' || lpad(m.c, greatest(4, length(m.c))::INT, '0') END AS target FROM p""")
def relation_texts(spark, sf_dir):
    raw = F.expr(RELATION)
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("r")).withColumn("p", names.person_relation(F.col("r")))
    return rows.select("c_custkey", names.person_id(F.col("r")).alias("person"), names.relation_prompt(F.col("r")).alias("prompt"), "p.subject", "p.predicate", "p.target")


@query("""WITH c AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'video/webm' WHEN 1 THEN 'video/mp4' ELSE 'image/gif' END AS mime, 'http://h/a/' || p_name || CASE WHEN p_size % 4 = 0 THEN '.OGV?x=1' ELSE '.mp4#t' END AS url, p_size * 1000000 AS size FROM part)
SELECT p_partkey, 3 * (contains(lower(p_name), 'ring')::INT + contains(lower(p_name), 'widget')::INT) + contains(mime, 'webm')::INT AS score FROM c
WHERE NOT contains(lower(p_name), 'red') AND mime IN ('video/webm', 'video/mp4') AND regexp_matches(lower(url), '\\.mp4#t$') AND size > 0 AND size <= 20 * 1024 * 1024""")
def usable_candidates(spark, sf_dir):
    mime = F.expr("CASE p_size % 3 WHEN 0 THEN 'video/webm' WHEN 1 THEN 'video/mp4' ELSE 'image/gif' END")
    url = F.expr("concat('http://h/a/', p_name, if(p_size % 4 = 0, '.OGV?x=1', '.mp4#t'))")
    rows = table(spark, sf_dir, "part")
    kept = rows.filter(names.usable_candidate(F.col("p_name"), mime, url, F.col("p_size") * 1000000, ("red",), ("video/webm", "video/mp4"), (".mp4",), 20))
    return kept.select("p_partkey", names.title_score(F.col("p_name"), mime, ("ring", "widget")).alias("score"))


@query(f"""WITH {FLAGGED}, q AS (SELECT asset_id, tags, ['sky', 'food', 'person', 'a'] AS terms, coalesce(text, '') AS text, (asset_id % 100) / 100.0::DOUBLE AS clip FROM flagged),
h AS (SELECT *, list_sort(list_intersect(tags, terms)) AS th, list_sort(list_filter(['an', 'the', 'x'], lambda w: contains(lower(text), w) AND length(w) >= 2)) AS oh FROM q),
r AS (SELECT *, list_filter([CASE WHEN clip >= 0.18 THEN 'looks like: p' END, CASE WHEN len(th) > 0 THEN 'tags: ' || array_to_string(th[:5], ', ') END, CASE WHEN len(oh) > 0 THEN 'texts: ' || array_to_string(oh[:5], ', ') END, CASE WHEN clip >= 0.5 THEN 'filename' END], lambda x: x IS NOT NULL) AS why FROM h)
SELECT asset_id, round(least(len(th) / 4, 1), 4) AS tag_score, round(least(len(oh) / 3, 1), 4) AS text_score, clip >= 0.72 OR len(th) > 0 OR len(oh) > 0 OR clip >= 0.5 AS strong, array_to_string(CASE WHEN len(why) = 0 THEN ['overall likeness'] ELSE why[:4] END, '; ') AS why FROM r""")
def explained_matches(spark, sf_dir):
    """Tag and text scores of the terms of a query, whether a row is a strong result, and why it was found."""
    terms, words = (F.array(*[F.lit(w) for w in ws]) for ws in (("sky", "food", "person", "a"), ("an", "the", "x")))
    rows = flagged(spark, sf_dir).select("asset_id", names.tag_hits(F.col("tags"), terms).alias("th"), names.text_hits(F.coalesce("text", F.lit("")), words).alias("oh"), (F.col("asset_id") % 100 / 100.0).cast("double").alias("clip"))
    none = F.array().cast("array<string>")
    why = names.reasons(F.col("clip"), F.lit("p"), F.col("th"), none, F.col("oh"), none, F.col("clip"))
    return rows.select(
        "asset_id",
        F.round(names.share_of_terms(F.col("th"), terms), 4).alias("tag_score"),
        F.round(names.share_of_terms(F.col("oh"), words), 4).alias("text_score"),
        names.strong_result(F.col("clip"), F.col("th"), F.col("oh"), none, F.col("clip")).alias("strong"),
        F.array_join(why, "; ").alias("why"),
    )


@query(f"WITH {FLAGGED} SELECT count(*) AS asset_count, count(*) FILTER (WHERE kind <> 'document') AS indexed_count, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE library = 'personal') AS personal, sum(n_faces)::BIGINT AS faces FROM flagged")
def model_status(spark, sf_dir):
    counted = [F.count_if(x).alias(n) for n, x in (("indexed_count", F.col("kind") != "document"), ("images", F.col("kind") == "image"), ("personal", F.col("library") == "personal"))]
    return flagged(spark, sf_dir).agg(F.count("*").alias("asset_count"), *counted, F.sum("n_faces").alias("faces"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 30")
def latest_tasks(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type <> 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type")


@query(f"WITH {MEDIA} SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM (SELECT asset_id % 50 AS a, asset_id * 7 % 50 AS b FROM media) WHERE a <> b")
def merge_rule_sets(spark, sf_dir):
    """Rules of at least two different assets, in order and each once."""
    rules = media(spark, sf_dir).select(F.array_sort(F.array_distinct(F.array(F.col("asset_id") % 50, F.col("asset_id") * 7 % 50))).alias("ids"))
    return rules.filter(F.size("ids") >= 2).dropDuplicates(["ids"]).select(F.col("ids")[0].alias("low"), F.col("ids")[1].alias("high"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def synced_assets(spark, sf_dir):
    """A full replacement: what the new listing does not name is gone."""
    seen = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    old = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tag_ops.upsert(old.join(seen, "doc_id", "left_semi"), old.join(seen, "doc_id", "left_semi"), ["doc_id"])


@query(f"""WITH {FACES}, p AS (SELECT *, floor((x2 - x1) * 0.18::DOUBLE) AS px, floor((y2 - y1) * 0.22::DOUBLE) AS py FROM faces)
SELECT face_id, greatest(x1 - px, 0) AS x1, greatest(y1 - py, 0) AS y1, least(x2 + px, 320) AS x2, least(y2 + py, 240) AS y2, round(least(greatest(greatest((x2 - x1) * (y2 - y1), 1) / (320 * 240) * 18, 0.05), 1), 4) AS quality FROM p""")
def face_crops(spark, sf_dir):
    box, size = [F.col(c) for c in ("x1", "y1", "x2", "y2")], (F.lit(320), F.lit(240))
    cut = [x.alias(c) for x, c in zip(names.padded_crop(box, *size), ("x1", "y1", "x2", "y2"))]
    return faces(spark, sf_dir).select("face_id", *cut, F.round(names.area_quality(box, *size), 4).alias("quality"))


@query("SELECT page_id, sha256(html) AS hash, length(trim(html)) > 0 AS accepted, html[:1200] AS encoded, html[:20000] AS stored FROM pages")
def ingested_documents(spark, sf_dir):
    """What is kept of a document: its hash, the beginning that is encoded and the beginning that is stored."""
    text = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text, 256).alias("hash"), (F.length(F.trim(text)) > 0).alias("accepted"), F.substring(text, 1, 1200).alias("encoded"), F.substring(text, 1, 20000).alias("stored"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 3 = 1 THEN 'video' ELSE 'document' END AS kind FROM pages ANTI JOIN (SELECT doc_id AS page_id FROM labels) l USING (page_id) WHERE page_id % 4 > 0 OR page_id % 3 = 9")
def new_files(spark, sf_dir):
    """Files not indexed yet, by the kind that their suffix tells; others are no assets."""
    suffix = names.suffix_of(F.expr("concat('dir/', page_id, CASE WHEN page_id % 4 = 0 THEN '.exe' WHEN page_id % 3 = 0 THEN '.JPG' WHEN page_id % 3 = 1 THEN '.mp4' ELSE '.txt' END)"))
    kind = F.when(suffix.isin(".jpg", ".jpeg", ".png"), "image").when(suffix.isin(".mp4", ".mov"), "video").when(suffix.isin(".txt", ".md"), "document")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind")).filter("kind IS NOT NULL").join(known, "page_id", "left_anti")


@query(f"""WITH {FLAGGED} SELECT asset_id, kind, library, n_signals, n_faces, array_to_string(tags, ',') AS tags, favorite, health FROM healthy""")
def asset_details(spark, sf_dir):
    rows = flagged(spark, sf_dir).withColumn("health", ops.health())
    return rows.select("asset_id", "kind", "library", "n_signals", "n_faces", F.array_join("tags", ",").alias("tags"), "favorite", "health")


def _any(words) -> str:
    return f"list_has_any({_list(words)}, list_filter({_list(words)}, lambda w: contains(q, w)))::INT"


_COLOUR = [" + ".join(f"{rgb[k]}::DOUBLE * {_any(words)}" for words, rgb in vectors.LITE_COLOURS) for k in range(3)]
_SIGN = {k: " + ".join(f"{x}::DOUBLE * {_any(words)}" for words, at, x in vectors.LITE_SIGNS if k in at) for k in (29, 30, 33)}
LITE = "CASE p_size % 5 WHEN 0 THEN '阳光' WHEN 1 THEN ' 夜景 城市' WHEN 2 THEN ' 自拍' WHEN 3 THEN ' 风景' ELSE '' END"


@query(f"""WITH t AS (SELECT p_partkey, lower(p_name || {LITE}) AS q FROM part), v AS (SELECT p_partkey, {", ".join(f"{x} AS {c}" for x, c in zip(_COLOUR, "rgb"))}, {_SIGN[29]} AS light, {_SIGN[30]} AS busy, {_SIGN[33]} AS wide FROM t),
z AS (SELECT p_partkey, CASE WHEN r = 0 AND g = 0 AND b = 0 AND light = 0 AND busy = 0 AND wide = 0 THEN [0.5, 0.5, 0.5, 0.3, 0.3, 0.0]::DOUBLE[] ELSE [r, g, b, light, busy, wide] END AS x FROM v),
n AS (SELECT *, sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3] + x[4] * x[4] + 3 * x[5] * x[5] + x[6] * x[6]) AS n FROM z)
SELECT p_partkey, round(x[1] / n, 4) AS r, round(x[2] / n, 4) AS g, round(x[3] / n, 4) AS b, round(x[4] / n, 4) AS light, round(x[5] / n, 4) AS busy, round(x[6] / n, 4) AS wide FROM n""")
def lite_text_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", vectors.lite_text_vector(F.concat("p_name", F.expr(LITE))).alias("v"))
    return v.select("p_partkey", *[F.round(F.col("v")[k], 4).alias(c) for k, c in ((0, "r"), (1, "g"), (2, "b"), (29, "light"), (30, "busy"), (33, "wide"))])

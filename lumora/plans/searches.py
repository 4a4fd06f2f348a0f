"""Registered queries of planned search: a few questions, planned on the driver and answered as one batch.

Vectors of assets are those of the table; a prompt's vector is the one of a fixed row backwards, as no text encoder
is at hand and none should equal an asset's.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.functions import scores
from lumora.functions.vectors import normalize
from lumora.operators import search as engine
from lumora.plans import library, planner
from lumora.plans.catalog import COS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW, LIMIT = datetime(1998, 7, 1), 12
QUESTIONS = (
    ("find photo of sky and food", "all"),
    ("狗在车左边的照片", "all"),
    ("去年夏天在城市拍的视频", "public"),
    ("interview with person_1", "personal"),
    ("1997年 冬天 nature file 12", "all"),
    ("portrait", "public"),
)
_PLANS = [(k, planner.build_plan(text, NOW), where) for k, (text, where) in enumerate(QUESTIONS)]
_PLACE = {"query": 3, "relation": 17, "contrast": 29}


def _row(query: int, side: str, position: int) -> int:
    return (query * 11 + position * 7 + _PLACE[side]) % 100


def assets(spark, sf_dir) -> DataFrame:
    """Assets with a vector: those of the embeddings table that are documents, with the date of an order."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), normalize(F.col("embedding")).alias("v"))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").alias("created"))
    return library.media(spark, sf_dir).drop("text").join(vectors, "asset_id").join(dates, "asset_id", "left")


def _prompts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    plans, prompts = planner.plan_rows(spark, _PLANS)
    place = F.create_map(*[F.lit(x) for kv in _PLACE.items() for x in kv])
    row = (F.col("query_id") * 11 + F.col("position") * 7 + F.try_element_at(place, F.col("side"))) % 100
    vectors = table(spark, sf_dir, "embeddings").filter("vec_id < 100").select(F.col("vec_id").alias("row"), normalize(F.reverse("embedding")).alias("q"))
    return plans, prompts.withColumn("row", row).join(F.broadcast(vectors), "row").drop("row")


def _texts(spark, sf_dir) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", "text")), False), lambda s: s["text"])
    return library.signals(spark, sf_dir).groupBy("asset_id").agg(F.array_join(parts, " ").alias("text"))


def results(spark, sf_dir, profile: str, limit: int = LIMIT) -> DataFrame:
    plans, prompts = _prompts(spark, sf_dir)
    return engine.search(plans, prompts, assets(spark, sf_dir), library.tags(spark, sf_dir), _texts(spark, sf_dir), limit, profile)


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _texts_of(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]::VARCHAR[]"


_PLAN_ROWS = ", ".join(
    f"({k}, {_text(p.filters['kind'])}, {p.filters['year'] or 'NULL'}, {list(planner.lex.SEASON_MONTHS[p.filters['season']]) if p.filters['season'] else 'NULL'}::INT[], '{where}', {_texts_of(p.terms)}, {_texts_of(planner.filename_tokens(p.text))}, {_texts_of(p.conditions.get('relations', []))}, {_texts_of(map(planner.spoken, p.conditions.get('relations', [])))})"
    for k, p, where in _PLANS
)
_PROMPT_ROWS = ", ".join(f"({k}, '{side}', {i}, {_text(line)}, {_row(k, side, i)})" for k, p, _ in _PLANS for side, lines in (("query", p.prompts), ("relation", p.relation_prompts), ("contrast", p.contrast_prompts)) for i, line in enumerate(lines))


def _search_sql(profile: str, limit: int) -> str:
    weights = scores.PROFILES[profile]
    fused = " + ".join(f"{w}::DOUBLE * {c}" for c, w in (("clip", weights.get("clip")), ("tag_score", weights.get("tag")), ("metadata_score", weights.get("metadata")), ("filename_score", weights.get("filename")), ("text_score", weights.get("ocr")), ("relation_score", weights.get("relation"))) if w)
    most = max(8 * limit, 64)
    return f"""{library.MEDIA}, {library.TAGS}, {library.SIGNALS},
plans(query_id, asked_kind, year, months, asked_library, terms, tokens, relations, said) AS (VALUES {_PLAN_ROWS}),
prompts AS (SELECT p.*, list_reverse(e.embedding) AS q FROM (VALUES {_PROMPT_ROWS}) p(query_id, side, position, prompt, vec_id) JOIN embeddings e USING (vec_id)),
a AS (SELECT m.asset_id, m.kind, m.library, m.filename, o_orderdate AS created, e.embedding AS v FROM media m JOIN embeddings e ON e.vec_id = m.asset_id LEFT JOIN orders ON o_orderkey = m.asset_id),
near AS (SELECT query_id, position, prompt, asset_id, {COS.format("v", "q")} AS clip FROM a, prompts WHERE side = 'query' QUALIFY row_number() OVER (PARTITION BY query_id, position ORDER BY clip DESC, asset_id) <= {most}),
tagged AS (SELECT query_id, asset_id, tag, CASE WHEN len(relations) > 0 THEN 0.18::DOUBLE ELSE 0.32::DOUBLE END AS clip FROM (SELECT query_id, relations, unnest(terms) AS tag FROM plans) JOIN (SELECT DISTINCT asset_id, tag FROM tags) USING (tag)
  QUALIFY row_number() OVER (PARTITION BY query_id, tag ORDER BY asset_id DESC) <= {most}),
u AS (SELECT query_id, asset_id, clip, position, prompt FROM near UNION ALL SELECT query_id, asset_id, clip, 1 << 30, 'tag:' || tag FROM tagged),
best AS (SELECT query_id, asset_id, max(clip) AS clip, arg_min(prompt, (-clip, position, prompt)) AS prompt FROM u GROUP BY ALL),
cut AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY clip DESC, asset_id) <= {most}),
margins AS (SELECT query_id, asset_id, max({COS.format("v", "q")}) FILTER (WHERE side = 'relation') AS pos, max({COS.format("v", "q")}) FILTER (WHERE side = 'contrast') AS neg FROM cut JOIN a USING (asset_id) JOIN prompts USING (query_id) WHERE side <> 'query' GROUP BY ALL),
lists AS (SELECT asset_id, list_sort(list(DISTINCT tag)) AS tags FROM tags GROUP BY 1), said AS (SELECT asset_id, lower(string_agg(text, ' ' ORDER BY id DESC)) AS signal FROM signals GROUP BY 1),
r AS (SELECT c.query_id, c.asset_id, c.clip, c.prompt, p.*, a.* EXCLUDE (asset_id), coalesce(pos - coalesce(neg, pos), 0) AS margin, list_sort(list_intersect(coalesce(l.tags, []), p.terms)) AS tag_hits,
    list_sort(list_filter(p.terms, lambda t: length(t) >= 2 AND contains(coalesce(s.signal, ''), t))) AS text_hits
  FROM cut c JOIN a USING (asset_id) JOIN plans p ON p.query_id = c.query_id LEFT JOIN lists l USING (asset_id) LEFT JOIN said s USING (asset_id) LEFT JOIN margins m ON m.query_id = c.query_id AND m.asset_id = c.asset_id
  WHERE (asked_library = 'all' OR library = asked_library) AND (asked_kind IS NULL OR kind = asked_kind)),
f AS (SELECT *, least(len(tag_hits) / greatest(len(terms), 1), 1)::DOUBLE AS tag_score, least(len(text_hits) / greatest(len(terms), 1), 1)::DOUBLE AS text_score, (len(list_filter(tokens, lambda t: contains(lower(filename), t))) / greatest(len(tokens), 1))::DOUBLE AS filename_score,
  (CASE WHEN year IS NULL AND months IS NULL THEN 0 ELSE (coalesce(year(created) = year, false)::INT + coalesce(list_contains(months, month(created)::INT), false)::INT) / ((year IS NOT NULL)::INT + (months IS NOT NULL)::INT) END)::DOUBLE AS metadata_score,
  CASE WHEN len(relations) = 0 THEN 0 ELSE least(1::DOUBLE, least(1::DOUBLE, greatest(0::DOUBLE, (margin + 0.03::DOUBLE) / 0.11::DOUBLE)) + CASE
    WHEN len(list_filter(list_concat(relations, said), lambda x: contains(lower(prompt), lower(x)))) > 0 THEN 0.15::DOUBLE
    WHEN len(list_filter(said, lambda x: len(string_split(x, ' ')) >= 3 AND len(list_filter(string_split(lower(x), ' '), lambda w: NOT contains(lower(prompt), w))) = 0)) > 0 THEN 0.08::DOUBLE ELSE 0 END) END::DOUBLE AS relation_score FROM r),
g AS (SELECT *, round({fused}, 4) AS score FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clip DESC, asset_id) AS rank, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM g)"""


def _planned(profile: str):
    def run(spark, sf_dir):
        out = results(spark, sf_dir, profile)
        return out.withColumns({"tag_hits": F.array_join("tag_hits", ","), "text_hits": F.array_join("text_hits", ",")}).drop("reasons")

    return run


for _profile in scores.PROFILES:
    QUERIES[f"planned_search_{_profile}"] = _planned(_profile)
    SQL[f"planned_search_{_profile}"] = f"""WITH {_search_sql(_profile, LIMIT)}
SELECT query_id, rank, asset_id, score, round(least(0.98::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * ((score - lo) / greatest(hi - lo, 1e-6)) + 0.1::DOUBLE * greatest(0::DOUBLE, 1 - 0.035::DOUBLE * (rank - 1))), 4) AS display, prompt, round(clip, 4) AS clip,
  round(tag_score, 4) AS tag_score, metadata_score, round(text_score, 4) AS text_score, round(filename_score, 4) AS filename_score, round(relation_score, 4) AS relation_score, array_to_string(tag_hits, ',') AS tag_hits, array_to_string(text_hits, ',') AS text_hits FROM h WHERE rank <= {LIMIT}"""


RELEVANT = "SELECT label::BIGINT AS query_id, vec_id AS asset_id FROM embeddings SEMI JOIN (SELECT doc_id AS vec_id FROM documents) d USING (vec_id) WHERE label < 5"


def evaluate_profiles(spark, sf_dir) -> DataFrame:
    """Set recall, mean reciprocal rank and counts of each profile over all questions. Questions without relevant assets count
    as zero and are told apart."""
    plans, _ = planner.plan_rows(spark, _PLANS)
    wanted = assets(spark, sf_dir).select("asset_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("label").cast("long").alias("query_id")), "asset_id").filter("query_id < 5")
    wanted = wanted.join(plans.select("query_id"), "query_id")
    relevant = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = None
    for profile in scores.PROFILES:
        ranked = results(spark, sf_dir, profile, 20).select("query_id", "asset_id", "rank")
        hits = ranked.join(wanted, ["query_id", "asset_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("at_5"), F.count_if(F.col("rank") <= 10).alias("at_10"))
        each = plans.select("query_id").join(relevant, "query_id", "left").join(hits, "query_id", "left")
        share = [F.coalesce(F.col(c) / F.col("relevant"), F.lit(0.0)) for c in ("at_5", "at_10")]
        summary = each.agg(F.lit(profile).alias("profile"), F.count("*").alias("query_count"), F.count("relevant").alias("labeled_query_count"), *[F.round(F.avg(s), 4).alias(n) for s, n in zip(share, ("recall_at_5", "recall_at_10"))], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))
        out = summary if out is None else out.unionByName(summary)
    return out


def _evaluation_sql(profile: str) -> str:
    return f"""SELECT * FROM (WITH {_search_sql(profile, 20)}, w AS ({RELEVANT}), n AS (SELECT query_id, count(*) AS relevant FROM w GROUP BY 1),
x AS (SELECT query_id, min(rank) AS first, count(*) FILTER (WHERE rank <= 5) AS at_5, count(*) FILTER (WHERE rank <= 10) AS at_10 FROM h SEMI JOIN w USING (query_id, asset_id) WHERE rank <= 20 GROUP BY 1)
SELECT '{profile}' AS profile, count(*) AS query_count, count(relevant) AS labeled_query_count, round(avg(coalesce(at_5 / relevant, 0)), 4) AS recall_at_5, round(avg(coalesce(at_10 / relevant, 0)), 4) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 4) AS mrr
FROM plans LEFT JOIN n USING (query_id) LEFT JOIN x USING (query_id))"""


QUERIES["evaluate_profiles"] = evaluate_profiles
SQL["evaluate_profiles"] = " UNION ALL ".join(map(_evaluation_sql, scores.PROFILES))

"""Registered queries over the driver tables, and the DuckDB statement that each one must equal.

The tables stand in for a media library: documents are assets (lang gives the kind, source the library), embeddings are
asset vectors and faces, conversations are text signals, orders give dates, lineitem gives boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions import scores, texts
from lumora.operators import graph, recall, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KIND = "CASE lang WHEN 'en' THEN 'image' WHEN 'de' THEN 'video' ELSE 'document' END"
LIBRARY = "CASE WHEN source < 'src2' THEN 'personal' ELSE 'public' END"
COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), "text", F.expr(KIND).alias("kind"), F.expr(LIBRARY).alias("library"), "source", "n_chars")


ASSETS = f"assets AS (SELECT doc_id AS asset_id, text, {KIND} AS kind, {LIBRARY} AS library, source, n_chars FROM documents)"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("v"), "label")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label, ten at any size."""
    return faces(spark, sf_dir).groupBy("label").agg(F.min_by("v", "asset_id").alias("q"), F.min("asset_id").alias("query_id"))


PROTO = "proto AS (SELECT label, arg_min(embedding, vec_id) AS q, min(vec_id) AS query_id FROM embeddings GROUP BY label)"
SCORED = f"{PROTO}, scored AS (SELECT query_id, vec_id AS asset_id, {COS.format('embedding', 'q')} AS score FROM embeddings, proto)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.vector_scores(prototypes(spark, sf_dir), faces(spark, sf_dir))


@query(f"WITH {SCORED} SELECT query_id, asset_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id) AS rank FROM scored) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return recall.topk(scored(spark, sf_dir), 10).select("query_id", "asset_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SCORED}, s AS (SELECT query_id, asset_id, round(score, 4) AS similarity FROM scored WHERE query_id <> asset_id) SELECT query_id, asset_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS rank FROM s) WHERE rank <= 8")
def similar_assets(spark, sf_dir):
    near = scored(spark, sf_dir).filter("query_id <> asset_id").withColumn("similarity", F.round("score", 4))
    return recall.topk(near, 8, score="similarity").select("query_id", "asset_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SCORED},
v AS (SELECT query_id, asset_id, score, 'vector' AS route FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id) AS k FROM scored) WHERE k <= 64),
t AS (SELECT p.query_id, e.vec_id, 0.32::DOUBLE, 'tag' FROM embeddings e JOIN proto p USING (label)),
u AS (SELECT * FROM v UNION ALL SELECT * FROM t),
m AS (SELECT query_id, asset_id, max(score) AS score, arg_min(route, (-score, route)) AS route FROM u GROUP BY ALL)
SELECT query_id, asset_id, round(score, 4) AS score, route FROM m""")
def multi_route_max_union(spark, sf_dir):
    by_vector = recall.topk(scored(spark, sf_dir), 64).select("query_id", "asset_id", "score", F.lit("vector").alias("route"))
    by_tag = faces(spark, sf_dir).join(F.broadcast(prototypes(spark, sf_dir)), "label").select("query_id", "asset_id", F.lit(0.32).alias("score"), F.lit("tag").alias("route"))
    return recall.max_union([by_vector, by_tag]).withColumn("score", F.round("score", 4))


FUSED = f"""{SCORED}, f AS (
  SELECT query_id, asset_id, round(0.63::DOUBLE * score + 0.14::DOUBLE * (e.label = p.label)::INT + 0.09::DOUBLE * least(asset_id / 1000.0, 1.0)::DOUBLE, 4) AS final
  FROM scored JOIN proto p USING (query_id) JOIN embeddings e ON e.vec_id = asset_id)"""


def _fused(spark, sf_dir):
    joined = scored(spark, sf_dir).join(F.broadcast(prototypes(spark, sf_dir).select("query_id", F.col("label").alias("wanted"))), "query_id").join(faces(spark, sf_dir).select("asset_id", "label"), "asset_id")
    features = {"clip": F.col("score"), "tag": (F.col("label") == F.col("wanted")).cast("double"), "filename": F.least(F.col("asset_id") / 1000.0, F.lit(1.0))}
    return joined.select("query_id", "asset_id", F.round(scores.weighted(features), 4).alias("final"))


@query(f"WITH {FUSED} SELECT query_id, asset_id, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, asset_id) AS rank FROM f) WHERE rank <= 36")
def weighted_fusion(spark, sf_dir):
    return recall.topk(_fused(spark, sf_dir), 36, score="final").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, asset_id) - 1 AS rank,
  min(final) OVER (PARTITION BY query_id) AS lo, max(final) OVER (PARTITION BY query_id) AS hi FROM f)
SELECT query_id, asset_id, round(least(0.98::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * ((final - lo) / greatest(hi - lo, 1e-6)) + 0.1::DOUBLE * greatest(0::DOUBLE, 1 - 0.035::DOUBLE * rank)), 4) AS display FROM r WHERE rank < 36""")
def display_scores(spark, sf_dir):
    """The span of all candidates is an aggregate; only the ranks shown need an order, which Spark cuts before the shuffle."""
    fused = _fused(spark, sf_dir)
    spans = fused.groupBy("query_id").agg(F.min("final").alias("low"), F.max("final").alias("high"))
    ranked = recall.topk(fused, 36, score="final").join(F.broadcast(spans), "query_id")
    return ranked.select("query_id", "asset_id", scores.display_in(F.col("final"), F.col("low"), F.col("high"), F.col("rank") - 1).alias("display"))


RANKED = f"{SCORED}, ranked AS (SELECT s.*, p.label AS wanted, e.label, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, asset_id) AS rank FROM scored s JOIN proto p USING (query_id) JOIN embeddings e ON e.vec_id = asset_id WHERE asset_id <> query_id)"


def _ranked(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("asset_id <> query_id").join(F.broadcast(prototypes(spark, sf_dir).select("query_id", F.col("label").alias("wanted"))), "query_id").join(faces(spark, sf_dir).select("asset_id", "label"), "asset_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "asset_id")))


@query(f"""WITH {RANKED}, q AS (SELECT query_id, count(*) FILTER (WHERE label = wanted) AS relevant, count(*) FILTER (WHERE label = wanted AND rank <= 10) AS hits, min(rank) FILTER (WHERE label = wanted) AS first FROM ranked GROUP BY query_id)
SELECT count(*) AS query_count, count(*) FILTER (WHERE relevant > 0) AS labeled_query_count, round(avg(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END), 4) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 4) AS mrr FROM q""")
def profile_evaluation(spark, sf_dir):
    right = F.col("label") == F.col("wanted")
    per = _ranked(spark, sf_dir).groupBy("query_id").agg(F.count_if(right).alias("relevant"), F.count_if(right & (F.col("rank") <= 10)).alias("hits"), F.min(F.when(right, F.col("rank"))).alias("first"))
    set_recall = F.coalesce(F.try_divide("hits", "relevant"), F.lit(0.0))
    return per.agg(F.count("*").alias("query_count"), F.count_if(F.col("relevant") > 0).alias("labeled_query_count"), F.round(F.avg(set_recall), 4).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@query(f"WITH {RANKED}, q AS (SELECT query_id, min(rank) FILTER (WHERE label = wanted) AS first FROM ranked GROUP BY query_id) SELECT round(avg((first <= 1)::INT), 4) AS hit_at_1, round(avg((first <= 5)::INT), 4) AS hit_at_5, round(avg((first <= 10)::INT), 4) AS hit_at_10, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 4) AS mrr_at_10 FROM q")
def hit_rate_mrr(spark, sf_dir):
    first = _ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("first"))
    hits = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_at_{k}") for k in (1, 5, 10)]
    return first.agg(*hits, F.round(F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr_at_10"))


@query(f"""WITH {PROTO}, s AS (SELECT vec_id AS asset_id, 'tag_' || p.label AS tag, {COS.format('embedding', 'q')} AS score FROM embeddings, proto p),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, tag DESC) AS k, max(score) OVER (PARTITION BY asset_id) AS best FROM s)
SELECT asset_id, tag, round(score, 4) AS confidence FROM r WHERE k <= 4 AND score >= 0.24 AND score >= best - 0.035""")
def zero_shot_tags(spark, sf_dir):
    pairs = recall.vector_scores(prototypes(spark, sf_dir).withColumn("query_id", F.concat(F.lit("tag_"), "label")), faces(spark, sf_dir))
    return tags.within_margin(pairs.withColumnRenamed("query_id", "tag"), 4, 0.24, 0.035).select("asset_id", "tag", F.round("score", 4).alias("confidence"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings),
m AS (SELECT label, k, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT label, k, round(m / n, 4) AS x FROM m JOIN n USING (label)""")
def vector_mean_pool(spark, sf_dir):
    each = faces(spark, sf_dir).select("label", F.posexplode("v").alias("k", "x"))
    mean = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return mean.join(length, "label").select("label", F.col("k").cast("long").alias("k"), F.round(F.col("m") / F.col("n"), 4).alias("x"))


@query(f"WITH {ASSETS} SELECT kind, library, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM assets GROUP BY GROUPING SETS ((kind), (library), (kind, library), ())")
def stats_by_group(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return rows.groupingSets([[F.col("kind")], [F.col("library")], [F.col("kind"), F.col("library")], []], "kind", "library").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM g")
def duplicate_stats(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


@query("SELECT sha256(text) AS hash, count(*) AS n, string_agg(source || ':' || doc_id, ',' ORDER BY source, doc_id) AS files FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, hash LIMIT 50")
def duplicate_groups(spark, sf_dir):
    """The largest groups are found by their counts; only their members are then listed."""
    hashed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), "source", "doc_id")
    largest = hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "hash").limit(50)
    members = F.transform(F.sort_array(F.collect_list(F.struct("source", "doc_id"))), lambda m: F.concat(m["source"], F.lit(":"), m["doc_id"]))
    return hashed.join(F.broadcast(largest), "hash").groupBy("hash", "n").agg(F.array_join(members, ",").alias("files"))


TOKENS = "regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')"
EDGES = f"edges AS (SELECT DISTINCT asset_id, tag, 'text' AS source FROM (SELECT asset_id, unnest({TOKENS}) AS tag FROM assets) UNION SELECT asset_id, kind, 'system' FROM assets UNION SELECT asset_id, library, 'system' FROM assets)"


def edges(spark, sf_dir):
    rows = assets(spark, sf_dir)
    by_text = rows.select("asset_id", F.explode(F.array_distinct(texts.ascii_tokens(F.col("text")))).alias("tag"), F.lit("text").alias("source"))
    return by_text.union(rows.select("asset_id", F.explode(F.array_distinct(F.array("kind", "library"))), F.lit("system")))


@query(f"WITH {ASSETS}, {EDGES} SELECT tag, count(DISTINCT asset_id) AS asset_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM edges WHERE tag NOT IN ('public', 'personal') GROUP BY tag ORDER BY asset_count DESC, tag LIMIT 120")
def tag_facets(spark, sf_dir):
    return tags.facets(edges(spark, sf_dir), ("public", "personal")).orderBy(F.desc("asset_count"), "tag").limit(120)


@query(f"WITH {ASSETS}, {EDGES} SELECT a.asset_id, kind, library FROM assets a SEMI JOIN (SELECT asset_id FROM edges WHERE tag = 'video') t USING (asset_id) ORDER BY n_chars DESC, a.asset_id LIMIT 160")
def tag_assets(spark, sf_dir):
    tagged = edges(spark, sf_dir).filter("tag = 'video'").select("asset_id")
    return assets(spark, sf_dir).join(tagged, "asset_id", "left_semi").orderBy(F.desc("n_chars"), "asset_id").limit(160).select("asset_id", "kind", "library")


@query(f"""WITH {ASSETS}, t AS (SELECT asset_id, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM (SELECT asset_id, {TOKENS} AS l FROM assets)),
c AS (SELECT asset_id, tag, count(*) AS n, min(pos) AS p FROM t GROUP BY ALL)
SELECT asset_id, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, p) AS rank FROM c) WHERE rank <= 30""")
def token_tags_topn(spark, sf_dir):
    return tags.text_tags(assets(spark, sf_dir)).select("asset_id", "tag", "n", F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn DESC) AS text FROM conversations GROUP BY conv_id")
def text_concat_desc(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")), False)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


@query("""WITH b AS (SELECT conv_id, CASE role WHEN 'assistant' THEN 'asr' WHEN 'user' THEN 'manual' ELSE 'visual' END AS bucket, turn, text FROM conversations),
g AS (SELECT conv_id, bucket, count(*) AS n, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '[ \t\n\r\f]+', ' ', 'g')) AS t FROM b GROUP BY ALL),
h AS (SELECT *, length(regexp_extract(t[:260], '(?s)^(.*[.。!?])', 1)) AS stop FROM g)
SELECT conv_id, bucket, n, CASE WHEN length(t) <= 260 THEN t WHEN stop - 1 >= 90 THEN t[:stop] ELSE rtrim(t[:260]) || '...' END AS summary FROM h""")
def text_summary_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("bucket", F.expr("CASE role WHEN 'assistant' THEN 'asr' WHEN 'user' THEN 'manual' ELSE 'visual' END"))
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    joined = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("all"))
    return joined.select("conv_id", "bucket", "n", texts.compact_text(F.col("all")).alias("summary"))


@query("""WITH e AS (SELECT CASE role WHEN 'assistant' THEN 'Whisper: engine' WHEN 'user' THEN ' ASR:doc:x ' ELSE '' END AS raw FROM conversations),
p AS (SELECT CASE WHEN contains(raw, ':') THEN lower(trim(split_part(raw, ':', 1))) ELSE 'ocr' END AS kind, trim(CASE WHEN contains(raw, ':') THEN raw[strpos(raw, ':') + 1:] ELSE raw END) AS name FROM e)
SELECT CASE WHEN kind IN ('ocr', 'subtitle_ocr', 'asr', 'manual_text', 'document_text') THEN kind ELSE 'ocr' END AS text_type, CASE WHEN name = '' THEN 'unknown' ELSE name END AS engine, count(*) AS n FROM p GROUP BY ALL""")
def engine_split(spark, sf_dir):
    raw = F.expr("CASE role WHEN 'assistant' THEN 'Whisper: engine' WHEN 'user' THEN ' ASR:doc:x ' ELSE '' END")
    kind, engine = texts.split_engine(raw)
    return table(spark, sf_dir, "conversations").groupBy(kind.alias("text_type"), engine.alias("engine")).agg(F.count("*").alias("n"))


@query("SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE length(trim(c.text)) >= 2 AND (l.quality IS NULL OR l.quality >= 1)")
def signal_filter(spark, sf_dir):
    signals = table(spark, sf_dir, "conversations").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")
    return signals.filter((F.length(F.trim("text")) >= 2) & (F.col("quality").isNull() | (F.col("quality") >= 1))).select("conv_id", "turn")


#: Runs of one mark become one mark; DuckDB has no back-references, so each mark is written out.
CLEANED = "trim(regexp_replace(part, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
for _mark in "#%*&!.-=|?,$<>/:;":
    CLEANED = f"regexp_replace({CLEANED}, '[{_mark}]{{3,}}', '{_mark}', 'g')"


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(range(len(parts))) AS k, unnest(parts) AS part FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)),
c AS (SELECT conv_id, turn, k, ({CLEANED})[:2000] AS t FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(t) ORDER BY turn, k) AS r FROM c WHERE t <> '')
SELECT conv_id, string_agg(t, ' ' ORDER BY turn, k) AS text FROM o WHERE r = 1 GROUP BY conv_id""")
def dedupe_texts(spark, sf_dir):
    """The lines of a conversation stand for the texts of one asset."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.split("text", "\n").alias("lines")))), lambda t: t["lines"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", texts.unique_texts(F.flatten("lines")).alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS text FROM pages""")
def html_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.strip_tags(F.col("html")).alias("text"))


@query("""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS terms FROM benchmark)
SELECT page_id, item_id, round(len(list_filter(terms, lambda t: contains(lower(url), t))) / greatest(len(terms), 1), 4) AS score FROM pages, q WHERE len(list_filter(terms, lambda t: contains(lower(url), t))) > 0""")
def keyword_score(spark, sf_dir):
    """A term lies in a name if it is one of its parts, so parts and terms meet in an equi-join. Terms are letters alone, so
    only parts of runs of letters are made, no longer than the longest term."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("terms"))
    terms = items.select("item_id", F.greatest(F.size("terms"), F.lit(1)).alias("n"), F.explode("terms").alias("part"))
    longest = terms.agg(F.max(F.length("part"))).first()[0] or 3
    runs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z]{3,})"), 1))).alias("run"))
    parts = runs.select("page_id", F.expr(f"explode(flatten(transform(sequence(1, length(run) - 2), i -> transform(sequence(3, least({longest}, length(run) - i + 1)), n -> substring(run, i, n)))))").alias("part"))
    hits = parts.distinct().join(terms, "part").groupBy("page_id", "item_id", "n").agg(F.count("*").alias("hits"))
    return hits.select("page_id", "item_id", F.round(F.col("hits") / F.col("n"), 4).alias("score"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def term_containment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term")).filter("term IS NOT NULL")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return recall.containments(docs, items)


@query("SELECT o_orderkey, round((CASE WHEN year(o_orderdate) = 1997 THEN 1 ELSE 0 END + CASE WHEN month(o_orderdate) IN (6, 7, 8) THEN 1 ELSE 0 END) / 2, 4) AS score FROM orders")
def season_year_score(spark, sf_dir):
    months = F.array(*[F.lit(m) for m in scores.SEASONS["summer"]])
    return table(spark, sf_dir, "orders").select("o_orderkey", scores.metadata_match(F.col("o_orderdate"), F.lit(1997), months).alias("score"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def recent_logs(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("SELECT d.doc_id, 'orphan' AS side FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT d.doc_id, 'labelled' FROM documents d SEMI JOIN labels l USING (doc_id)")
def orphan_anti_semi(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("orphan")).unionByName(docs.join(labels, "doc_id", "left_semi").withColumn("side", F.lit("labelled")))


@query("SELECT c.c_custkey, coalesce(n.n_name, 'unknown') AS display_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def name_left_join(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("display_name"))


@query(f"WITH {ASSETS}, {EDGES} SELECT asset_id, array_to_string(list_sort(list(DISTINCT tag))[:40], ',') AS tags FROM edges WHERE length(tag) BETWEEN 2 AND 40 AND tag NOT IN ('none', 'null', 'undefined', 'image', 'photo') GROUP BY asset_id")
def fuse_tags(spark, sf_dir):
    return tags.fuse(edges(spark, sf_dir)).select("asset_id", F.array_join("tags", ",").alias("tags"))


HEALTH = f"""{ASSETS}, h AS (SELECT asset_id, greatest(0, least(100, 100 - 18 * (len(list_distinct({TOKENS})) <= 3)::INT - 10 * (l.quality IS NULL OR l.quality = 0)::INT
  - 24 * (kind = 'video' AND l.doc_id IS NULL)::INT - 14 * (kind = 'image' AND library = 'personal' AND coalesce(l.toxic, 0) = 1)::INT - 12 * (n_chars < 320)::INT + 4 * (coalesce(l.quality, 0) = 1)::INT)) AS score
  FROM assets LEFT JOIN labels l ON l.doc_id = asset_id)"""


def _health(spark, sf_dir):
    rows = assets(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled"), F.col("asset_id") == F.col("labelled"), "left")
    good, people = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    archived = F.coalesce(F.col("quality") != 0, F.lit(False))
    n_tags = F.size(F.array_distinct(texts.ascii_tokens(F.col("text"))))
    score = scores.asset_health(n_tags, archived, (F.col("kind") == "video") & F.col("labelled").isNull(), (F.col("kind") == "image") & (F.col("library") == "personal") & people, F.col("n_chars"), good)
    return rows.select("asset_id", score.alias("score"))


@query(f"WITH {HEALTH} SELECT asset_id, score, CASE WHEN score >= 82 THEN 'good' WHEN score >= 60 THEN 'medium' ELSE 'weak' END AS level FROM h")
def health_score(spark, sf_dir):
    return _health(spark, sf_dir).withColumn("level", scores.grade(F.col("score"), 82, 60))


@query(f"WITH {HEALTH} SELECT count(*) AS assets, round(avg(score), 1) AS mean_health, count(*) FILTER (WHERE score < 60) AS weak FROM h")
def recommendations(spark, sf_dir):
    return _health(spark, sf_dir).agg(F.count("*").alias("assets"), F.round(F.avg("score"), 1).alias("mean_health"), F.count_if(F.col("score") < 60).alias("weak"))


RULES = {"text_rich": "kind = 'video' / n_chars > 2000 / text LIKE '%the%'", "people": "library = 'personal' / kind = 'image'", "food": "text LIKE '%on%'"}
_RULE_SQL = " UNION ALL ".join(f"SELECT asset_id, '{k}' AS rule, {' + '.join(f'({x})::INT' for x in v.split(' / '))} AS n FROM assets" for k, v in RULES.items())


@query(f"WITH {ASSETS}, s AS ({_RULE_SQL}) SELECT asset_id, rule, round(least(0.94::DOUBLE, 0.28::DOUBLE + 0.22::DOUBLE * n), 4) AS confidence FROM s WHERE n > 0")
def archive_rules(spark, sf_dir):
    signals = [F.struct(F.lit(k).alias("rule"), sum((F.expr(x).cast("int") for x in v.split(" / ")), F.lit(0)).alias("n")) for k, v in RULES.items()]
    matched = assets(spark, sf_dir).select("asset_id", F.inline(F.array(*signals))).withColumn("confidence", F.round(scores.archive_confidence(F.col("n")), 4))
    return matched.filter(F.col("confidence") >= 0.34).select("asset_id", "rule", "confidence")


@query("""WITH q AS (SELECT conv_id, turn, q, CASE WHEN q = '' THEN 0 ELSE least(100, 28 + 14 * len(regexp_extract_all(lower(q), '[a-z]{5,}')) + 10 * (length(q) >= 4)::INT) END AS score FROM (SELECT *, CASE WHEN turn % 5 = 4 THEN '' ELSE text[:20 * (turn % 5)] END AS q FROM conversations))
SELECT conv_id, turn, score, CASE WHEN q = '' THEN 'empty' WHEN score >= 76 THEN 'good' WHEN score >= 52 THEN 'medium' ELSE 'weak' END AS level FROM q""")
def query_quality(spark, sf_dir):
    """Beginnings of turns stand for queries, some of them empty; words of five letters for their signals."""
    query = F.expr("CASE WHEN turn % 5 = 4 THEN '' ELSE substring(text, 1, CAST(20 * (turn % 5) AS INT)) END")
    signals = F.size(F.regexp_extract_all(F.lower("q"), F.lit("([a-z]{5,})"), 1))
    rows = table(spark, sf_dir, "conversations").withColumn("q", query).select("conv_id", "turn", "q", scores.query_quality(F.col("q"), signals).alias("score"))
    return rows.select("conv_id", "turn", "score", scores.query_level(F.col("q"), F.col("score")).alias("level"))


@query(f"""WITH {PROTO}, s AS (SELECT vec_id AS asset_id, max({COS.format('embedding', 'q')}) FILTER (WHERE p.label < 5) AS pos, max({COS.format('embedding', 'q')}) FILTER (WHERE p.label >= 5) AS neg FROM embeddings, proto p GROUP BY vec_id)
SELECT asset_id, round(pos - neg, 4) AS margin, round(least(1::DOUBLE, greatest(0::DOUBLE, (pos - neg + 0.03::DOUBLE) / 0.11::DOUBLE)), 3) AS relation FROM s""")
def relation_margin(spark, sf_dir):
    pairs = recall.vector_scores(prototypes(spark, sf_dir).withColumn("query_id", F.col("label")), faces(spark, sf_dir))
    sides = pairs.groupBy("asset_id").agg(F.max(F.when(F.col("query_id") < 5, F.col("score"))).alias("pos"), F.max(F.when(F.col("query_id") >= 5, F.col("score"))).alias("neg"))
    margin = F.col("pos") - F.col("neg")
    return sides.select("asset_id", F.round(margin, 4).alias("margin"), F.round(scores.margin_score(margin), 3).alias("relation"))


BOX = "l_quantity * 4 AS x1, l_linenumber * 20.0::DOUBLE AS y1, l_quantity * 4 + 10 + l_discount * 500 AS x2, l_linenumber * 20.0::DOUBLE + 30 + l_tax * 400 AS y2"
PAIRS = f"b AS (SELECT l_orderkey AS k, l_linenumber AS i, {BOX} FROM lineitem), p AS (SELECT a.k, a.i, c.i AS j, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, c.x1 AS cx1, c.y1 AS cy1, c.x2 AS cx2, c.y2 AS cy2 FROM b a JOIN b c ON a.k = c.k AND a.i < c.i)"


def boxes(spark, sf_dir):
    y = F.col("l_linenumber") * F.lit(20.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") * 4).alias("x1"), y.alias("y1"), (F.col("l_quantity") * 4 + 10 + F.col("l_discount") * 500).alias("x2"), (y + 30 + F.col("l_tax") * 400).alias("y2"))


def _box_pairs(spark, sf_dir):
    a = boxes(spark, sf_dir)
    c = a.select("k", F.col("i").alias("j"), *[F.col(x).alias(f"c{x}") for x in ("x1", "y1", "x2", "y2")])
    return a.join(c, "k").filter("i < j")


@query(f"""WITH {PAIRS}, t AS (SELECT *, (ax1 + ax2) / 2 AS ax, (ay1 + ay2) / 2 AS ay, (cx1 + cx2) / 2 AS cx, (cy1 + cy2) / 2 AS cy,
  greatest(0.08::DOUBLE * (sqrt(greatest((ax2 - ax1) * (ay2 - ay1), 1)) + sqrt(greatest((cx2 - cx1) * (cy2 - cy1), 1))), 6) AS tol FROM p)
SELECT k, i, j, cx - ax > tol AS left_of, ax - cx > tol AS right_of, cy - ay > tol AS above, ay - cy > tol AS under, abs(cx - ax) > tol AS beside,
  ax1 >= cx1 AND ay1 >= cy1 AND ax2 <= cx2 AND ay2 <= cy2 AS inside FROM t""")
def bbox_relation(spark, sf_dir):
    a, c = [F.col(x) for x in ("x1", "y1", "x2", "y2")], [F.col(f"c{x}") for x in ("x1", "y1", "x2", "y2")]
    return _box_pairs(spark, sf_dir).select("k", "i", "j", *[scores.box_relation(r, a, c).alias(r) for r in ("left_of", "right_of", "above", "under", "beside", "inside")])


@query(f"""WITH {PAIRS}, t AS (SELECT *, greatest(0, least(ax2, cx2) - greatest(ax1, cx1)) * greatest(0, least(ay2, cy2) - greatest(ay1, cy1)) AS o, (ax2 - ax1) * (ay2 - ay1) AS a, (cx2 - cx1) * (cy2 - cy1) AS c FROM p)
SELECT k, i, j, round(o / (a + c - o), 3) AS iou, round(o / least(a, c), 3) AS containment FROM t""")
def iou_containment(spark, sf_dir):
    def xywh(p):
        return [F.col(f"{p}x1"), F.col(f"{p}y1"), F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")]

    iou, inside = scores.overlap(xywh(""), xywh("c"))
    return _box_pairs(spark, sf_dir).select("k", "i", "j", F.round(iou, 3).alias("iou"), F.round(inside, 3).alias("containment"))


@query()
def nms_fold(spark, sf_dir):
    box = F.struct((-(F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a"), F.col("i"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    grouped = boxes(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return grouped.select("k", F.transform(graph.non_max_suppression(F.col("boxes")), lambda b: b["i"]).alias("kept"))


EDGE = f"e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {COS.format('a.embedding', 'b.embedding')} > 0.35)"


def _face_labels(spark, sf_dir):
    return graph.similar_components(faces(spark, sf_dir).select("asset_id", "v"), 0.35)


COMPONENTS = f"{EDGE}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT u.b, r.seen FROM r JOIN u ON u.a = r.node), l AS (SELECT node, min(seen) AS label FROM r GROUP BY node)"


@query(f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT label, count(*) AS face_count FROM l GROUP BY label), n AS (SELECT *, row_number() OVER (ORDER BY face_count DESC, label) AS k FROM s)
SELECT node AS face_id, face_count, printf('person_%04d', k) AS person_id FROM l JOIN n USING (label)""")
def face_components(spark, sf_dir):
    return graph.numbered_clusters(_face_labels(spark, sf_dir)).select(F.col("node").alias("face_id"), "face_count", "person_id")


@query(f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT label, count(*) AS n FROM l GROUP BY label HAVING count(*) >= 2)
SELECT label, n, arg_min(vec_id, (-(embedding[1]::DOUBLE), vec_id)) AS prototype FROM s JOIN l USING (label) JOIN embeddings ON vec_id = node GROUP BY ALL""")
def prototype_pick(spark, sf_dir):
    members = _face_labels(spark, sf_dir).join(faces(spark, sf_dir).select(F.col("asset_id").alias("node"), F.col("v")[0].cast("double").alias("quality")), "node")
    return members.groupBy("label").agg(F.count("*").alias("n"), F.min_by("node", F.struct(-F.col("quality"), F.col("node"))).alias("prototype")).filter("n >= 2")


@query("""WITH RECURSIVE m AS (SELECT doc_id, unnest([source || ':' || lang, sha256(text)]) AS rule FROM documents),
u AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY rule) AS b FROM m), e AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
r(node, seen) AS (SELECT DISTINCT doc_id, doc_id FROM m UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node) SELECT node, min(seen) AS root FROM r GROUP BY node""")
def merge_rules(spark, sf_dir):
    return _merged(table(spark, sf_dir, "documents"))


def _merged(docs: DataFrame) -> DataFrame:
    """(node, root) of each document: the least that rules of equal source and language or of equal text reach."""
    rules = docs.select(F.col("doc_id").alias("node"), F.explode(F.array(F.concat("source", F.lit(":"), "lang"), F.sha2("text", 256))).alias("rule"))
    roots = rules.groupBy("rule").agg(F.min("node").alias("b"))
    links = rules.join(roots, "rule").select(F.col("node").alias("a"), "b")
    return graph.components(rules.select("node").distinct(), links).select("node", F.col("label").alias("root"))


@query()
def online_clusters(spark, sf_dir):
    rows = faces(spark, sf_dir).select(F.concat(F.lit("label_"), "label").alias("library"), F.col("asset_id").alias("face_id"), "v")
    return graph.online_clusters(rows, 0.25)


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND lower(source) LIKE '%1%' ORDER BY doc_id LIMIT 20 OFFSET 10")
def offset_select(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & F.lower("source").contains("1"))
    return rows.orderBy("doc_id").offset(10).limit(20).select("doc_id", "source")


@query("SELECT doc_id, lang, source, n_chars FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'labelled', quality::VARCHAR, toxic::BIGINT FROM labels")
def upsert_snapshot(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.col("quality").cast("string").alias("source"), F.col("toxic").cast("long").alias("n_chars"))
    return tags.upsert(old, new, ["doc_id"])


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def log_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))

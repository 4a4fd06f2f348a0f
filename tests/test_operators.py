import pytest
from pyspark.sql import functions as F

from lumora.functions import scores, texts, vectors
from lumora.operators import graph, recall, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalize(a)) == [0.6, 0.8]
    assert one(spark, vectors.normalize(z)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(a, z)) is None
    assert abs(one(spark, vectors.cosine(a, a)) - 1) < 1e-12


def test_texts(spark):
    assert one(spark, texts.clean_text(F.lit(" a　b\n!!!! ééé "))) == "a b ! ééé"
    assert one(spark, texts.clean_document_text(F.lit(" a  b \n\n c "))) == "a b\nc"
    assert one(spark, texts.html_unescape(F.lit("&amp;lt;"))) == "<"
    assert one(spark, texts.cjk_runs(F.lit("城市街道a咖b人物"))) == ["城市街道", "人物"]
    assert one(spark, texts.normalize_text_type(F.lit(" Whisper "))) == "asr"
    kind, engine = texts.split_engine(F.lit("nothing"))
    assert (one(spark, kind), one(spark, engine)) == ("ocr", "nothing")
    long = "x" * 95 + ". " + "y" * 300
    assert one(spark, texts.compact_text(F.lit(long))) == "x" * 95 + "."
    assert one(spark, texts.compact_text(F.lit("y" * 300))) == "y" * 260 + "..."


def test_scores(spark):
    assert abs(one(spark, scores.margin_score(F.lit(0.0))) - 0.03 / 0.11) < 1e-12
    assert one(spark, scores.archive_confidence(F.lit(1))) == 0.5
    box = [F.lit(float(x)) for x in (0, 0, 10, 10)]
    far = [F.lit(float(x)) for x in (50, 0, 60, 10)]
    assert one(spark, scores.box_relation("left_of", box, far)) and one(spark, scores.box_relation("beside", far, box))
    assert not one(spark, scores.box_relation("near", box, far))
    assert one(spark, scores.box_relation("inside", box, box))
    assert one(spark, scores.overlap(box, [F.lit(0.0)] * 4)[1]) == 0.0


def test_clusters(spark):
    nodes = spark.range(6).toDF("node")
    edges = spark.createDataFrame([(4, 1), (1, 2), (5, 3)], "a long, b long")
    rows = {r.node: (r.person_id, r.face_count) for r in graph.numbered_clusters(graph.components(nodes, edges)).collect()}
    assert rows == {0: ("person_0003", 1), 1: ("person_0001", 3), 2: ("person_0001", 3), 4: ("person_0001", 3), 3: ("person_0002", 2), 5: ("person_0002", 2)}


def test_online_clusters_take_equal_to_the_threshold(spark):
    faces = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 3, [0.0, 1.0])], "library string, face_id long, v array<double>")
    assert [r.cluster for r in graph.online_clusters(faces, 1.0).orderBy("face_id").collect()] == [0, 0, 1]


def test_topk_ties_and_union(spark):
    rows = spark.createDataFrame([(1, 9, 0.5), (1, 7, 0.5), (1, 8, 0.1)], "query_id long, asset_id long, score double")
    assert [r.asset_id for r in recall.topk(rows, 2).orderBy("rank").collect()] == [7, 9]
    both = recall.max_union([rows.withColumn("route", F.lit("vector")), rows.withColumn("route", F.lit("tag"))])
    assert {r.route for r in both.collect()} == {"tag"}


def test_tags(spark):
    edges = spark.createDataFrame([(1, "cat", "text"), (1, "image", "text"), (1, "dog", "fusion"), (1, "a", "text")], "asset_id long, tag string, source string")
    assert tags.fuse(edges).first().tags == ["cat"]
    new = spark.createDataFrame([(1, "cow", "text")], "asset_id long, tag string, source string")
    assert sorted(r.tag for r in tags.replace_source(edges, new).collect()) == ["cow", "dog"]


def test_online_clusters_against_the_rule(spark):
    import numpy as np

    from lumora.operators import graph

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 8))
    centres, counts, want = [], [], []
    for v in vectors:
        v = v / np.linalg.norm(v)
        sims = [float(c @ v) for c in centres]
        k = int(np.argmax(sims)) if sims else -1
        if k >= 0 and sims[k] >= 0.5:
            counts[k] += 1
            mean = (centres[k] * (counts[k] - 1) + v) / counts[k]
            centres[k] = mean / np.linalg.norm(mean)
        else:
            k = len(centres)
            centres.append(v)
            counts.append(1)
        want.append(k)
    faces = spark.createDataFrame([("l", k, v.tolist()) for k, v in enumerate(vectors)], "library string, face_id long, v array<double>").repartition(3)
    got = {r.face_id: r.cluster for r in graph.online_clusters(faces, 0.5).collect()}
    first = {}
    numbered = [first.setdefault(got[k], len(first)) for k in range(500)]
    assert numbered == want


def test_similar_pairs_over_several_tiles(spark, monkeypatch):
    import numpy as np

    from lumora.operators import recall

    monkeypatch.setattr(recall, "TILE", 30)
    v = np.random.default_rng(4).normal(size=(100, 6))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(100) for b in range(a + 1, 100) if unit[a] @ unit[b] > 0.6}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "asset_id long, v array<double>")
    got = recall.similar_pairs(df, 0.6).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert recall.similar_pairs(df.limit(0), 0.6).count() == 0


@pytest.mark.parametrize("threshold", [0.35, 0.7, 0.9, 1.1])
def test_similar_components_over_several_tiles(spark, monkeypatch, threshold):
    import numpy as np

    from lumora.operators import recall

    monkeypatch.setattr(recall, "TILE", 17)
    v = np.random.default_rng(5).normal(size=(150, 6))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near, want = unit @ unit.T > threshold, list(range(150))
    while (new := [min([want[k], *(want[j] for j in np.flatnonzero(near[k]))]) for k in range(150)]) != want:
        want = new
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(150, None)], "asset_id long, v array<double>").repartition(4)
    got = sorted(graph.similar_components(df, threshold).collect())
    assert [tuple(r) for r in got] == list(enumerate([*want, 150]))
    assert graph.similar_components(df.limit(0), threshold).count() == 0


def test_similar_components_write_trees_not_links(spark, tmp_path, monkeypatch):
    written, real = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: written.append(real(df)) or written[-1])
    # 3000 equal vectors have 4.5 million links, which were all written before.
    df = spark.range(3000).selectExpr("id AS asset_id", "array(1.0D, 2.0D) AS v")
    assert {r.label for r in graph.similar_components(df, 0.5).collect()} == {0}
    assert max(x.count() for x in written) < 100


def test_containment_of_long_and_short_terms(spark):
    from lumora.operators import recall

    texts = ["one two three four five six", "xone two three four fivey", "two  three four", "", None, "six"]
    terms = ["one two three four five", "two three", "six", "three four five six seven"]
    docs, items = (spark.createDataFrame(list(enumerate(x)), f"{n} long, {t} string") for x, n, t in ((texts, "doc_id", "text"), (terms, "item_id", "term")))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(terms) if t is not None and x in t}
    assert {tuple(r) for r in recall.containments(docs.filter("text IS NOT NULL"), items).collect()} == want


def test_prototype_pick_writes_no_links(spark, tmp_path, monkeypatch):
    from lumora.plans import catalog

    written, real = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: written.append(real(df)) or written[-1])
    spark.range(600).selectExpr("id AS vec_id", "array(float(1 + id % 2), float(2)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalog.prototype_pick(spark, str(tmp_path)).collect()]
    assert got == [(0, 600, 1)] and max(x.count() for x in written) < 100


def test_similar_components_neither_shuffle_nor_copy_the_vectors(spark, monkeypatch):
    import numpy as np

    from lumora.operators import recall

    plans, written, real = [], [], graph._kept

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(real(df))
        return written[-1]

    monkeypatch.setattr(graph, "_kept", kept)
    monkeypatch.setattr(recall, "TILE", 17)

    def run(rows):
        plans.clear(), written.clear()
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rows)], "asset_id long, v array<double>").repartition(3)
        return dict(graph.similar_components(df, 0.5).collect()), [x for x in written if "m" in x.columns]

    eye = np.eye(60)
    # 50 equal vectors and ten that stand alone: only these are written again, and no tile is dealt out by its number.
    labels, held = run(np.concatenate([eye[:1].repeat(50, 0), eye[50:]]))
    assert labels == {k: 0 if k < 50 else k for k in range(60)} and len(held) == 2
    assert sum(len(r.labels) // 8 for r in held[1].collect()) == 10
    (plan,) = [p for p in plans if "outside(" in p]
    assert "Exchange" not in plan and "CartesianProduct" in plan
    # All stand alone: the tiles are not copied.
    labels, held = run(eye)
    assert labels == {k: k for k in range(60)} and len(held) == 1


def test_components_write_no_nodes_without_edges(spark, monkeypatch):
    written, real = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: written.append(real(df)) or written[-1])
    edges = spark.createDataFrame([(3, 7), (7, 9)], "a long, b long")
    got = dict(graph.components(spark.range(200).toDF("node"), edges).collect())
    assert got == {k: 3 if k in (3, 7, 9) else k for k in range(200)}
    assert max(x.count() for x in written) < 10

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumora.operators import persons
from lumora.sources import files
from lumora.streaming import logs


def test_index_defaults(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"id": "a", "filename": "a.jpg", "vector": [1.0]}]))
    row = files.read_index(spark, str(tmp_path / "index.json")).first()
    assert (row.library, row.vector_model, row.vector) == ("public", "lite-visual-v1", [1.0])


def test_signals_round_trip_and_rejects(spark, tmp_path):
    known = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    rows = [("a", "asr", 'say "hi"\nthere', "w", 0.123456), ("b", "ocr", "x", "w", None)]
    files.write_signals(spark.createDataFrame(rows, "asset_id string, text_type string, text string, engine string, confidence double"), str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("*.csv"))
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in parts)
    good, bad = files.read_text_signals(spark, str(tmp_path / "s"), known)
    assert sorted((r.asset_id, r.text, r.confidence) for r in good.collect()) == [("a", 'say "hi"\nthere', 0.1235), ("b", "x", None)]
    assert bad.isEmpty()
    (tmp_path / "t.csv").write_bytes("\ufeffasset_id,text_type,text,engine,confidence\nz,ocr,q,e,\na,ocr,q,e,high\na,ocr,,e,\n".encode())
    good, bad = files.read_text_signals(spark, str(tmp_path / "t.csv"), known)
    assert [(r.asset_id, r.text) for r in good.collect()] == [("a", "")]
    assert sorted((r.asset_id, r.error) for r in bad.collect()) == [("a", "confidence is no number"), ("z", "unknown asset")]
    (tmp_path / "o.csv").write_bytes("\ufeffasset_id,text,confidence\n z , q ,\n,x,1\ny, ,1\n".encode())
    assert [tuple(r) for r in files.read_ocr_rows(spark, str(tmp_path / "o.csv")).collect()] == [("z", "q", "manual-ocr", None)]


def test_annotations(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"categories": [{"id": 1, "name": "cat"}], "annotations": [{"image_id": 7, "category_id": 1}] * 2 + [{"image_id": 8, "category_id": 1}, {"image_id": 1234567890123, "category_id": 1}]}))
    (tmp_path / "c.json").write_text(json.dumps({"annotations": [{"image_id": 8, "caption": "u"}, {"image_id": 7, "caption": "v"}, {"image_id": 7, "caption": "w"}]}))
    known = spark.createDataFrame([("000000000007", "000000000007.jpg"), ("1234567890123", "x.jpg")], "asset_id string, filename string")
    assert sorted(tuple(r) for r in files.read_instances(spark, str(tmp_path / "i.json"), known).collect()) == [("000000000007", "cat"), ("1234567890123", "cat")]
    assert [r.caption for r in files.read_captions(spark, str(tmp_path / "c.json"), known, 1).collect()] == ["v"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("城市".encode("gbk"))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        for n, text in ((2, "second"), (1, "&amp;lt;first&amp;gt;")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="u"><a:t>{text}</a:t></p>')
    rows = {r.path[-5:]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "城市" and rows[".pptx"].text == "<first>\nsecond"
    assert rows[".docx"].error and rows["a.txt"].error is None


def test_log_and_report(spark, tmp_path):
    plans = spark.createDataFrame([(1, "cat"), (2, "dog")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.75)], "query_id long, rank int, asset_id string, score double")
    for _ in range(2):
        files.append_log(hits, plans, str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).orderBy("query_id").collect()
    assert [r.top_score for r in rows] == [0.75, 0.75, None, None]
    assert [h["asset_id"] for h in json.loads(rows[0].results_json)] == ["a", "b"] and rows[2].results_json == "[]"
    files.write_report(plans, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


@pytest.fixture()
def people(spark):
    p = [("p1", "personal", None, "Ann", 2, "f1"), ("p2", "personal", "B", None, 1, "f3"), ("p3", "public", None, None, 9, "x")]
    f = [("f1", "a", "p1", 0.5), ("f2", "b", "p1", 0.9), ("f3", "a", "p2", 0.9)]
    return (
        spark.createDataFrame(p, "person_id string, library string, alias string, display_name string, face_count int, prototype_face_id string"),
        spark.createDataFrame(f, "face_id string, asset_id string, person_id string, quality double"),
    )


def counts(p):
    return {r.person_id: (r.face_count, r.prototype_face_id) for r in p.collect()}


def test_person_mutations(spark, people):
    p, f = people
    assert counts(persons.merge(p, f, "p1", ["p2", "p1", ""])[0]) == {"p1": (3, "f2"), "p3": (9, "x")}
    assert persons.merge(p, f, "p1", ["p1"]) == (p, f)
    assert counts(persons.remove_from_asset(p, f, "a", "p2")[0]) == {"p1": (2, "f1"), "p3": (9, "x")}
    assert counts(persons.remove_from_asset(p, f, "b", "p1")[0])["p1"] == (1, "f1")
    gone = persons.delete(p, f, "p1")
    assert set(counts(gone[0])) == {"p2", "p3"} and gone[1].count() == 1
    left = persons.clean_up(p, f, spark.createDataFrame([("b",)], "asset_id string"))
    assert counts(left[0]) == {"p1": (1, "f2"), "p3": (9, "x")} and left[1].count() == 1
    assert [t.count() for t in persons.delete_asset("a", f)] == [1]


def test_person_names(spark, people):
    p, f = people
    row = persons.rename(p, "p1", " Eve ").filter("person_id = 'p1'").first()
    assert (row.alias, row.display_name) == ("Eve", "Eve")
    assert persons.rename(p, "p1", " ").filter("person_id = 'p1'").first().display_name is None
    with pytest.raises(ValueError):
        persons.rename(p, "p3", "Eve")
    new = p.filter("person_id = 'p2'").withColumns({"alias": F.lit(""), "face_count": F.lit(5)})
    got, faces = persons.replace_library(p, f, new, f.filter("face_id = 'f1'"))
    assert {r.person_id: (r.alias, r.face_count) for r in got.collect()} == {"p2": ("B", 5), "p3": (None, 9)}
    assert [r.face_id for r in faces.collect()] == ["f1"]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    rows = spark.createDataFrame([(i, i * 900, "ab"[i % 2], float(i)) for i in range(40)], "event_id long, s long, event_type string, value double")
    rows = rows.select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    run = logs.windowed(logs.event_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("event_windows").outputMode("complete")
    run.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batch = rows.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, spark.table("event_windows").collect())) == sorted(map(tuple, batch.collect()))


def test_landed_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" a  b \n\n c ")
    run = logs.landed_texts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").outputMode("append")
    run.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [r.text for r in spark.table("landed").collect()] == ["a b\nc"]

"""Readers of asset lists, text signals, annotations and documents; writers of signals, reports and the search log."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.texts import clean_document_text, normalize_text_type, zero_filled

INDEX = "id string, filename string, path string, kind string, library string, created_at string, width int, height int, vector array<double>, vector_model string"
SIGNAL = "asset_id string, text_type string, text string, engine string, confidence string"
#: What a file is decoded as, in this order; the last one always succeeds.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "latin-1")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of assets; a missing library is public, a missing model lite-visual-v1."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path)
    return rows.withColumns({"library": F.coalesce("library", F.lit("public")), "vector_model": F.coalesce("vector_model", F.lit("lite-visual-v1"))})


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)


def _confidence(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def read_text_signals(spark: SparkSession, path: str, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals of known assets, and the rejected rows with the reason. A blank confidence is null. Texts are
    stored as they are, blank ones too."""
    rows = _csv(spark, path, SIGNAL).join(assets.select("asset_id", F.lit(True).alias("_known")).distinct(), "asset_id", "left")
    blank = F.coalesce(F.trim("confidence"), F.lit("")) == ""
    reason = F.when(F.col("_known").isNull(), "unknown asset").when(~blank & _confidence(F.col("confidence")).isNull(), "confidence is no number")
    marked = rows.withColumn("error", reason)
    signals = marked.filter("error IS NULL").select(
        "asset_id",
        normalize_text_type(F.coalesce("text_type", F.lit("ocr"))).alias("text_type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("engine", F.lit("csv-import")).alias("engine"),
        _confidence(F.col("confidence")).alias("confidence"),
    )
    return signals, marked.filter("error IS NOT NULL").select(F.coalesce("asset_id", F.lit("")).alias("asset_id"), "error")


def read_ocr_rows(spark: SparkSession, path: str, engine: str = "manual-ocr") -> DataFrame:
    """Rows with an id and a text, whether or not the asset is known; both are trimmed."""
    rows = _csv(spark, path, "asset_id string, text string, confidence string")
    out = rows.select(F.trim("asset_id").alias("asset_id"), F.trim("text").alias("text"), F.lit(engine).alias("engine"), _confidence(F.col("confidence")).alias("confidence"))
    return out.filter("asset_id <> '' AND text <> ''")


def read_instances(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """asset_id, tag: the distinct categories of each known image; its id is padded to 12 digits, never cut."""
    schema = "categories array<struct<id: long, name: string>>, annotations array<struct<image_id: long, category_id: long>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    names = raw.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("tag"))
    marks = raw.select(F.inline("annotations")).select(zero_filled(F.col("image_id"), 12).alias("asset_id"), "category_id")
    return marks.join(names, "category_id").join(assets.select("asset_id"), "asset_id", "left_semi").select("asset_id", "tag").distinct()


def read_captions(spark: SparkSession, path: str, assets: DataFrame, limit: int) -> DataFrame:
    """The first `limit` captions in file order whose image is a known filename."""
    schema = "annotations array<struct<image_id: long, caption: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("annotations").alias("position", "a")).select("position", "a.*")
    named = rows.withColumn("filename", F.concat(zero_filled(F.col("image_id"), 12), F.lit(".jpg")))
    return named.join(assets.select("filename"), "filename", "left_semi").orderBy("position").limit(limit)


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return ""


def office_text(content: bytes, slides: bool) -> str:
    """The text nodes of a document's parts in the archive's order, or of a presentation's slides by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        wanted = re.compile(r"ppt/slides/slide.*\.xml" if slides else r"word/.*\.xml", re.DOTALL)
        names = [n for n in archive.namelist() if wanted.fullmatch(n)]
        nodes = (e for n in (sorted(names) if slides else names) for e in ElementTree.fromstring(archive.read(n)).iter() if e.tag.rpartition("}")[2] == "t")
        # Marks that were escaped twice are decoded twice.
        texts = "\n".join("".join(e.itertext()) for e in nodes)
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        texts = texts.replace(entity, mark)
    return texts


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts, errors = [], []
        for path, content in zip(b["path"], b["content"]):
            suffix, text, error = path.rpartition(".")[2].lower(), "", None
            try:
                text = office_text(content, suffix == "pptx") if suffix in ("docx", "pptx") else decoded(content)
            except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                error = str(e)
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": b["path"], "text": texts, "error": errors})


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """path, text, error of the .txt, .md, .docx and .pptx files of a directory, one row each; a broken file has an error and
    an empty text. Other suffixes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,docx,pptx}").load(directory).select("path", "content")
    return files.mapInPandas(_extract, "path string, text string, error string").withColumn("text", clean_document_text(F.col("text")))


def write_signals(signals: DataFrame, path: str) -> None:
    """CSV with a byte order mark before the header of each file; confidence has 4 places or is blank."""
    rows = signals.select("asset_id", "text_type", "text", "engine", F.round("confidence", 4).alias("confidence"))
    rows.withColumnRenamed("asset_id", "\ufeffasset_id").write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(results: DataFrame, plans: DataFrame, path: str) -> None:
    """One Parquet row per query: the plan and its results (query_id, rank, asset_id, score) as JSON, and the first score."""
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "asset_id", "score"))).alias("hits"))
    rows = plans.join(listed, "query_id", "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<rank: int, asset_id: string, score: double>>"))
    rows.select("query_id", "query", F.to_json(F.struct(*plans.columns)).alias("plan_json"), F.to_json(hits).alias("results_json"), F.get(F.col("hits"), F.lit(0))["score"].alias("top_score")).write.mode("append").parquet(path)

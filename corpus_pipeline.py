"""From raw documents to token ids: reject, deduplicate, cut repeats, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.bpe import encode_decode, vocabulary
from lumora.llm.common import documents, written
from lumora.llm.decontamination import without_passages
from lumora.llm.ngram_join import link_documents
from lumora.llm.packs import REST, from_rest, rows_of, with_rest
from lumora.llm.quality_classifier import without_rejected
from lumora.llm.substring_dedup import remove_repeats

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_rejected(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, the first of equal ids. Documents without
    words stay, and so does every row with a null doc_id."""
    packs, linked = link_documents(with_rest(docs), SHINGLE, PERCENT, REST)
    alone = F.when(F.col("doc_id").isNull(), F.col("node"))
    first = linked.groupBy("component", alone.alias("alone")).agg(F.min_by("node", F.struct("doc_id", "node")).alias("node"))
    return from_rest(rows_of(packs, first.select("node")), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start in an earlier document are cut out; what nothing is left of goes. n_chars follows the text."""
    cut = remove_repeats(with_rest(docs), REST).filter("n_removed = 0 OR n_removed < n_words")
    rows = from_rest(cut.select("doc_id", F.col("kept_text").alias("text"), "more"), docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of the ids and of the decoded text."""
    coded = encode_decode(docs, vocabulary("word_bpe_49k.json"), with_ids=True)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return coded.withColumn("token_ids", ids).drop("ids", "decoded")


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_join", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", uncontaminated),
    ("bpe", token_ids),
]

#: The classifier, the alignment and the encoder have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""What the training-data operators share: reading, word splitting and durable checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of texts that go to a Python worker at once, where the session does not say otherwise.
ROWS_AT_ONCE = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Spark's usual 10 000 rows of them fill tens of megabytes in the executor and in each worker. A value
    that the user has set is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_AT_ONCE)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The id, the text (null: empty) and the named columns; all else in `docs` is left behind."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. It is set here only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else None
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumora-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def commonest(counts: DataFrame, name: str, n: str, most: int) -> DataFrame:
    """The `most` rows of the greatest counts `n`, of equal ones those of the least `name`. The count from which rows count
    is found among the numbers of rows by count, so that no more than about `most` rows are ever sent on to be sorted."""
    cut, above = 0, 0
    for r in counts.groupBy(n).agg(F.count("*").alias("rows")).orderBy(F.desc(n)).limit(most).collect():
        cut = r[n]
        if above + r.rows >= most:
            break
        above += r.rows
    ties = counts.filter(F.col(n) == cut).orderBy(name).limit(most - above)
    return counts.filter(F.col(n) > cut).unionByName(ties)


def blocks_for(docs: DataFrame, block_bytes: int, least: int = 1) -> int:
    """How many blocks of about `block_bytes` of text hold `docs`; grows with the data, never capped."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // block_bytes))

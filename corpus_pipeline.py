"""Corpus pipeline: the stages turn `documents` into a deduplicated, mixed and tokenised corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; `run` does so in the shared folder of the session.  All stages but the
last return the columns of `documents`.  Stages whose last step runs Python workers write their result
themselves, in small Arrow batches, and leave the session's options as they were; the next stage removes
such a table if it was given another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelry.llm import byte_bpe, jaccard_join, kneser_ney, mixing, quality_rules
from pixelry.llm.textbuf import dropped, free_name, saved, small

#: Rows of an Arrow batch between Spark and the Python workers: a batch of whole texts is held on both sides.
BATCH_ROWS = 1_000
_OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The table that the last stage with Python in its last step has left in the shared folder.
_left: list[DataFrame] = []


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_OPTION)
    spark.conf.set(_OPTION, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_OPTION, before)


def finished(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, made while small batches hold."""
    _left[:] = [saved(df, f"stage-{name}")]
    return _left[0]


def let_go(docs: DataFrame) -> None:
    """Remove the last stage's table if docs is another one: what it returned was written and read again elsewhere."""
    if _left and _left[0].sparkSession.sparkContext is docs.sparkSession.sparkContext:
        row = docs.select(F.input_file_name().alias("file")).head()
        if row is not None and _left[0].saved_path.removeprefix("file://") not in row.file:
            dropped(_left.pop())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and empty texts, languages without a limit and an empty table stay as they are; repeated rows share
    their fate; an empty `labels` gives no model and keeps all.
    """
    let_go(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):
        return finished(kneser_ney.classify(docs, labels).where("kept").select(docs.columns), "quality")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines of more than MAX_DOCS documents of their source, however large it is.

    Null, empty and short texts fail the rules; rows without a source share one; n_chars is counted anew only
    where lines went.
    """
    let_go(docs)
    with small_batches(spark):
        judged = quality_rules.apply_rules(docs).where("kept").withColumn("text", F.col("clean_text"))
        judged = judged.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return finished(judged.select(docs.columns), "rules")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id (rows without an id come last).

    Rows are told apart by a number, so different texts that share an id are judged each for itself, and of
    repeated rows one stays.  Rows without words are alone in their groups and all stay; an empty table
    stays empty.
    """
    let_go(docs)
    row = free_name(docs.columns, "row")
    with small_batches(spark):
        numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        classes = jaccard_join.near_duplicates(numbered, doc_id=row, links=False)
    found = saved(classes.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row"), "near-duplicates")
    dropped(classes)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = found.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = found.join(groups, "component_id").where("row <> first.row").select(F.col("row").alias(row))
    return numbered.join(small(copies), row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample weighted towards the target shares of sources, languages and topics; probabilities cut at 1 keep it from meeting them.

    Null values are values of their own; texts without words are not sampled; rows of one id share their fate.
    """
    let_go(docs)
    return mixing.mix(docs).where("sampled").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document; a null or empty text has none; each row gives a row."""
    let_go(docs)
    with small_batches(spark):
        ids = byte_bpe.encode(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        return finished(ids.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids"), "tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

#: Several stages (language model, iterative fitting, BPE) are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, made = docs, stage(spark, docs, sf_dir)
        docs = made if made in _left else saved(made, f"stage-{name}")
        if "saved_path" in vars(before):
            dropped(before)
    return docs

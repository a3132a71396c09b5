"""The corpus pipeline: quality classifier, near duplicates, repeated lines, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.packing import pack
from quarry.llm.quality import classify
from quarry.llm.queries import id_remainder
from quarry.llm.substring import RUN_WORDS, remove_repeats
from quarry.session import ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of this stage's documents, doesn't reject.

    A null or empty text has a score like any other; a row with a null doc_id has one but no label; repeated rows are
    judged alike. Columns of the caller named score or predicted are kept as they are. An empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))  # names can't clash
    scored = classify(rows, labels, train=id_remainder("doc_id", 4) != 2, text="_text", keep=["doc_id", "_row"])
    return scored.where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the
    one with the smallest doc_id. Rows that repeat a doc_id stay or go together; rows with a null doc_id and texts
    that are null, empty or without words stay. An empty table gives no rows."""
    found = jaccard_components(docs, width=5, num=80, den=100)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines and passages of over 50 words that stand in an earlier document (or place);
    n_chars is renewed. A null text stays null; a document whose whole text goes stays with an empty one; rows that
    repeat doc_id and text get the same cuts. Other columns are kept, whatever their names. An empty table gives no rows."""
    spans = "_removed"
    while spans in docs.columns:
        spans += "_"
    out = remove_repeats(docs, run_words=RUN_WORDS, removed=spans).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents packed into sequences of 2048 tokens, with their ids. A null or empty text has its
    end token only; every row is a document. An empty table gives no rows."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", repeated_lines), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept as Parquet in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer can't be written in SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None

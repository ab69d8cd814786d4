"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_id, line_dedup, sentence_pieces
from quillspark.llm.decontaminate import leaks
from quillspark.llm.graph import shared_folder
from quillspark.llm.minhash_dedup import near_duplicates


def _unique(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) one of the ids; a null id is never one."""
    ids = ids.select(F.col("id").alias("__wanted"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__wanted"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and null ones (``und``); sets lang to the prediction.

    The model learns from the rows that carry a language, as op4 does. Each row is judged by
    itself, whatever its id. An empty table stays empty.
    """
    model = language_id.fit(docs.where(language_id.fold_of("doc_id") != 0), "text", "lang", "doc_id")
    found = language_id.annotate(docs, model, "text", "__lang", "__score").where("__lang <> 'und'")
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated multi-line chunks; the text and n_chars follow, every row stays."""
    found = line_dedup.drop_repeated_chunks(docs)
    fresh = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate group; texts without words stay."""
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("id").distinct()
    return _unique(docs, gone, "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents in which a benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = leaks(docs, items).select("id").where("id is not null").distinct()
    return _unique(docs, gone, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256: the ids and the digest of the text they decode to."""
    both = sentence_pieces.round_trip(docs, sentence_pieces.Vocabulary.load())
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("sentence_pieces", encode_pieces),
]

#: Language models, edit distances and tokenizers are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see."""
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""The registered queries of the dealt operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fill_in_middle, html_extract, language_id, line_dedup, minhash_dedup, mixture, mpeg_audio, prefix_trie, quality, sentence_pieces, substring_dedup, suffix_dedup
from quillspark.llm.decontaminate import leaks
from quillspark.llm.minhash_dedup import near_duplicates
from quillspark.llm.substring_dedup import repeated_windows
from quillspark.llm.suffix_dedup import repeated_bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(language_id.fold_of("doc_id") == 0, F.lit(False)))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(_table(spark, sf_dir, "documents"), length=50)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.fold_of("doc_id") != 0), "text", "lang", "doc_id")
    found = language_id.predict(docs, model).withColumnRenamed("id", "doc_id")
    return _held_out(found).select("doc_id", "held_out", "lang_pred", "score")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = _table(spark, sf_dir, "documents"), sentence_pieces.Vocabulary.load()
    both = sentence_pieces.round_trip(docs, vocabulary)
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows(_table(spark, sf_dir, "documents"), window=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.read(mpeg_audio.store(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_chunks(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(language_id.fold_of("doc_id") != 0))
    found = quality.score(docs, weights).withColumnRenamed("id", "doc_id")
    return _held_out(found).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture.mixture(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixture": op12_mixture,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op3_minhash_dedup": minhash_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_mixture": mixture.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

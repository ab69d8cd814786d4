"""Corpus mining: boilerplate, repeated blocks and lines, deleted vocabulary, page chrome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.measures import TokenCounter, boilerplate_reasons, token_count
from quillspark.operators.generators import explode_blocks, explode_html, explode_words, posexplode_once, squash


def block_key(block: Column) -> Column:
    """16 bytes that stand for a block's text."""
    return F.substring(F.unhex(F.sha2(block, 256)), 1, 16)


def discover_boilerplate(
    df: DataFrame, tenant: str, record: str, conversation: str, text: str, unit: str = "paragraph",
    min_records: int = 50, min_fraction: float = 0.30, min_conversations: int = 2, min_tokens: int = 8, count: TokenCounter = token_count, only_eligible: bool = False,
) -> DataFrame:
    """One row for each tenant and block: counts, fraction, tokens, eligible, ordered reasons.

    Occurrences are counted by a 128-bit digest of the block; its text crosses the network once,
    after each task has kept one copy, and the heavy tests run once for each distinct block.
    ``only_eligible`` leaves out blocks that fail on their counts before those tests.
    ``rejection_reasons`` is joined by commas. Rows without a tenant belong to none.
    """
    rows = df.select(F.col(tenant).alias("tenant"), F.col(record).alias("record"), F.col(conversation).alias("conversation"), F.col(text).alias("text"))
    totals = rows.groupBy("tenant").agg(F.count("*").alias("total"))
    blocks = explode_blocks(rows, "text", unit).withColumn("key", block_key(F.col("block")))
    # Both kinds of partner in one pass; of each row one is null.
    partners = blocks.select("tenant", "key", "record", "conversation", F.explode(F.array(F.lit(True), F.lit(False))).alias("of_record"))
    seen = partners.select("tenant", "key", "of_record", F.when(F.col("of_record"), F.col("record")).alias("record"), F.when(~F.col("of_record"), F.col("conversation")).alias("conversation")).distinct()
    counts = seen.groupBy("tenant", "key").agg(F.count_if("of_record").alias("record_count"), F.count("conversation").alias("conversation_count"))
    # A key has one text; an aggregate that takes the first of a group would sort the texts.
    texts = blocks.select("tenant", "key", "block").distinct()
    each = counts.join(totals, "tenant").withColumn("record_fraction", F.round(F.col("record_count") / F.col("total"), 6))
    if only_eligible:
        each = each.where((F.col("record_count") >= min_records) & (F.col("record_fraction") >= min_fraction) & (F.col("conversation_count") >= min_conversations))
    each = each.join(texts, ["tenant", "key"]).withColumn("tokens", count(F.col("block")))
    early = [
        F.when(F.col("record_count") < min_records, "below_minimum_records"),
        F.when(F.col("record_fraction") < min_fraction, "below_minimum_fraction"),
        F.when(F.col("conversation_count") < min_conversations, "single_conversation_only"),
        F.when(F.col("tokens") < min_tokens, "below_minimum_token_savings"),
    ]
    reasons = F.concat(F.filter(F.array(*early), lambda x: x.isNotNull()), boilerplate_reasons(F.col("block")))
    out = each.withColumn("reasons", reasons)
    if only_eligible:
        out = out.where(F.size("reasons") == 0)
    return out.select("tenant", "block", "record_count", "conversation_count", "record_fraction", "tokens", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", ",").alias("rejection_reasons"))


def rank_candidates(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("record_count"), F.desc("tokens"), "block", "tenant")


def duplicate_blocks(df: DataFrame, doc_id: str, text: str, unit: str = "line", min_tokens: int = P.DUPLICATE_BLOCK_TOKENS, count: TokenCounter = token_count) -> DataFrame:
    """For each document: extra occurrences, tokens and characters of blocks that repeat in it."""
    each = explode_blocks(df.select(doc_id, text), text, unit).groupBy(doc_id, "block").agg(F.count("*").alias("n")).where("n > 1")
    each = each.withColumn("tokens", count(F.col("block"))).where(F.col("tokens") >= min_tokens)
    extra = F.col("n") - 1
    return each.groupBy(doc_id).agg(F.sum(extra).alias("extra"), F.sum(extra * F.col("tokens")).alias("extra_tokens"), F.sum(extra * F.length("block")).alias("extra_chars"))


def duplicate_lines(df: DataFrame, doc_id: str, text: str, min_chars: int = 20) -> DataFrame:
    """For each document: repeated lower-cased lines and their characters."""
    rows = posexplode_once(df.select(doc_id, text), F.split(F.col(text), "\n"), "pos", "line").where(F.length(F.trim("line")) >= min_chars)
    each = rows.groupBy(doc_id, F.lower(squash(F.col("line"))).alias("line")).agg(F.count("*").alias("n")).where("n > 1")
    return each.groupBy(doc_id).agg(F.sum(F.col("n") - 1).alias("duplicate_lines"), F.sum((F.col("n") - 1) * F.length("line")).alias("duplicate_chars"))


def word_counts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return explode_words(df.select(doc_id, text), text).groupBy(doc_id, "word").agg(F.count("*").alias("n"))


def deleted_words(before: DataFrame, after: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, word, n: how often fewer a word occurs after than before."""
    a, b = word_counts(before, doc_id, text), word_counts(after, doc_id, text).withColumnRenamed("n", "m")
    return a.join(b, [doc_id, "word"], "left").select(doc_id, "word", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


def deleted_words_top(before: DataFrame, after: DataFrame, doc_id: str, text: str, n: int = 50) -> DataFrame:
    each = deleted_words(before, after, doc_id, text).groupBy("word").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    return each.orderBy(F.desc("occurrences"), "word").limit(n)


def safety_category(word: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, terms in P.SAFETY_TERMS.items():
        found = F.when(word.isin(*terms), name).otherwise(found)
    return found


def safety_deletions(before: DataFrame, after: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each category of safety words: deleted tokens and affected documents."""
    each = deleted_words(before, after, doc_id, text).withColumn("category", safety_category(F.col("word"))).where("category is not null")
    per = each.groupBy("category", doc_id).agg(F.sum("n").alias("n"))
    return per.groupBy("category").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))


def page_chrome(pages: DataFrame, page_id: str, url: str, html: str, min_pages: int = 3) -> DataFrame:
    """Links, list items and comments that recur on several pages of a host."""
    rows = explode_html(pages.select(page_id, F.regexp_extract(F.col(url), r"^https?://([^/]+)", 1).alias("host"), html), html)
    some = rows.where(F.col("kind").isin("link", "item", "comment")).select("host", "kind", "piece", page_id).distinct()
    return some.groupBy("host", "kind", "piece").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)

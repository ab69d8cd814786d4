"""Chat histories: duplicate and empty parts, roles, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.measures import role_policy, token_count


def compact_duplicates(parts: DataFrame, conversation: str, order: list[str], text: str, role: str | None = None) -> DataFrame:
    """Adds ``duplicate``: a byte-identical, non-empty (user) part that came before in the conversation."""
    mine = F.lit(True) if role is None else F.lower(F.col(role)) == "user"
    real = mine & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy(conversation, F.when(real, F.xxhash64(text)), F.when(real, F.col(text))).orderBy(*order))
    return parts.withColumn("duplicate", real & (nth > 1))


def regroup_messages(parts: DataFrame, conversation: str, turn: str, part: str, role: str, text: str) -> DataFrame:
    """conversation, turn, role, parts, kept_parts (their texts in order), dropped, reason, kept for each message.

    Parts repeated in a conversation's user messages go (see ``compact_duplicates``), and the rest are put
    back together in order. A user message without text goes as ``empty_user_message_dropped``; one whose
    text was all said before as ``duplicate_user_text_dropped``; others have no reason. Null texts are no parts.
    """
    told = compact_duplicates(parts.where(F.col(text).isNotNull()), conversation, [turn, part], text, role)
    said = F.trim(text) != ""
    kept = F.filter(F.collect_list(F.when(~F.col("duplicate"), F.struct(part, text))), lambda x: x.isNotNull())
    each = told.groupBy(conversation, turn, role).agg(
        F.count("*").alias("parts"), F.transform(F.array_sort(kept), lambda x: x[text]).alias("kept_parts"), F.count_if("duplicate").alias("dropped"),
        F.bool_or(said).alias("__said"), F.bool_or(said & ~F.col("duplicate")).alias("__new"),
    )
    user = F.lower(F.col(role)) == "user"
    reason = F.when(user & ~F.col("__said"), "empty_user_message_dropped").when(user & ~F.col("__new"), "duplicate_user_text_dropped")
    return each.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("__said", "__new")


def compact_empty(messages: DataFrame, role: str, text: str) -> DataFrame:
    """Drops user messages without text."""
    return messages.where(~((F.lower(F.col(role)) == "user") & (F.trim(F.coalesce(F.col(text), F.lit(""))) == "")))


def message_totals(messages: DataFrame, conversation: str, role: str, text: str, after: str) -> DataFrame:
    """For each conversation: messages, tokens in and out, by user and preserved, ratio."""
    rows = messages.withColumn("__in", token_count(F.col(text))).withColumn("__out", token_count(F.col(after)))
    user = F.lower(F.col(role)) == "user"
    sums = rows.groupBy(conversation).agg(F.count("*").alias("messages"), F.sum("__in").alias("input_tokens"), F.sum("__out").alias("output_tokens"), F.coalesce(F.sum(F.when(user, F.col("__in"))), F.lit(0)).alias("user_tokens"), F.coalesce(F.sum(F.when(~user, F.col("__in"))), F.lit(0)).alias("preserved_tokens"))
    return sums.withColumn("saved", F.col("input_tokens") - F.col("output_tokens")).withColumn("ratio", F.round(F.when(F.col("input_tokens") > 0, F.col("saved") / F.col("input_tokens")).otherwise(0.0), 6))


def with_policy(messages: DataFrame, role: str, aggressiveness: float, overrides: dict[str, float] | None = None) -> DataFrame:
    return messages.withColumn("aggressiveness", role_policy(F.col(role), F.lit(aggressiveness), overrides))

"""Unit scores by tenant with a base to fall back on, and whether a candidate scorer tells terms apart better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.generators import explode_words


def tenant_scores(df: DataFrame, tenant: str, doc_id: str, text: str, min_documents: int) -> DataFrame:
    """tenant, unit, score: log of a tenant's documents over those with the word.

    Only tenants with at least ``min_documents`` documents have scores of their own. Rows without
    a tenant belong to none.
    """
    rows = df.select(F.col(tenant).alias("tenant"), F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("tenant is not null")
    totals = rows.groupBy("tenant").agg(F.count_distinct("doc").alias("total")).where(F.col("total") >= min_documents)
    each = explode_words(rows, "text").select("tenant", "doc", F.col("word").alias("unit")).distinct().groupBy("tenant", "unit").agg(F.count("doc").alias("n"))
    return each.join(totals, "tenant").select("tenant", "unit", F.round(F.log(F.col("total") / F.col("n")), 6).alias("score"))


def score_units(units: DataFrame, own: DataFrame, base: DataFrame, default: float = 0.0) -> DataFrame:
    """tenant, unit, n, score, scored_by for each distinct unit of a tenant.

    ``own`` (tenant, unit, score) comes first, then ``base`` (unit, score), then the default.
    Occurrences are counted before both joins, so a frequent unit is one row of each tenant; a
    tenant of null has only the base. Score tables hold a unit once.
    """
    counted = units.groupBy("tenant", "unit").agg(F.count("*").alias("n"))
    found = counted.join(own.select("tenant", "unit", F.col("score").alias("__own")), ["tenant", "unit"], "left").join(base.select("unit", F.col("score").alias("__base")), "unit", "left")
    by = F.when(F.col("__own").isNotNull(), "tenant").when(F.col("__base").isNotNull(), "base").otherwise("default")
    return found.select("tenant", "unit", "n", F.coalesce("__own", "__base", F.lit(default)).alias("score"), by.alias("scored_by"))


def _share(side: str, terms: list[str]) -> Column:
    """The mean over all terms; one without tokens counts as 0."""
    found = F.sum(F.when((F.col("side") == side) & F.col("term").isin(terms), F.col("mean")))
    return F.coalesce(found, F.lit(0.0)) / len(terms) if terms else F.lit(0.0)


def detect_gain(scores: DataFrame, outputs: DataFrame, keep: list[str], drop: list[str], margin: float = 0.30, gain: float = 0.15) -> DataFrame:
    """One row for each case of ``outputs`` (case, changed): the margins of both scorers, the gain, what failed.

    ``scores`` (case, side, term, score) holds the tokens that overlap a term; ``side`` is ``base``
    or ``candidate``. A margin is the mean of the kept terms' means less that of the dropped
    terms'. Detected: the output changed, the candidate's margin and the gain over the base reach
    their limits. ``failed`` names the tests that did not hold, in this order, joined by commas.
    """
    terms = scores.groupBy("case", "side", "term").agg(F.avg("score").alias("mean"))
    sides = terms.groupBy("case").agg(*[F.round(_share(s, keep) - _share(s, drop), 6).alias(f"{s}_margin") for s in ("base", "candidate")])
    each = outputs.select("case", F.coalesce("changed", F.lit(False)).alias("changed")).join(sides, "case", "left").fillna(0.0, ["base_margin", "candidate_margin"])
    each = each.withColumn("gain", F.round(F.col("candidate_margin") - F.col("base_margin"), 6))
    tests = {"output_unchanged": F.col("changed"), "margin_too_small": F.col("candidate_margin") >= margin, "gain_too_small": F.col("gain") >= gain}
    failed = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in tests.items()]))
    return each.withColumn("detected", F.size(failed) == 0).withColumn("failed", F.array_join(failed, ","))

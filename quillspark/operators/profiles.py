"""Tenant profiles: explicit values, then the profile's, then defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_list(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), F.trim), lambda x: x != ""))


def resolve_profile(requests: DataFrame, tenants: DataFrame, default: float = 0.15) -> DataFrame:
    """requests(tenant_id, aggressiveness, ...) with the tenant's profile and the effective value."""
    named = requests.withColumn("tenant_id", F.coalesce(clean(F.col("tenant_id")), F.lit("default")))
    dim = tenants.select(F.trim("tenant_id").alias("tenant_id"), F.col("default_aggressiveness").alias("__d"), clean(F.col("profile_id")).alias("profile_id"))
    out = named.join(dim, "tenant_id", "left")
    return out.withColumn("effective", F.coalesce("aggressiveness", "__d", F.lit(default))).withColumn("profile_id", F.coalesce("profile_id", F.concat("tenant_id", F.lit(":base")))).withColumn("from", F.when(F.col("aggressiveness").isNotNull(), "request").when(F.col("__d").isNotNull(), "profile").otherwise("default")).drop("__d")

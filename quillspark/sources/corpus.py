"""Reading corpora, exports and measurements; writing results; synthetic corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPORT_VERSION = "benchmark-export.v2"
EXPORT = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("records", T.ArrayType(T.StructType([
        T.StructField("case_id", T.StringType()), T.StructField("condition_id", T.StringType()), T.StructField("tenant_id", T.StringType()),
        T.StructField("original_tokens", T.LongType()), T.StructField("final_tokens", T.LongType()), T.StructField("latency_ms", T.DoubleType()),
    ]))),
])


def read_corpus(spark: SparkSession, path: str, schema: str | None = None, defaults: dict | None = None) -> DataFrame:
    """Parquet, or JSON files with a given schema; missing optional fields take their defaults."""
    if path.rstrip("/").endswith(".json"):
        df = spark.read.schema(schema).json(path, multiLine=True)
    else:
        df = spark.read.parquet(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def read_export(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each record of versioned exports, with its file; another version fails the job."""
    rows = spark.read.schema(EXPORT).json(paths, multiLine=True).withColumn("source_file", F.input_file_name())
    wrong = F.raise_error(F.concat(F.lit("unsupported schema_version: "), F.coalesce("schema_version", F.lit("none"))))
    known = rows.withColumn("records", F.when(F.col("schema_version") == EXPORT_VERSION, F.col("records")).otherwise(wrong))
    return known.select("source_file", F.inline("records"))


#: A field of this noncharacter alone is read as missing. By default Spark reads quoted empty fields as missing too.
MISSING = "\ufdd0"


def read_measurements(spark: SparkSession, path: str, numbers: list[str], missing: float | None = 0.0) -> DataFrame:
    """Headered CSV with quoted multi-line text; what is no number becomes 0, and a missing field ``missing``.

    An empty field is missing if it stands without quotes, and an empty text within them.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue=MISSING)
    return rows.withColumns({c: F.when(F.col(c).isNull(), F.lit(missing)).otherwise(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))) for c in numbers})


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, CSV or Parquet. CSV keeps blanks and line feeds at the ends of texts."""
    csv = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    {"json": df.write.json, "csv": lambda p: df.write.csv(p, **csv), "parquet": df.write.parquet}[kind](path)


def text_free(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts replaced by their hash and length."""
    out = df
    for c in columns:
        out = out.withColumn(f"{c}_sha256", F.sha2(c, 256)).withColumn(f"{c}_chars", F.length(c).cast("long"))
    return out.drop(*columns)


def incident_corpus(orders: DataFrame) -> DataFrame:
    """doc_id, text: an incident report for each order, with ids, money, dates, URLs and rules."""
    six = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    run = F.concat(F.lit("https://example.com/run/"), six, F.lit("?ref=status-board"))
    text = F.concat(
        F.lit("Incident INC-"), six, F.lit(" shows queue latency above 250 ms for CUST_"), F.col("o_custkey").cast("string"),
        F.lit(". Do not delete ORD-"), six, F.lit(" before paying $"), F.round("o_totalprice").cast("long").cast("string"), F.lit(" by "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(". The customer may receive a credit only if the outage exceeds 240 minutes.\nDashboard "), run, F.lit(" and again "), run,
        F.lit(" lists it. Contact ops"), (F.col("o_custkey") % 7).cast("string"), F.lit("@example.com.\nKeep retry_limit at 3 unless legal approves a written amendment."),
    )
    return orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def label_corpus(docs: DataFrame, keep: str = "LORATENANT", drop: str = "tenantnoise") -> DataFrame:
    """Texts with keep and drop marker terms placed by the document's id."""
    n = F.pmod(F.col("doc_id"), F.lit(5))
    return docs.select("doc_id", F.concat(F.repeat(F.lit(f"{keep} "), (n + 1).cast("int")), F.col("text"), F.repeat(F.lit(f" {drop}"), (F.lit(5) - n).cast("int"))).alias("text"))


def version_records(docs: DataFrame) -> DataFrame:
    """A record for each document of its compaction in two stages: what reports are made of."""
    from quillspark.functions.measures import stage_savings, token_count

    # In steps, as a rewrite that several columns ask for is worked out once only if it is a column itself.
    ran = F.col("doc_id") % 2 == 0
    steps = docs.withColumn("__first", F.regexp_replace("text", "(^| )(?:the|de|der) ", "$1"))
    steps = steps.withColumn("__last", F.when(ran, F.regexp_replace("__first", "(^| )(?:of|que|und) ", "$1")).otherwise(F.col("__first"))).withColumn("__middle", token_count(F.col("__first")))
    rows = steps.select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("tenant_id"), F.col("source").alias("profile_id"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("condition_id"),
        ran.alias("model_ran"), (F.col("n_chars") / 10.0 + F.col("doc_id") % 17).alias("latency_ms"), F.sha2("text", 256).alias("input_sha256"), F.sha2("__last", 256).alias("output_sha256"),
        token_count(F.col("text")).alias("original_tokens"), F.col("__middle").alias("middle_tokens"), F.when(ran, token_count(F.col("__last"))).otherwise(F.col("__middle")).alias("final_tokens"),
    )
    out = rows.withColumns(stage_savings(F.col("original_tokens"), F.col("middle_tokens"), F.col("final_tokens")))
    return out.withColumn("failed", F.col("total_tokens_saved") * 10 > F.col("original_tokens"))

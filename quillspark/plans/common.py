"""Registering a query beside its SQL, and SQL pieces that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions import patterns as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RE2_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RE2_TOKEN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{RE2_SPACE}]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.replace("(RECORDS)", f"({RECORDS})").replace("(LINES)", f"({LINES})").replace("(WORDS)", f"({WORDS})")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; ``spread`` deals single-file inputs to all cores before heavy per-row work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if spread and len(df.inputFiles()) < 2 else df


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(RE2_TOKEN)}))::bigint"


def fold(x: str) -> str:
    """Letters beyond ASCII as q and other characters as blanks, so RE2's word boundaries are Unicode ones."""
    return rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'q', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))::bigint"


LAYOUT = " or ".join(has("line", p) for p in (P.ORDERED_LIST, P.UNORDERED_LIST, P.TABLE_RULE, P.YAML_LIKE, "^[ \\t>]"))


def squashed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{RE2_SPACE}]+', ' ', 'g'))"


RE2_SPANS = {k: p for k, p in P.SPANS.items() if k != "code_fence"}
#: Documents hold no code fences; RE2 has no backreference for them.
RE2_SPANS["code_fence"] = "```"

INCIDENTS = """
select o_orderkey as doc_id, concat('Incident INC-', six, ' shows queue latency above 250 ms for CUST_', o_custkey, '. Do not delete ORD-', six, ' before paying $',
  round(o_totalprice)::bigint, ' by ', strftime(o_orderdate, '%Y-%m-%d'), '. The customer may receive a credit only if the outage exceeds 240 minutes.', chr(10), 'Dashboard ', run, ' and again ', run,
  ' lists it. Contact ops', o_custkey % 7, '@example.com.', chr(10), 'Keep retry_limit at 3 unless legal approves a written amendment.') as text
from (select *, lpad(o_orderkey::varchar, 6, '0') as six, concat('https://example.com/run/', lpad(o_orderkey::varchar, 6, '0'), '?ref=status-board') as run from orders)
"""

FIRST = r"regexp_replace(text, '(^| )(?:the|de|der) ', '\1', 'g')"
SECOND = rf"regexp_replace({FIRST}, '(^| )(?:of|que|und) ', '\1', 'g')"

RECORDS = f"""
select *, greatest(0, original_tokens - middle_tokens) as deterministic_tokens_saved, greatest(0, middle_tokens - final_tokens) as model_tokens_saved,
  greatest(0, original_tokens - final_tokens) as total_tokens_saved, greatest(0, original_tokens - final_tokens) * 10 > original_tokens as failed
from (select doc_id as case_id, lang as tenant_id, source as profile_id, 'c' || (doc_id % 3) as condition_id, doc_id % 2 = 0 as model_ran, n_chars / 10.0 + doc_id % 17 as latency_ms,
  sha256(text) as input_sha256, sha256(case when doc_id % 2 = 0 then {SECOND} else {FIRST} end) as output_sha256,
  {tok('text')} as original_tokens, {tok(FIRST)} as middle_tokens, case when doc_id % 2 = 0 then {tok(SECOND)} else {tok(FIRST)} end as final_tokens from documents)
"""

LINES = f"select doc_id, lang, source, {squashed('line')} as block from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line from documents) where {squashed('line')} <> ''"
WORDS = f"select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from (select doc_id, regexp_extract_all(lower(text), {lit(P.WORD)}) as w from documents)"


def reasons(x: str, early: str = "") -> str:
    """SQL twin of ``boilerplate_reasons``, joined by commas."""
    f = fold(x)
    spans = " or ".join(has(f, p) for p in RE2_SPANS.values())
    clause = f"len(list_filter(string_split(regexp_replace({f}, '([.!?])', '\\1' || chr(10), 'g'), chr(10)), lambda c: {critical('c')})) > 0"
    return f"""array_to_string(list_filter([{early} case when {spans} or {clause} then 'contains_protected_span_or_clause' end,
      case when {has(f, P.INSTRUCTION)} or {has(f, P.IMPERATIVE)} then 'instruction_or_policy_bearing' end,
      case when contains({x}, '?') then 'contains_question' end, case when {has(f, P.TASK_FIELD)} then 'task_specific_field' end], lambda r: r is not null), ',')"""


def critical(c: str) -> str:
    return f"(({has(c, P.CLAUSE_ACTION)} and {has(c, P.CLAUSE_POLICY)}) or {has(c, P.CLAUSE_FORMAT)} or ({has(c, P.CLAUSE_ACTION)} and {has(c, P.CLAUSE_VALUE)}))"

"""Comparing versions of a corpus: pairing, multiset differences, retention, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.measures import canonical_json_sha256, text_sha256, token_count
from quillspark.operators.generators import explode_spans

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LITERALS = {"number": r"\d+(?:[.,]\d+)*", "uuid": UUID, "json_key": r'"([A-Za-z_][A-Za-z0-9_]*)"\s*:'}


def pair_versions(before: DataFrame, after: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows in both versions: same text?, tokens of each, tokens saved."""
    a, b = before.select(*keys, F.col(text).alias("before")), after.select(*keys, F.col(text).alias("after"))
    both = a.join(b, keys)
    return both.withColumn("same", text_sha256(F.col("before")) == text_sha256(F.col("after"))).withColumn("tokens_before", token_count(F.col("before"))).withColumn("tokens_after", token_count(F.col("after"))).withColumn("delta", F.col("tokens_before") - F.col("tokens_after"))


def _sided(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count_if(F.col("__side") == 0).alias("n_a"), F.count_if(F.col("__side") == 1).alias("n_b"))
    zero = F.lit(0).cast("long")
    return found.withColumn("missing", F.greatest(zero, F.col("n_a") - F.col("n_b"))).withColumn("added", F.greatest(zero, F.col("n_b") - F.col("n_a")))


def multiset_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b, missing, added: how often each row of keys occurs on either side.

    Both sides go through one aggregation; null keys are equal to each other.
    """
    return _counted(_sided(a.select(*keys), b.select(*keys)), keys)


def span_diff(before: DataFrame, after: DataFrame, doc_id: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """``multiset_diff`` of the protected literals of two versions, whose texts are read in one pass."""
    both = _sided(before.select(doc_id, text), after.select(doc_id, text))
    return _counted(explode_spans(both, text, kinds), [doc_id, "kind", "span"])


def retention_by_kind(diff: DataFrame) -> DataFrame:
    """kind, total, retained, retention (null where there is nothing to keep)."""
    sums = diff.groupBy("kind").agg(F.sum("n_a").alias("total"), F.sum(F.least("n_a", "n_b")).alias("retained"))
    return sums.withColumn("retention", F.round(F.col("retained") / F.nullif(F.col("total"), F.lit(0)), 6))


def distinct_literals(text: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LITERALS[kind]), F.lit(1 if kind == "json_key" else 0)))


def literal_retention(pairs: DataFrame, before: str, after: str, kind: str) -> DataFrame:
    """Adds distinct literals of before, those found in after, and the share."""
    a, b = distinct_literals(F.col(before), kind), distinct_literals(F.col(after), kind)
    out = pairs.withColumn("distinct_before", F.size(a).cast("long")).withColumn("kept", F.size(F.array_intersect(a, b)).cast("long"))
    return out.withColumn("share", F.round(F.when(F.col("distinct_before") > 0, F.col("kept") / F.col("distinct_before")), 6))


def set_changes(before: Column, after: Column, kind: str = "number", cap: int = 100) -> dict[str, Column]:
    """Literals lost and recovered, sorted, at most ``cap`` shown."""
    a, b = distinct_literals(before, kind), distinct_literals(after, kind)
    return {"lost": F.slice(F.array_sort(F.array_except(a, b)), 1, cap), "recovered": F.slice(F.array_sort(F.array_except(b, a)), 1, cap)}


FAILURES = (("url", ("url", "markdown_link")), ("inline_code", ("inline_code", "code_fence")), ("constraint", ("constraint", "critical_clause")), ("identifier", ("identifier", "constant")))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps; an empty term never."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, gone / F.length(term)).otherwise(0.0)


def integrity_verdict(docs: DataFrame, doc_id: str, diff: DataFrame, json: tuple[str, str] | None = None, placeholders: tuple[str, str] | None = None, required: tuple[str, str, str] | None = None) -> DataFrame:
    """For each document: changed values, failure classes in order of priority, primary, passed.

    ``diff`` is a ``span_diff``. ``placeholders`` names the text after and an array of tokens none of which
    may be left in it; ``required`` the texts before and after and an array of terms that must occur as
    often after as before; ``json`` the texts whose canonical JSON must agree where the first is
    JSON. Null arrays ask for nothing; a null text holds nothing.
    """
    changed = diff.where("missing + added > 0").groupBy(doc_id).agg(F.sum("missing").alias("missing"), F.sum("added").alias("added"), F.collect_set("kind").alias("kinds"))
    known = [k for _, g in FAILURES for k in g]
    tests = [F.when(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in g])), n) for n, g in FAILURES]
    tests.append(F.when(F.exists("kinds", lambda k: ~k.isin(*known)), "protected_span"))
    # What texts tell is asked in front of the join, which texts then need not cross.
    asked = {}
    if placeholders:
        left = F.coalesce(F.col(placeholders[0]), F.lit(""))
        asked["placeholder"] = F.exists(placeholders[1], lambda p: F.contains(left, p) & (p != ""))
    if required:
        was, now = (F.coalesce(F.col(c), F.lit("")) for c in required[:2])
        asked["required_term"] = F.exists(required[2], lambda t: occurrences(now, t) < occurrences(was, t))
    if json:
        a, b = canonical_json_sha256(F.col(json[0])), canonical_json_sha256(F.col(json[1]))
        asked["json_structure"] = a.isNotNull() & ~a.eqNullSafe(b)
    tests += [F.when(F.col(f"__{n}"), n) for n in asked]
    out = docs.withColumns({f"__{n}": test for n, test in asked.items()}).join(changed, doc_id, "left").fillna(0, ["missing", "added"])
    out = out.withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).withColumn("failures", F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return out.withColumn("passed", F.size("failures") == 0).withColumn("primary", F.get("failures", 0)).drop("kinds", *[f"__{n}" for n in asked])


def accept_or_rollback(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Rejected outputs give way to the text before, with the reason and the rejected hash."""
    return (
        rows.withColumn("final", F.when(F.col("passed"), F.col(after)).otherwise(F.col(before)))
        .withColumn("reason", F.when(~F.col("passed"), F.concat(F.lit("output_rejected_integrity_"), "primary")))
        .withColumn("rejected_sha256", F.when(~F.col("passed"), text_sha256(F.col(after))))
        .withColumn("tokens_saved", F.greatest(F.lit(0).cast("long"), token_count(F.col(before)) - token_count(F.col("final"))))
    )


def condition_matrix(cases: DataFrame, conditions: DataFrame, repeats: int = 1) -> DataFrame:
    """Every case under every condition and repeat. ``conditions`` is a grid that someone typed,
    so it is collected into one array and exploded: no join, no pairs of large tables."""
    grid = [tuple(r) for r in conditions.limit(10_001).collect()]
    if len(grid) > 10_000:
        raise ValueError("a condition grid of more than 10,000 rows is no grid of conditions")
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(conditions.columns, r, strict=True)]) for r in grid])
    return cases.select("*", F.inline(rows)).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))


def parameter_grid(values: dict[str, list]) -> list[Column]:
    """One explode-able array for each parameter."""
    return [F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]


def verify_cohort(rows: DataFrame, keys: list[str], condition: str, digest: str, conditions: list[str]) -> DataFrame:
    """Keys that lack a condition or were run on several inputs."""
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(condition)).alias("seen"), F.count_distinct(F.col(digest)).alias("inputs"))
    missing = F.array_except(F.array(*[F.lit(c) for c in sorted(conditions)]), "seen")
    return found.where((F.size(missing) > 0) | (F.col("inputs") > 1)).select(*keys, F.array_join(missing, ",").alias("missing"), "inputs")


def select_cases(cases: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cases asked for, and ids that are unknown."""
    return cases.join(wanted, key, "left_semi"), wanted.join(cases, key, "left_anti")


def overlap_join(tokens: DataFrame, spans: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Tokens with the spans of their document that they overlap (half-open intervals).

    Both sides are dealt to stretches of ``width`` characters, so that a long document's rows meet
    only near each other; a pair counts in the stretch where the later of the two begins. Both are
    exploded from texts, of which Spark knows too small a size, so neither may be broadcast.
    """

    def dealt(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width)
        return df.withColumn("__at", F.explode(F.sequence(first, last)))

    t, s = dealt(tokens).alias("t"), dealt(spans).alias("s")
    near = (F.col(f"t.{key}") == F.col(f"s.{key}")) & (F.col("t.__at") == F.col("s.__at"))
    meet = (F.col("t.start") < F.col("s.end")) & (F.col("t.end") > F.col("s.start"))
    once = F.col("t.__at") == F.floor(F.greatest("t.start", "s.start") / width)
    found = t.hint("merge").join(s, near & meet & once)
    return found.select(*[F.col(f"t.{c}") for c in tokens.columns], *[F.col(f"s.{c}") for c in spans.columns])


def constraint_check(docs: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """Failed rules of each document. ``rules`` has key, kind (required, spaceless, forbidden) and term."""
    both = docs.select(key, text).join(rules, key)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    t, term = F.col(text), F.col("term")
    ok = F.when(F.col("kind") == "forbidden", ~F.contains(t, term)).when(F.col("kind") == "spaceless", F.contains(bare(t), bare(term))).otherwise(F.contains(t, term))
    return both.withColumn("ok", ok).groupBy(key).agg(F.count("*").alias("rules"), F.sum((~F.col("ok")).cast("long")).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.concat("kind", F.lit(":"), "term")))), "|").alias("misses"))


def lookup_with_default(rows: DataFrame, dim: DataFrame, key: str, default: dict) -> DataFrame:
    """Left join to a dimension, with defaults; Spark broadcasts it below its threshold."""
    out = rows.join(dim, key, "left")
    return out.fillna(default)


def union_cohorts(cohorts: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("cohort", F.lit(k)) for k, df in cohorts.items()])


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)

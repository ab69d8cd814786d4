"""Reports over record tables: sums by tenant, funnels, rates, percentiles, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P
from quillspark.operators.generators import inline_once, posexplode_once
from quillspark.sources.folders import written


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded part / whole; null where there is nothing to divide by."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def rollup_by(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records, tokens, savings by stage, failures, reduction and failure rate."""
    sums = records.groupBy(*keys).agg(
        F.count("*").alias("records"), F.sum("original_tokens").alias("original_tokens"), F.sum("deterministic_tokens_saved").alias("deterministic_saved"),
        F.sum("model_tokens_saved").alias("model_saved"), F.sum("total_tokens_saved").alias("total_saved"), F.count_if("failed").alias("failures"),
    )
    return sums.withColumn("reduction", share(F.col("total_saved"), F.col("original_tokens"))).withColumn("failure_rate", share(F.col("failures"), F.col("records")))


def stage_totals(records: DataFrame) -> DataFrame:
    return rollup_by(records, []).withColumn("deterministic_share", share(F.col("deterministic_saved"), F.col("total_saved"))).withColumn("model_share", share(F.col("model_saved"), F.col("total_saved")))


def pathways(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("records"), F.count_if("model_ran").alias("model_called"), F.count_if(F.col("deterministic_tokens_saved") > 0).alias("changed_first"),
        F.count_if(F.col("model_tokens_saved") > 0).alias("changed_model"), F.count_if(F.col("total_tokens_saved") == 0).alias("unchanged"), share(F.count_if("model_ran"), F.count("*")).alias("call_rate"),
    )


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """g (a struct of the group), v, c: how often each value occurs, null too, written once in the shared folder.

    Reports read these counts as often as they need to, and the input once.
    """
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("__all")).alias("g")
    seen = df.select(group, F.col(value).alias("v")).groupBy("g", "v").agg(F.count("*").alias("c"))
    return written(seen, "value-counts")


def exact_percentiles(df: DataFrame, value: str, by: list[str], ps: tuple[float, ...], parts: int = 64) -> DataFrame:
    """by and ``p``, an array of exact percentiles with linear interpolation, nulls left out."""
    return percentiles_of(value_counts(df, value, by), ps, parts).select(*[F.col(f"g.{c}") for c in by], "p")


def percentiles_of(counts: DataFrame, ps: tuple[float, ...], parts: int = 64) -> DataFrame:
    """g and ``p``, an array of exact percentiles, from ``value_counts``.

    ``F.percentile`` holds every value of a group in one task. Here approximate percentiles (a bounded
    sketch) cut each group into ``parts`` ranges, counts of the ranges tell which of them hold the two
    ranks that a percentile lies between, and only the values of those are ordered.
    """
    seen = counts.where("v is not null")
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    # Sketches depend on the order in which they are merged; both readers of the ranges must see the same edges.
    edges = written(seen.groupBy("g").agg(F.percentile_approx("v", steps, 1000).alias("e")), "percentile-edges")
    # Sizes are guessed from the counts before they go to several groups, so plain joins may broadcast all values.
    placed = seen.hint("merge").join(edges, "g").withColumn("b", F.size(F.filter("e", lambda e: e < F.col("v")))).drop("e")
    sizes = placed.groupBy("g", "b").agg(F.sum("c").alias("size"))
    whole, end = Window.partitionBy("g"), F.col("before") + F.col("size")
    front = F.coalesce(F.sum("size").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("g", "b", "size", front.alias("before"), F.sum("size").over(whole).alias("n"))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in ps]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("i"), f(x).cast("long").alias("rank")) for i, x in enumerate(place) for k, f in enumerate((F.floor, F.ceil))])
    inside = F.filter(ranks, lambda r: (r["rank"] < end) & (r["rank"] >= F.col("before")))
    asked = sizes.select("g", "b", "before", "n", inside.alias("ranks")).where(F.size("ranks") > 0)
    run = F.sum("c").over(Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = placed.hint("merge").join(asked, ["g", "b"]).withColumn("to", F.col("before") + run)
    hit = F.filter("ranks", lambda r: (r["rank"] < F.col("to")) & (r["rank"] >= F.col("to") - F.col("c")))
    found = ordered.select("g", "v", "n", F.explode(hit).alias("r"))
    at = found.groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r.i", F.col("v").cast("double").alias("v")))).alias("m"))
    low, high = (lambda i: F.element_at("m", F.lit(2 * i))), (lambda i: F.element_at("m", F.lit(2 * i + 1)))
    mixed = F.array(*[low(i) + (high(i) - low(i)) * (x - F.floor(x)) for i, x in enumerate(place)])
    return at.select("g", mixed.alias("p"))


def _with_percentiles(sums: DataFrame, counts: DataFrame, by: list[str], ps: tuple[float, ...]) -> DataFrame:
    """Sums by g beside ``p``; null keys are groups of their own."""
    found = percentiles_of(counts, ps)
    return sums.join(found, "g", "left").select(*[F.col(f"g.{c}").alias(c) for c in by], *[c for c in sums.columns if c != "g"], "p")


def _mean() -> Column:
    return F.sum(F.col("v") * F.col("c")) / F.sum(F.when(F.col("v").isNotNull(), F.col("c")))


def distribution(df: DataFrame, value: str, by: list[str], digits: int = 6) -> DataFrame:
    """Exact percentiles with linear interpolation, and min, max, mean, all from one count of values."""
    counts = value_counts(df, value, by)
    number = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
    sums = counts.groupBy("g").agg(number.alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(_mean(), digits).alias("mean"))
    out = _with_percentiles(sums, counts, by, (0.1, 0.5, 0.9, 0.95))
    return out.select(*by, "n", "least", "most", "mean", *[F.round(F.element_at("p", i + 1), digits).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p95"))])


def grouped_summary(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Overall, by each dimension, and by all of them: each row counts in every one of these groups.

    Values are counted by all dimensions first; the counts, not the rows, go to the other groups.
    """
    sets = [[], *[[d] for d in dims], list(dims)]
    named = ["overall", *dims, "all"]
    kinds = df.schema
    rows = F.array(*[F.struct(F.lit(n).alias("group_type"), *[(F.col(f"g.{d}") if d in s else F.lit(None).cast(kinds[d].dataType)).alias(d) for d in dims], F.lit(0).alias("__all")) for n, s in zip(named, sets, strict=True)])
    counts = value_counts(df, value, dims).select(F.explode(rows).alias("g"), "v", "c").groupBy("g", "v").agg(F.sum("c").alias("c"))
    by = ["group_type", *dims]
    sums = counts.groupBy("g").agg(F.sum("c").alias("n"), F.round(_mean(), 6).alias("mean"))
    return _with_percentiles(sums, counts, by, (0.5,)).select(*by, "n", F.round(F.element_at("p", 1), 6).alias("p50"), "mean")


def transform_funnel(records: DataFrame) -> DataFrame:
    """For each transform of an array<struct<transform, status, candidates, applied, tokens_saved>>."""
    each = posexplode_once(records.select("transforms"), F.col("transforms"), "pos", "t").select("t.*")
    return each.groupBy("transform").agg(F.count("*").alias("rows"), F.sum("candidates").alias("candidates"), F.sum("applied").alias("applied"), F.sum("tokens_saved").alias("tokens_saved"), F.count_if(F.col("status") == "applied").alias("n_applied"), F.count_if(F.col("status") == "gated").alias("n_gated"), F.count_if(F.col("status") == "none").alias("n_none"))


def opportunity_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, total of each numeric column: summed first, then unpivoted."""
    sums = df.agg(*[F.sum(c).cast("long").alias(c) for c in columns])
    return sums.unpivot([], columns, "name", "total")


def nested_totals(df: DataFrame, column: str) -> DataFrame:
    """name, total of every number inside a column of structs and maps, by its path: ``a.b``, or ``a.key`` for a map.

    Structs are walked by the schema, maps by their keys. Pairs of path and number are summed before
    they are shuffled, in one scan; nulls, and what is no number, count nothing.
    """
    pairs: list[Column] = []

    def walk(value: Column, path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(value.getField(f.name), f"{path}.{f.name}" if path else f.name, f.dataType)
        elif isinstance(kind, T.MapType) and isinstance(kind.valueType, T.NumericType):
            keyed = F.transform(F.map_entries(value), lambda e: F.struct(F.concat(F.lit(f"{path}." if path else ""), e["key"].cast("string")).alias("name"), e["value"].cast("double").alias("v")))
            pairs.append(F.coalesce(keyed, F.array().cast("array<struct<name:string,v:double>>")))
        elif isinstance(kind, T.NumericType):
            pairs.append(F.array(F.struct(F.lit(path).alias("name"), value.cast("double").alias("v"))))

    walk(F.col(column), "", df.schema[column].dataType)
    each = inline_once(df.select(column), F.concat(*pairs)).select("__row.*")
    return each.groupBy("name").agg(F.sum("v").alias("total")).where("total is not null")


def transform_details(records: DataFrame) -> DataFrame:
    """The funnel of each transform with time, what gates held back, and what they would have saved.

    ``transforms`` is an array<struct<transform, status, candidates, applied, tokens_saved, elapsed_ms,
    gate_reasons: map<string, bigint>, would_apply, would_save>>. ``statuses`` and ``gate_reasons`` are
    maps of summed counts; they are summed by key before a transform's few keys come together.
    """
    each = posexplode_once(records.select("transforms"), F.col("transforms"), "pos", "t").select("t.*").withColumn("transform", F.coalesce("transform", F.lit("unknown")))
    status = F.array(F.struct(F.lit("statuses").alias("part"), F.coalesce("status", F.lit("unknown")).alias("key"), F.lit(1).cast("long").alias("n")))
    gates = F.transform(F.map_entries("gate_reasons"), lambda e: F.struct(F.lit("gate_reasons").alias("part"), e["key"].alias("key"), e["value"].cast("long").alias("n")))
    keyed = inline_once(each, F.concat(status, F.coalesce(gates, F.array().cast("array<struct<part:string,key:string,n:bigint>>")))).select("*", "__row.*")
    # A row has one status, so what it adds to the sums goes with that; the records are read once.
    own, summed = F.col("part") == "statuses", ("candidates", "applied", "tokens_saved", "elapsed_ms", "would_save")
    keyed = keyed.groupBy("transform", "part", "key").agg(F.sum("n").alias("n"), F.count_if(own & F.col("would_apply")).alias("would_apply"), *[F.sum(F.when(own, F.col(c))).alias(c) for c in summed])
    zero = {c: F.coalesce(F.sum(c), F.lit(0)) for c in summed}
    sums = [
        F.sum(F.when(own, F.col("n"))).alias("rows"), *[zero[c].alias(c) for c in ("candidates", "applied", "tokens_saved")], F.round(zero["elapsed_ms"], 3).alias("elapsed_ms"),
        F.sum("would_apply").alias("would_apply"), zero["would_save"].alias("would_save"),
    ]
    maps = [F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("part") == p, F.struct("key", "n"))), lambda x: x.isNotNull()))).alias(p) for p in ("statuses", "gate_reasons")]
    return keyed.groupBy("transform").agg(*sums, *maps)


def failure_rates(df: DataFrame, checks: list[str]) -> DataFrame:
    """check, applicable, failed, rate: each check is a boolean column, null where it does not apply."""
    counts = df.agg(*[x for c in checks for x in (F.count(c).alias(f"{c}__n"), F.count_if(~F.col(c)).alias(f"{c}__f"))])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"{c}__n").alias("applicable"), F.col(f"{c}__f").alias("failed")) for c in checks])))
    return rows.withColumn("rate", share(F.col("failed"), F.col("applicable")))


def condition_summary(records: DataFrame, condition: str) -> DataFrame:
    group = F.struct(F.col(condition), F.lit(0).alias("__all")).alias("g")
    sums = records.groupBy(group).agg(F.count("*").alias("records"), F.sum("total_tokens_saved").alias("tokens_saved"), F.count_if("failed").alias("failures"))
    out = _with_percentiles(sums, value_counts(records, "latency_ms", [condition]), [condition], (0.5,))
    return out.select(condition, "records", "tokens_saved", "failures", F.round(F.element_at("p", 1), 6).alias("median_latency"))


def cohort_fingerprint(df: DataFrame, key: str, digest: str, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """16 hex digits over the ``id:hash`` lines of a cohort, as a tree of hashes.

    Lines are dealt by the first ``levels[0]`` hex digits of their key's md5 and hashed in the order of the
    key; these hashes are joined in the order of their digits and hashed at each further level,
    and at last over all. No task holds more than a small part of a large cohort; the value is not that
    of one hash over all lines in a row, which one task would have to see.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest))
    rows = df.select(F.md5(F.col(key).cast("string").cast("binary")).alias("b"), F.col(key).alias("k"), line.alias("h"), F.lit(1).alias("n"))

    def hashed(order: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "\n"), 256).alias("h")

    for i, digits in enumerate(levels):
        part = F.substring("b", 1, digits).alias("part")
        rows = rows.groupBy(part).agg(hashed("b" if i else "k"), F.sum("n").alias("n")).withColumnRenamed("part", "b")
    return rows.agg(F.sum("n").alias("rows"), hashed("b")).select("rows", F.substring("h", 1, 16).alias("fingerprint"))


def repeatability(records: DataFrame, keys: list[str], output: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("repeats"), F.count_distinct(F.col(output)).alias("outputs")).withColumn("stable", F.col("outputs") == 1)


def kind_counts(segments: DataFrame, key: str, kind: str) -> DataFrame:
    """Histogram of kinds for each key, as ``kind=n`` pairs in a map."""
    each = segments.groupBy(key, kind).agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))


def eval_checks(results: DataFrame, case: str) -> DataFrame:
    """case, check, severity, passed: the checks of each result against what its case expects.

    results: ``output``, ``original_tokens``, ``compressed_tokens``, ``elapsed_ms``, ``sections`` (kinds seen),
    and the case's ``required``, ``spaceless`` (required, white space aside), ``forbidden`` and ``section_kinds``
    arrays, ``min_reduction`` and ``max_elapsed_ms``; null arrays and bounds ask for nothing.
    """
    out, bare = F.col("output"), lambda c: F.regexp_replace(c, rf"[{P.SPACE_CLASS}]+", "")

    def check(name: Column, severity: str, passed: Column) -> Column:
        return F.struct(name.alias("check"), F.lit(severity).alias("severity"), passed.alias("passed"))

    def each(items: str, name: str, passed) -> Column:
        numbered = F.transform(F.col(items), lambda x, i: check(F.concat(F.lit(f"{name}_"), i.cast("string")), "error", passed(x)))
        return F.coalesce(numbered, F.array().cast("array<struct<check:string,severity:string,passed:boolean>>"))

    def bound(column: str, passed: Column) -> Column:
        return F.filter(F.array(check(F.lit(column), "warning", passed)), lambda _: F.col(column).isNotNull())

    reduction = F.when(F.col("original_tokens") > 0, (F.col("original_tokens") - F.col("compressed_tokens")) / F.col("original_tokens")).otherwise(0.0)
    kinds = F.transform(F.col("section_kinds"), lambda k: check(F.concat(F.lit("section_"), k), "error", F.array_contains(F.col("sections"), k)))
    always = F.array(check(F.lit("non_empty_output"), "error", bare(out) != ""), check(F.lit("not_larger_than_input"), "error", F.col("compressed_tokens") <= F.col("original_tokens")))
    rows = F.concat(
        always, each("required", "required", lambda x: F.contains(out, x)), each("spaceless", "required_whitespace_insensitive", lambda x: F.contains(F.col("__bare"), bare(x))),
        each("forbidden", "forbidden", lambda x: ~F.contains(out, x)), F.coalesce(kinds, F.array().cast("array<struct<check:string,severity:string,passed:boolean>>")),
        bound("min_reduction", reduction >= F.col("min_reduction")), bound("max_elapsed_ms", F.col("elapsed_ms") <= F.col("max_elapsed_ms")),
    )
    return results.withColumn("__bare", bare(out)).select(case, F.inline(rows))


def eval_run(checks: DataFrame, case: str) -> DataFrame:
    """checks: case, check, severity, passed. Errors decide; warnings are counted."""
    error = F.col("severity") == "error"
    return checks.groupBy(case).agg(F.count("*").alias("checks"), F.count_if(error & ~F.col("passed")).alias("errors"), F.count_if(~error & ~F.col("passed")).alias("warnings"), F.bool_and(F.col("passed") | ~error).alias("passed"))


def separation(scores: DataFrame) -> DataFrame:
    """label in (0, 1) and score by document: mean of the documents' means, and the difference."""
    per = scores.groupBy("doc_id", "label").agg(F.avg("score").alias("s"))
    return per.agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("s"))), 6).alias("keep_mean"), F.round(F.avg(F.when(F.col("label") == 0, F.col("s"))), 6).alias("drop_mean")).withColumn("separation", F.round(F.col("keep_mean") - F.col("drop_mean"), 5))


def efficiency(records: DataFrame) -> DataFrame:
    ms, saved, tokens = F.sum("latency_ms"), F.sum("total_tokens_saved"), F.sum("original_tokens")
    return records.agg(F.round(ms / F.nullif(saved / 1000, F.lit(0.0)), 4).alias("ms_per_1k_saved"), F.round(tokens / F.nullif(ms / 1000, F.lit(0.0)), 4).alias("tokens_per_s"))


def provenance_sets(records: DataFrame, fields: list[str]) -> DataFrame:
    rows = records.agg(*[F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("unknown")))).alias(c) for c in fields])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.array_join(c, ",").alias("values")) for c in fields])))


def repeat_sequence(records: DataFrame, keys: list[str], order: list[str], output: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("same_as_previous", F.lag(output).over(w) == F.col(output))


def assign_stable(df: DataFrame, key: str, k: int) -> DataFrame:
    """A stable slot in 0 .. k-1 by the key's hash: spreads evenly without a global order."""
    return df.withColumn("slot", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(k)).cast("long"))


def assign_round_robin(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Alternates within each group by order."""
    return df.withColumn("slot", F.pmod(F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1, F.lit(k)).cast("long"))


def running_offsets(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))

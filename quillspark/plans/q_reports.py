"""Queries of the report aggregates over record tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.operators import reports as R
from quillspark.operators import rewrite as W
from quillspark.operators import scoring as SC
from quillspark.plans.common import WORDS, count, lit, query, table, tok
from quillspark.plans.q_measures import LABELLED
from quillspark.sources import corpus


def docs(spark, sf):
    return table(spark, sf, "documents", spread=True)


def records(spark, sf):
    return corpus.version_records(docs(spark, sf))


SUMS = """count(*) as records, sum(original_tokens)::bigint as original_tokens, sum(deterministic_tokens_saved)::bigint as deterministic_saved, sum(model_tokens_saved)::bigint as model_saved, sum(total_tokens_saved)::bigint as total_saved, count(*) filter (where failed) as failures,
 round(sum(total_tokens_saved) / nullif(sum(original_tokens), 0), 6)::double as reduction, round(count(*) filter (where failed) / nullif(count(*), 0), 6)::double as failure_rate"""


@query("f3_tenant_rollup", f"select tenant_id, profile_id, {SUMS} from (RECORDS) group by tenant_id, profile_id")
def f3(spark, sf):
    return R.rollup_by(records(spark, sf), ["tenant_id", "profile_id"])


@query("f4_stage_totals", f"select {SUMS}, round(sum(deterministic_tokens_saved) / nullif(sum(total_tokens_saved), 0), 6)::double as deterministic_share, round(sum(model_tokens_saved) / nullif(sum(total_tokens_saved), 0), 6)::double as model_share from (RECORDS)")
def f4(spark, sf):
    return R.stage_totals(records(spark, sf))


@query("f5_pathways", "select count(*) as records, count(*) filter (where model_ran) as model_called, count(*) filter (where deterministic_tokens_saved > 0) as changed_first, count(*) filter (where model_tokens_saved > 0) as changed_model, count(*) filter (where total_tokens_saved = 0) as unchanged, round(count(*) filter (where model_ran) / count(*), 6)::double as call_rate from (RECORDS)")
def f5(spark, sf):
    return R.pathways(records(spark, sf))


def _dist(v):
    return f"count({v}) as n, min({v}) as least, max({v}) as most, round(avg({v}), 6)::double as mean, " + ", ".join(f"round(quantile_cont({v}, {p}), 6)::double as {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95)))


@query("f6_distribution", f"select event_type, {_dist('value')} from events group by event_type")
def f6(spark, sf):
    return R.distribution(table(spark, sf, "events"), "value", ["event_type"])


@query("f6_lineitem_distribution", f"select l_returnflag, l_linestatus, {_dist('l_extendedprice')} from lineitem group by l_returnflag, l_linestatus")
def f6l(spark, sf):
    return R.distribution(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query("f7_grouped_summary", """select case grouping_id(o_orderpriority, o_orderstatus, band) when 7 then 'overall' when 3 then 'o_orderpriority' when 5 then 'o_orderstatus' when 6 then 'band' else 'all' end as group_type, o_orderpriority, o_orderstatus, band, count(*) as n, round(quantile_cont(o_totalprice, 0.5), 6)::double as p50, round(avg(o_totalprice), 6)::double as mean
 from (select *, o_custkey % 4 as band from orders) group by grouping sets ((), (o_orderpriority), (o_orderstatus), (band), (o_orderpriority, o_orderstatus, band))""")
def f7(spark, sf):
    rows = table(spark, sf, "orders").withColumn("band", F.col("o_custkey") % 4)
    return R.grouped_summary(rows, ["o_orderpriority", "o_orderstatus", "band"], "o_totalprice")


TRANSFORMS = "(select 'articles' as transform, deterministic_tokens_saved as s from (RECORDS) union all select 'conjunctions', case when model_ran then model_tokens_saved else -1 end from (RECORDS))"


@query("f8_transform_funnel", f"select transform, count(*) as rows, sum(case when s >= 0 then s else 0 end)::bigint as candidates, sum(greatest(s, 0))::bigint as applied, sum(greatest(s, 0))::bigint as tokens_saved, count(*) filter (where s > 0) as n_applied, count(*) filter (where s < 0) as n_gated, count(*) filter (where s = 0) as n_none from {TRANSFORMS} group by transform")
def f8(spark, sf):
    def row(name, saved, gated):
        n = F.when(gated, F.lit(0).cast("long")).otherwise(saved)
        status = F.when(gated, "gated").when(saved > 0, "applied").otherwise("none")
        return F.struct(F.lit(name).alias("transform"), status.alias("status"), n.alias("candidates"), n.alias("applied"), n.alias("tokens_saved"))

    r = records(spark, sf)
    both = F.array(row("articles", F.col("deterministic_tokens_saved"), F.lit(False)), row("conjunctions", F.col("model_tokens_saved"), ~F.col("model_ran")))
    return R.transform_funnel(r.withColumn("transforms", both))


@query("f9_opportunity_totals", f"select unnest(['chars', 'blank_lines', 'headings', 'json.numbers']) as name, unnest([sum(length(text))::bigint, sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '[ \\t\\r]*'))))::bigint, sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}[ \\t]'))))::bigint, sum({count('text', '[0-9]+')})::bigint]) as total from documents")
def f9(spark, sf):
    from quillspark.functions import measures as M

    f = M.structural_features(F.col("text"))
    rows = docs(spark, sf).select(f["chars"].alias("chars"), f["blank_lines"].alias("blank_lines"), f["headings"].alias("headings"), M.count_of(F.col("text"), "[0-9]+").alias("numbers"))
    totals = R.opportunity_totals(rows, ["chars", "blank_lines", "headings", "numbers"])
    return totals.withColumn("name", F.when(F.col("name") == "numbers", "json.numbers").otherwise(F.col("name")))


@query("f8_transform_details", f"""select transform, count(*) as rows, sum(greatest(s, 0))::bigint as tokens_saved, round(sum(latency_ms), 3)::double as elapsed_ms, count(*) filter (where s < 0) as would_apply, coalesce(sum(7) filter (where s < 0), 0)::bigint as would_save,
  array_to_string(list_filter([case when count(*) filter (where s > 0) > 0 then 'applied=' || count(*) filter (where s > 0) end, case when count(*) filter (where s < 0) > 0 then 'gated=' || count(*) filter (where s < 0) end, case when count(*) filter (where s = 0) > 0 then 'none=' || count(*) filter (where s = 0) end], lambda x: x is not null), ',') as statuses,
  case when count(*) filter (where s < 0) > 0 then 'latency=' || count(*) filter (where s < 0) || ',low_saving=' || 2 * count(*) filter (where s < 0) else '' end as gate_reasons
  from (select case_id, latency_ms, unnest(['articles', 'conjunctions']) as transform, unnest([deterministic_tokens_saved, case when model_ran then model_tokens_saved else -1 end]) as s from (RECORDS)) group by transform""")
def f8d(spark, sf):
    def row(name, saved, gated):
        status = F.when(gated, "gated").when(saved > 0, "applied").otherwise("none")
        reasons = F.when(gated, F.create_map(F.lit("low_saving"), F.lit(2).cast("long"), F.lit("latency"), F.lit(1).cast("long")))
        n = F.when(gated, F.lit(0).cast("long")).otherwise(saved)
        return F.struct(F.lit(name).alias("transform"), status.alias("status"), n.alias("candidates"), n.alias("applied"), n.alias("tokens_saved"), F.col("latency_ms").alias("elapsed_ms"), reasons.alias("gate_reasons"), gated.alias("would_apply"), F.when(gated, F.lit(7).cast("long")).alias("would_save"))

    both = F.array(row("articles", F.col("deterministic_tokens_saved"), F.lit(False)), row("conjunctions", F.col("model_tokens_saved"), ~F.col("model_ran")))
    out = R.transform_details(records(spark, sf).withColumn("transforms", both))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("transform", "rows", "tokens_saved", "elapsed_ms", "would_apply", "would_save", shown("statuses").alias("statuses"), shown("gate_reasons").alias("gate_reasons"))


@query("f9_nested_totals", f"""select 'chars' as name, sum(length(text))::double as total from documents union all select 'json.numbers', sum({count('text', '[0-9]+')})::double from documents
  union all select 'by_lang.' || lang, sum(n_chars)::double from documents where lang is not null group by lang""")
def f9n(spark, sf):
    from quillspark.functions import measures as M

    found = F.struct(F.length("text").alias("chars"), F.struct(M.count_of(F.col("text"), "[0-9]+").alias("numbers"), F.col("lang").alias("label")).alias("json"), F.when(F.col("lang").isNotNull(), F.create_map(F.coalesce("lang", F.lit("")), "n_chars")).alias("by_lang"))
    return R.nested_totals(docs(spark, sf).select(found.alias("found")), "found")


@query("f10_failure_rates", """select 'integrity' as "check", count(*) as applicable, count(*) filter (where failed) as failed, round(count(*) filter (where failed) / nullif(count(*), 0), 6)::double as rate from (RECORDS)
 union all select 'model', count(*) filter (where model_ran), count(*) filter (where model_ran and model_tokens_saved = 0), round(count(*) filter (where model_ran and model_tokens_saved = 0) / nullif(count(*) filter (where model_ran), 0), 6)::double from (RECORDS)
 union all select 'json', 0, 0, null""")
def f10(spark, sf):
    r = records(spark, sf).select((~F.col("failed")).alias("integrity"), F.when(F.col("model_ran"), F.col("model_tokens_saved") > 0).alias("model"), F.lit(None).cast("boolean").alias("json"))
    return R.failure_rates(r, ["integrity", "model", "json"])


@query("f11_condition_summary", "select condition_id, count(*) as records, sum(total_tokens_saved)::bigint as tokens_saved, count(*) filter (where failed) as failures, round(median(latency_ms), 6)::double as median_latency from (RECORDS) group by condition_id")
def f11(spark, sf):
    return R.condition_summary(records(spark, sf), "condition_id")


@query("f16_cohort_fingerprint", """with a as (select substr(md5(doc_id::varchar), 1, 6) as b, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) order by doc_id)) as h, count(*) as n from documents group by 1),
 c as (select substr(b, 1, 3) as b, sha256(string_agg(h, chr(10) order by b)) as h, sum(n) as n from a group by 1)
 select sum(n)::bigint as rows, substr(sha256(string_agg(h, chr(10) order by b)), 1, 16) as fingerprint from c""")
def f16(spark, sf):
    return R.cohort_fingerprint(docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("f17_repeatability", "select input_sha256, model_ran, count(*) as repeats, count(distinct output_sha256) as outputs, count(distinct output_sha256) = 1 as stable from (RECORDS) group by input_sha256, model_ran")
def f17(spark, sf):
    return R.repeatability(records(spark, sf), ["input_sha256", "model_ran"], "output_sha256")


@query("f19_eval_run", f"""select doc_id, (2 + 2 + 1 + 1 + 1 + (doc_id % 3 > 0)::int + (doc_id % 2 = 0)::int)::bigint as checks,
  ((case when trim(t) = '' then 1 else 0 end) + (case when a > b then 1 else 0 end) + (case when contains(t, ' de ') then 0 else 1 end) + (case when contains(t, '. ') then 0 else 1 end)
   + (case when contains(regexp_replace(t, '\\s+', '', 'g'), 'ofthe') then 0 else 1 end) + (case when contains(t, ' the ') then 1 else 0 end) + (case when contains(t, chr(10)) then 0 else 1 end))::bigint as errors,
  ((case when doc_id % 3 > 0 and b > 0 and (b - a) / b < 0.02 then 1 else 0 end) + (case when doc_id % 2 = 0 and n_chars > 5000 then 1 else 0 end))::bigint as warnings, errors = 0 as passed
 from (select doc_id, n_chars, regexp_replace(text, '(^| )(?:the) ', '\\1', 'g') as t, {tok("regexp_replace(text, '(^| )(?:the) ', '" + chr(92) + "1', 'g')")} as a, {tok('text')} as b from documents)""")
def f19(spark, sf):
    """Texts without articles against cases with every kind of check."""
    from quillspark.functions import measures as M

    words = lambda *x: F.array(*[F.lit(w) for w in x])
    d = docs(spark, sf).withColumn("output", F.regexp_replace("text", "(^| )(?:the) ", "$1"))
    d = d.withColumn("compressed_tokens", M.token_count(F.col("output"))).withColumn("original_tokens", M.token_count(F.col("text"))).withColumn("elapsed_ms", F.col("n_chars"))
    d = d.withColumns({"required": words(" de ", ". "), "spaceless": words("of the"), "forbidden": words(" the "), "section_kinds": words("lines"), "sections": F.when(F.contains("output", F.lit("\n")), words("lines", "prose")).otherwise(words("prose"))})
    d = d.withColumn("min_reduction", F.when(F.col("doc_id") % 3 > 0, 0.02)).withColumn("max_elapsed_ms", F.when(F.col("doc_id") % 2 == 0, 5000))
    return R.eval_run(R.eval_checks(d, "doc_id"), "doc_id")


@query("f20_separation", f"""with w as ({WORDS}), s as (select word, round(ln((select count(distinct doc_id) from documents) / count(distinct doc_id)), 6) as score from w group by word),
 p as (select w.doc_id, l.quality as label, avg(s.score) as s from w join s using (word) join labels l using (doc_id) group by w.doc_id, l.quality),
 m as (select round(avg(s) filter (where label = 1), 6)::double as keep_mean, round(avg(s) filter (where label = 0), 6)::double as drop_mean from p) select *, round(keep_mean - drop_mean, 5)::double as separation from m""")
def f20(spark, sf):
    words = W.explode_words(docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "word")
    scores = words.join(W.idf_scores(docs(spark, sf), "doc_id", "text"), "word")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.separation(scores.join(labels, "doc_id"))


#: A word's share of its repeats against its place in the text: two scorers that need no model.
SCORED = f"""select doc_id, word, 1.0 / count(*) over (partition by doc_id, word) as base, 1 - (pos - 1)::double / count(*) over (partition by doc_id) as candidate
 from (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as pos from (select doc_id, regexp_extract_all(lower(text), {lit(P.WORD)}) as l from ({LABELLED})))"""


def _margin(side: str) -> str:
    return f"round((coalesce(avg({side}) filter (where word = 'loratenant'), 0) + coalesce(avg({side}) filter (where word = 'adapteractive'), 0)) / 2 - coalesce(avg({side}) filter (where word = 'tenantnoise'), 0), 6)"


@query("f20_gain_detection", f"""select doc_id as "case", changed, base_margin, candidate_margin, gain, changed and candidate_margin >= 0.3 and gain >= 0.15 as detected,
  concat_ws(',', case when not changed then 'output_unchanged' end, case when candidate_margin < 0.3 then 'margin_too_small' end, case when gain < 0.15 then 'gain_too_small' end) as failed
 from (select *, round(candidate_margin - base_margin, 6) as gain from (select doc_id, bool_or((base >= 0.5) <> (candidate >= 0.5)) as changed, {_margin('base')} as base_margin, {_margin('candidate')} as candidate_margin from ({SCORED}) group by doc_id))""")
def f20g(spark, sf):
    each, doc = W.explode_words(corpus.label_corpus(docs(spark, sf)).select("doc_id", "text"), "text").drop("text"), Window.partitionBy("case")
    words = each.select(F.col("doc_id").alias("case"), "pos", "word")
    words = words.withColumn("base", 1.0 / F.count("*").over(Window.partitionBy("case", "word"))).withColumn("candidate", 1 - F.col("pos") / F.count("*").over(doc))
    outputs = words.groupBy("case").agg(F.bool_or((F.col("base") >= 0.5) != (F.col("candidate") >= 0.5)).alias("changed"))
    keep, drop = ["loratenant", "adapteractive"], ["tenantnoise"]
    scores = words.where(F.col("word").isin(keep + drop)).select("case", F.col("word").alias("term"), F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("score")) for s in ("base", "candidate")])))
    return SC.detect_gain(scores, outputs, keep, drop)


@query("f22_efficiency", "select round(sum(latency_ms) / nullif(sum(total_tokens_saved) / 1000, 0), 4)::double as ms_per_1k_saved, round(sum(original_tokens) / nullif(sum(latency_ms) / 1000, 0), 4)::double as tokens_per_s from (RECORDS)")
def f22(spark, sf):
    return R.efficiency(records(spark, sf))


@query("f23_provenance_sets", "select 'tenant_id' as field, array_to_string(list_sort(list(distinct tenant_id)), ',') as \"values\" from (RECORDS) union all select 'condition_id', array_to_string(list_sort(list(distinct condition_id)), ',') from (RECORDS) union all select 'device', 'unknown'")
def f23(spark, sf):
    return R.provenance_sets(records(spark, sf).withColumn("device", F.lit(None).cast("string")), ["tenant_id", "condition_id", "device"])


@query("h3_repeat_sequence", "select event_id, row_number() over w as nth, lag(event_type) over w = event_type as same_as_previous from events window w as (partition by user_id order by ts, event_id)")
def h3(spark, sf):
    return R.repeat_sequence(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "nth", "same_as_previous")


@query("h4_assign_round_robin", "select doc_id, (row_number() over (partition by source order by doc_id) - 1) % 3 as slot from documents")
def h4(spark, sf):
    return R.assign_round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 3).select("doc_id", "slot")


@query("h5_number_by_first_seen", f"""select doc_id, word, nth, case when nth <= 26 then chr((64 + nth)::int) when nth <= 702 then chr((64 + (nth - 1) // 26)::int) || chr((65 + (nth - 1) % 26)::int) else chr((64 + ((nth - 1) // 26 - 1) // 26)::int) || chr((65 + ((nth - 1) // 26 - 1) % 26)::int) || chr((65 + (nth - 1) % 26)::int) end as alias
 from (select doc_id, word, row_number() over (partition by doc_id order by min(pos)) as nth from ({WORDS}) group by doc_id, word)""")
def h5(spark, sf):
    from pyspark.sql import Window

    words = W.explode_words(docs(spark, sf).select("doc_id", "text"), "text").groupBy("doc_id", "word").agg(F.min("pos").alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long")
    return words.select("doc_id", "word", nth.alias("nth")).withColumn("alias", W.alias_label(F.col("nth")))


@query("h6_top_units", "select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r, count(*) over (partition by l_orderkey) as n from lineitem) where r <= greatest(1, ceil(n * 0.4))")
def h6(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf, "lineitem").withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber")))
    return rows.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.4))).select("l_orderkey", "l_linenumber")


@query("h7_running_offsets", "select conv_id, turn, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from conversations")
def h7(spark, sf):
    return R.running_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("offset").cast("long").alias("offset"))



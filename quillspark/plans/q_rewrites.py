"""Queries of the corpus rewrites and their gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import patterns as P
from quillspark.operators import rewrite as R
from quillspark.operators import scoring as SC
from quillspark.plans.common import FIRST, INCIDENTS, LAYOUT, WORDS, critical, fold, lit, query, table, tok
from quillspark.sources import corpus


def docs(spark, sf):
    return table(spark, sf, "documents", spread=True)


def incidents(spark, sf):
    return corpus.incident_corpus(table(spark, sf, "orders", spread=True))


#: Documents with trailing blanks, blank runs and wide gaps put in by rule.
LOOSE = "replace(replace(text, '. ', '.  '), chr(10), '   ' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || chr(10))"


def loose(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(LOOSE.replace("chr(10)", "char(10)")).alias("text"))


BLANKS = r"regexp_replace(regexp_replace(replace(text, '   ' || chr(10), '  ' || chr(10)), '\n \n', chr(10) || chr(10), 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')"


@query("e1_normalize_whitespace", f"select doc_id, sha256({BLANKS}) as out_sha256 from (select doc_id, {LOOSE} as text from documents)")
def e1(spark, sf):
    return loose(spark, sf).select("doc_id", F.sha2(R.normalize_whitespace(F.col("text")), 256).alias("out_sha256"))


def _compact(x):
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("e2_compact_text", f"select doc_id, {tok('text')} as before, {tok(_compact('text'))} as after, sha256({_compact('text')}) as out_sha256 from (select doc_id, {LOOSE} as text from documents)")
def e2(spark, sf):
    out = R.compact_text(F.col("text"))
    return loose(spark, sf).select("doc_id", M.token_count(F.col("text")).alias("before"), M.token_count(out).alias("after"), F.sha2(out, 256).alias("out_sha256"))


#: A line with its inner runs of blanks closed, unless they are layout or the line is a critical clause.
STRICT = f"case when trim(x) <> '' and not contains(x, '|') and not ({LAYOUT.replace('line', 'x')}) and not {critical(fold('x'))} then regexp_replace(regexp_replace(x, '  $', ''), '[ \t]{{2,}}', ' ', 'g') || case when x like '%  ' then '  ' else '' end else x end"


@query("e3_collapse_prose", f"""select doc_id, {tok('text')} as before, {tok('t')} as after, length(t)::bigint as chars, sha256(t) as out_sha256
  from (select doc_id, text, array_to_string(list_transform(string_split({BLANKS}, chr(10)), lambda x: {STRICT}), chr(10)) as t from (select doc_id, {LOOSE} as text from documents))""")
def e3(spark, sf):
    rows, out = loose(spark, sf).withColumn("out", R.collapse_prose(F.col("text"))), F.col("out")
    return rows.select("doc_id", M.token_count(F.col("text")).alias("before"), M.token_count(out).alias("after"), F.length(out).cast("long").alias("chars"), F.sha2(out, 256).alias("out_sha256"))


@query("e4_unwrap_nocompress", "select doc_id, sha256(lang || ' keep ' || text) as out_sha256, doc_id % 2 = 0 as protected from documents")
def e4(spark, sf):
    both, open_ = F.concat("lang", F.lit(" <nocompress>keep</NoCompress> "), "text"), F.concat("lang", F.lit(" keep</nocompress> "), "text")
    wrapped = F.when(F.col("doc_id") % 2 == 0, both).otherwise(open_)
    out = R.unwrap_nocompress(F.col("t"))
    return docs(spark, sf).select("doc_id", wrapped.alias("t")).select("doc_id", F.sha2(out["text"], 256).alias("out_sha256"), out["protected"].alias("protected"))


BANNER = "Generated support export. Internal routing metadata follows."


@query("e5_drop_phrases", "select doc_id, lang, sha256(case when lang = 'fr' then trim(regexp_replace('Bonjour ' || text, ' {2,}', ' ', 'g')) else text end) as same_body from (select doc_id, lang, regexp_replace(regexp_replace(regexp_replace(text, ' +([.,;:!?\n])', '\\1', 'g'), ' {2,}', ' ', 'g'), ' +([.,;:!?\n])', '\\1', 'g') as text from documents)")
def e5(spark, sf):
    """English texts lose a banner; an unsafe phrase stays where it is asked for; other tenants keep theirs."""
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r" +([.,;:!?\n])", "$1"), " {2,}", " "), r" +([.,;:!?\n])", "$1")
    rows = docs(spark, sf).select("doc_id", "lang", tidy.alias("text"))
    rows = rows.withColumn("text", F.when(F.col("lang") == "en", F.concat(F.lit(BANNER + " "), "text")).when(F.col("lang") == "fr", F.concat(F.lit("Bonjour "), "text")).otherwise(F.col("text")))
    phrases = spark.createDataFrame([("en", BANNER), ("fr", "Do not delete ticket UT-1042."), ("de", "Never shown here")], "lang string, phrase string")
    out = R.drop_phrases(rows, "text", "lang", phrases)
    fr = F.trim(F.regexp_replace("dropped", " {2,}", " "))
    return out.select("doc_id", "lang", F.sha2(F.when(F.col("lang") == "fr", fr).otherwise(F.col("dropped")), 256).alias("same_body"))


#: The character references that the pages hold; the operator decodes all of them.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _page_sql():
    x = "html"
    for t in ("script", "style", "template", "svg", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{t}\b.*?</{t}\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<li[^>]*>', chr(10) || '- ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:br|p|div|tr|article|main|section|footer|header|nav|ul|ol|table|title)[^>]*>|</(?:p|div|h[1-6]|tr|article|main|section|footer|header|nav|ul|ol|table|title)>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, value in ENTITIES:
        x = f"replace({x}, {lit(name)}, {lit(value)})"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("e6_page_text", f"select page_id, {tok('html')} as before, {tok('t')} as after, sha256(t) as text_sha256 from (select page_id, html, {_page_sql()} as t from pages)")
def e6(spark, sf):
    rows = table(spark, sf, "pages", spread=True).withColumn("t", R.page_text(F.col("html")))
    return rows.select("page_id", M.token_count(F.col("html")).alias("before"), M.token_count(F.col("t")).alias("after"), F.sha2("t", 256).alias("text_sha256"))


@query("e7_page_text_gate", rf"select page_id, length(html) >= 1000 and length(t) <= length(html) * 0.8 as accepted, regexp_matches(html, '(?i)<(?:main|article)\b') and not regexp_matches(html, '(?i)<(?:form|input|button|select|textarea|pre|code)\b') as equivalent, length(case when length(html) >= 1000 and length(t) <= length(html) * 0.8 then t else html end)::bigint as chars from (select page_id, html, {_page_sql()} as t from pages)")
def e7(spark, sf):
    rows = table(spark, sf, "pages", spread=True).withColumn("t", R.page_text(F.col("html")))
    gate = R.page_text_gate(F.col("html"), F.col("t"))
    return rows.select("page_id", gate["accepted"].alias("accepted"), gate["equivalent"].alias("equivalent"), F.length(gate["text"]).cast("long").alias("chars"))


@query("e8_json_minify", "select event_id, case when event_id % 3 = 2 then '{\"k\":1,\"k\":2  }' else replace(replace(props, ': ', ':'), ', ', ',') end as small from events")
def e8(spark, sf):
    wide = F.when(F.col("event_id") % 3 == 2, '{"k":1,"k":2  }').otherwise(F.replace("props", F.lit("{"), F.lit("{   ")))
    return table(spark, sf, "events", spread=True).select("event_id", R.json_minify(wide).alias("small"))


COLS = ("l_linenumber", "l_partkey", "l_suppkey")
ROW_JSON = "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {c}" for c in COLS) + " || '}'"


@query("e9_tabular_encode", f"""select l_orderkey, count(*) as n, count(*) >= 2 as applied, case when count(*) >= 2 then 'lines[' || count(*) || ']{{{','.join(COLS)}}}:' || chr(10) || string_agg('  ' || {" || ',' || ".join(COLS)}, chr(10) order by l_linenumber, l_partkey, l_suppkey)
  else '[' || string_agg({ROW_JSON}, ',') || ']' end as encoded from lineitem group by l_orderkey""")
def e9(spark, sf):
    out = R.tabular_encode(table(spark, sf, "lineitem"), "l_orderkey", F.lit("lines"), list(COLS), list(COLS))
    return out.select("l_orderkey", "n", "encoded", "applied")


@query("e10_literal_candidates", f"""select doc_id, literal, n, row_number() over (partition by doc_id order by first) as nth from (
  select doc_id, m as literal, count(*) as n, min(i) as first from (select doc_id, unnest(u) as m, generate_subscripts(u, 1) as i from (select doc_id, regexp_extract_all(text, {lit(P.SPANS['url'])}) as u from ({INCIDENTS}))) group by doc_id, m) where n >= 2 and length(literal) >= 32""")
def e10(spark, sf):
    found = R.literal_candidates(incidents(spark, sf), "doc_id", "text")
    return found.select("doc_id", "literal", "n", F.col("nth").cast("long").alias("nth"))


LONG = f"list_filter(list_distinct(u), lambda x: length(x) >= 32 and len(list_filter(u, lambda y: y = x)) >= 2)"


@query("e10_alias_literals", f"""select doc_id, ok as applied, {tok('text')} as before, case when ok then {tok('new')} else {tok('text')} end as after, sha256(case when ok then new else text end) as out_sha256
  from (select *, {tok('text')} - {tok('new')} >= 1 and {tok('text')} - {tok('new')} >= 0.01 * {tok('text')} and not contains(text, '[A]') as ok
  from (select doc_id, text, coalesce('[A]=' || l[1] || chr(10) || replace(text, l[1], '[A]'), text) as new from (select doc_id, text, {LONG} as l from (select doc_id, text, regexp_extract_all(text, {lit(P.SPANS['url'])}) as u from ({INCIDENTS})))))""")
def e10b(spark, sf):
    """An incident holds one literal that is long and repeated, its run's URL."""
    out = R.alias_literals(incidents(spark, sf), "doc_id", "text", min_tokens=1, min_reduction=0.01)
    return out.select("doc_id", "applied", M.token_count(F.col("text")).alias("before"), M.token_count(F.col("aliased")).alias("after"), F.sha2("aliased", 256).alias("out_sha256"))


WRAPPER = BANNER + " " + ("routing code alpha beta gamma " * 8).strip()
BETWEEN = f"{lit(WRAPPER)} || chr(10) || chr(10) || text || chr(10) || chr(10) || case when doc_id % 2 = 0 then {lit(WRAPPER)} else 'Other closing paragraph.' end"


@query("e11_alias_duplicate_blocks", f"""select doc_id, ok as applied, sha256(case when ok then new else t end) as out_sha256
  from (select *, doc_id % 2 = 0 and {tok('t')} - {tok('new')} >= 32 and {tok('t')} - {tok('new')} >= 0.10 * {tok('t')} and not contains(t, '[D1]') as ok
  from (select doc_id, t, '[D1]=' || {lit(WRAPPER)} || chr(10) || replace(t, {lit(WRAPPER)}, '[D1]') as new from (select doc_id, {BETWEEN} as t from documents)))""")
def e11(spark, sf):
    """Whole documents between wrappers: every other one repeats an approved paragraph; long ones don't save enough."""
    rows = docs(spark, sf).select("doc_id", F.expr(BETWEEN.replace("chr(10)", "char(10)")).alias("t"))
    return R.alias_duplicate_blocks(rows, "doc_id", "t", [BANNER]).select("doc_id", "applied", F.sha2("aliased", 256).alias("out_sha256"))


#: All incidents have one form, so their masks are one text and what is kept follows from the order.
MASKED = "'Incident __CK_KEEP_0000__ shows queue latency above __CK_KEEP_0001__. The customer may receive a credit only if the outage exceeds __CK_KEEP_0002__ minutes.' || chr(10) || 'Dashboard __CK_KEEP_0003__.' || chr(10) || 'Keep retry_limit at __CK_KEEP_0004__ unless legal approves a written amendment.'"
KEPT = r"concat_ws('|', regexp_extract(text, 'INC-[0-9]+'), regexp_extract(text, '250 ms .*[0-9]{4}-[0-9]{2}-[0-9]{2}'), '240', regexp_extract(text, 'https.*example[.]com'), '3')"


@query("e12_mask_restore", f"select doc_id, sha256(text) as restored_sha256, true as whole, sha256({MASKED}) as masked_sha256, {KEPT} as kept from ({INCIDENTS})")
def e12(spark, sf):
    rows = incidents(spark, sf).withColumn("m", R.mask_spans(F.col("text"))).select("doc_id", "m.masked", "m.kept")
    restored, whole = R.restore_spans(F.col("masked"), F.col("kept")), R.mask_is_whole(F.col("masked"), F.col("kept"))
    return rows.select("doc_id", F.sha2(restored, 256).alias("restored_sha256"), whole.alias("whole"), F.sha2("masked", 256).alias("masked_sha256"), F.array_join("kept", "|").alias("kept"))


@query("e13_prune_to_rate", f"""with w as ({WORDS}), s as (select word, round(ln((select count(distinct doc_id) from documents) / count(distinct doc_id)), 6) as score from w group by word),
 r as (select w.doc_id, w.pos, w.word, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by score desc, pos) as r from w join s using (word))
 select doc_id, max(n) as n, count(*) as kept, string_agg(word, ' ' order by pos) as pruned from r where r <= greatest(1, ceil(n * 0.5)) group by doc_id""")
def e13(spark, sf):
    return R.prune_to_rate(docs(spark, sf), "doc_id", "text", 0.5)


@query("e14_apply_or_revert", f"select doc_id, s >= 3 and s >= 0.02 * before as applied, case when s >= 3 and s >= 0.02 * before then before - s else before end as tokens from (select doc_id, {tok('text')} as before, {tok('text')} - {tok(FIRST)} as s from documents)")
def e14(spark, sf):
    after = F.regexp_replace("text", "(^| )(?:the|de|der) ", "$1")
    out = docs(spark, sf).withColumn("out", R.apply_or_revert(F.col("text"), after, 3, 0.02))
    return out.select("doc_id", (F.col("out") != F.col("text")).alias("applied"), M.token_count(F.col("out")).alias("tokens"))


@query("l2_unit_scores", f"""with w as ({WORDS}) select word, count(distinct doc_id) as documents, round(ln((select count(distinct doc_id) from documents) / count(distinct doc_id)), 6) as score from w group by word""")
def l2(spark, sf):
    scores = R.idf_scores(docs(spark, sf), "doc_id", "text")
    counts = R.explode_words(docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("documents"))
    return counts.join(scores, "word").select("word", "documents", "score")


def _idf_sql(part: str, key: str, least: int) -> str:
    """Scores from some of the documents, over all of them or by language."""
    of, by = (f"{key}, ", f"on n.{key} = w.{key}") if key else ("", "on true")
    total = f"select {of}count(distinct doc_id) as total from documents where {part} {'group by ' + key if key else ''} having count(distinct doc_id) >= {least}"
    return f"select {'w.' + of if key else ''}word, round(ln(any_value(total) / count(distinct doc_id)), 6) as score from w join ({total}) n {by} where {part} group by {'w.' + of if key else ''}word"


@query("l2_tenant_scores", f"""with w as (select doc_id, lang, unnest(regexp_extract_all(lower(text), {lit(P.WORD)})) as word from documents)
 select w.lang as tenant, w.word as unit, count(*) as n, coalesce(any_value(o.score), any_value(b.score), 0)::double as score, case when any_value(o.score) is not null then 'tenant' when any_value(b.score) is not null then 'base' else 'default' end as scored_by
 from w left join ({_idf_sql('doc_id % 2 = 0', 'lang', 20)}) o on o.lang = w.lang and o.word = w.word left join ({_idf_sql('doc_id % 3 = 0', '', 1)}) b on b.word = w.word group by w.lang, w.word""")
def l2t(spark, sf):
    """Scores of each language from half of its documents, the base from a third of all."""
    d = docs(spark, sf)
    own = SC.tenant_scores(d.where("doc_id % 2 = 0"), "lang", "doc_id", "text", 20)
    base = R.idf_scores(d.where("doc_id % 3 = 0"), "doc_id", "text").withColumnRenamed("word", "unit")
    units = R.explode_words(d.select("lang", "text"), "text").select(F.col("lang").alias("tenant"), F.col("word").alias("unit"))
    return SC.score_units(units, own, base)


@query("l3_pluggable_converter", f"select page_id, length(t)::bigint as chars from (select page_id, {_page_sql()} as t from pages)")
def l3(spark, sf):
    convert = {"html": R.page_text}
    return table(spark, sf, "pages", spread=True).select("page_id", F.length(convert["html"](F.col("html"))).cast("long").alias("chars"))



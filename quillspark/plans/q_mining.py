"""Queries of corpus mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.operators import generators as G
from quillspark.operators import mining as N
from quillspark.plans.common import FIRST, LINES, lit, query, reasons, squashed, table, tok


def docs(spark, sf):
    return table(spark, sf, "documents", spread=True)


EARLY = "case when record_count < 3 then 'below_minimum_records' end, case when record_fraction < 0.01 then 'below_minimum_fraction' end, case when conversation_count < 2 then 'single_conversation_only' end, case when tokens < 4 then 'below_minimum_token_savings' end,"
F1 = f"""select *, rejection_reasons = '' as eligible from (select *, {reasons('block', EARLY)} as rejection_reasons from (
  select l.lang as tenant, block, count(distinct doc_id) as record_count, count(distinct l.source) as conversation_count, round(count(distinct doc_id) / any_value(total), 6)::double as record_fraction, {tok('block')} as tokens
  from ({LINES}) l join (select lang, count(*) as total from documents group by lang) t using (lang) group by l.lang, block))"""


def _found(spark, sf, only_eligible=False):
    return N.discover_boilerplate(docs(spark, sf), "lang", "doc_id", "source", "text", unit="line", min_records=3, min_fraction=0.01, min_tokens=4, only_eligible=only_eligible)


@query("f1_discover_boilerplate", F1)
def f1(spark, sf):
    return _found(spark, sf)


@query("f1_paragraphs", f"""select lang as tenant, block, count(distinct doc_id) as record_count, count(distinct source) as conversation_count, {tok('block')} as tokens from (
  select lang, doc_id, source, {squashed('p')} as block from (select lang, doc_id, source, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as p from documents)) where block <> '' group by lang, block""")
def f1p(spark, sf):
    found = N.discover_boilerplate(docs(spark, sf), "lang", "doc_id", "source", "text")
    return found.select("tenant", "block", "record_count", "conversation_count", "tokens")


@query("i1_rank_candidates", f"select tenant, block, record_count, tokens from ({F1}) where eligible order by record_count desc, tokens desc, block, tenant")
def i1(spark, sf):
    return N.rank_candidates(_found(spark, sf, only_eligible=True)).select("tenant", "block", "record_count", "tokens")


@query("f2_duplicate_blocks", f"select doc_id, sum(n - 1)::bigint as extra, sum((n - 1) * tokens)::bigint as extra_tokens, sum((n - 1) * length(block))::bigint as extra_chars from (select doc_id, block, count(*) as n, {tok('block')} as tokens from ({LINES}) group by doc_id, block) where n > 1 and tokens >= 4 group by doc_id")
def f2(spark, sf):
    return N.duplicate_blocks(docs(spark, sf), "doc_id", "text", min_tokens=4)


@query("b8_duplicate_lines", f"select doc_id, sum(n - 1)::bigint as duplicate_lines, sum((n - 1) * length(l))::bigint as duplicate_chars from (select doc_id, lower({squashed('line')}) as l, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(trim(line)) >= 20 group by 1, 2) where n > 1 group by doc_id")
def b8d(spark, sf):
    return N.duplicate_lines(docs(spark, sf), "doc_id", "text")


def _w(text):
    return f"select doc_id, word, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower({text}), {lit(P.WORD)})) as word from documents) group by doc_id, word"


DELETED = f"select a.doc_id, a.word, a.n - coalesce(b.n, 0) as n from ({_w('text')}) a left join ({_w(FIRST)}) b using (doc_id, word) where a.n > coalesce(b.n, 0)"


def _after(df):
    return df.withColumn("text", F.regexp_replace("text", "(^| )(?:the|de|der) ", "$1"))


@query("f14_deleted_words_top", f"select word, sum(n)::bigint as occurrences, count(*) as documents from ({DELETED}) group by word order by occurrences desc, word limit 50")
def f14(spark, sf):
    d = docs(spark, sf)
    return N.deleted_words_top(d, _after(d), "doc_id", "text", 50)


SAFE = "(^| )(?:all|not|only|can|may|no) "


@query("f15_safety_deletions", """select category, sum(n)::bigint as tokens, count(*) as documents from (select category, doc_id, sum(n) as n from (select doc_id, n, case """ + " ".join(f"when word in ({', '.join(lit(t) for t in terms)}) then '{k}'" for k, terms in P.SAFETY_TERMS.items()) + f""" end as category from (
  select a.doc_id, a.word, a.n - coalesce(b.n, 0) as n from ({_w("'not all may only must ' || text")}) a left join ({_w("regexp_replace('not all may only must ' || text, '" + SAFE + "', '" + chr(92) + "1', 'g')")}) b using (doc_id, word) where a.n > coalesce(b.n, 0))) where category is not null group by category, doc_id) group by category""")
def f15(spark, sf):
    d = docs(spark, sf).withColumn("text", F.concat(F.lit("not all may only must "), "text"))
    return N.safety_deletions(d, d.withColumn("text", F.regexp_replace("text", SAFE, "$1")), "doc_id", "text")


HTML = {"link": r'<a\s[^>]*href="([^"]*)"', "comment": r"(?s)<!--(.*?)-->", "item": r"(?s)<li[^>]*>(.*?)</li>"}


@query("f24_page_chrome", "select host, kind, piece, count(*) as pages from (" + " union ".join(f"select distinct page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, '{k}' as kind, unnest(regexp_extract_all(html, {lit(p)}, 1)) as piece from pages" for k, p in HTML.items()) + ") group by host, kind, piece having count(*) >= 3")
def f24(spark, sf):
    return N.page_chrome(table(spark, sf, "pages", spread=True), "page_id", "url", "html")


@query("f18_kind_counts", "select page_id, map_from_entries(list_sort(list((kind, n)))) as kinds from (select page_id, kind, count(*) as n from (" + " union all ".join(f"select page_id, '{k}' as kind, unnest(regexp_extract_all(html, {lit(p)}, 1)) as piece from pages" for k, p in HTML.items()) + ") group by page_id, kind) group by page_id")
def f18(spark, sf):
    from quillspark.operators import reports

    pieces = G.explode_html(table(spark, sf, "pages", spread=True), "html").where(F.col("kind").isin(*HTML))
    return reports.kind_counts(pieces, "page_id", "kind")


@query("i2_top_n", f"select word, sum(n)::bigint as n from ({_w('text')}) group by word order by n desc, word limit 100")
def i2(spark, sf):
    return N.word_counts(docs(spark, sf), "doc_id", "text").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(100)

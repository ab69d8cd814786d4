"""Worked examples of single operators."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import patterns as P
from quillspark.operators import compare as C
from quillspark.operators import conversations as V
from quillspark.operators import generators as G
from quillspark.operators import mining as N
from quillspark.operators import profiles, reports
from quillspark.operators import rewrite as R
from quillspark.sources import corpus


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


@pytest.mark.parametrize(("text", "n"), [("", 0), ("Hello, world!", 4), ("naïve café 42", 3), ("a b c", 3), ("éx", 3), ("...", 3)])
def test_token_count(spark, text, n):
    assert one(spark, M.token_count, text) == n


def test_boilerplate_examples(spark):
    phrase = "This export was generated for support staff by the console"
    rows = [("r1", "c1"), ("r2", "c2"), ("r3", "c3")]
    df = spark.createDataFrame([(r, c, f"{phrase}\n\nUnique {i}.", "t") for i, (r, c) in enumerate(rows)], "record string, conv string, text string, tenant string")
    got = {r.block: r for r in N.discover_boilerplate(df, "tenant", "record", "conv", "text", min_records=3, min_fraction=1.0).collect()}
    assert got[phrase].eligible and got[phrase].record_count == 3 and not got["Unique 0."].eligible
    df = df.withColumn("text", F.lit("Do not delete ticket UT-1042 before 2026-08-15."))
    (bad,) = N.discover_boilerplate(df, "tenant", "record", "conv", "text", min_records=3, min_fraction=1.0).collect()
    assert bad.rejection_reasons.split(",") == ["contains_protected_span_or_clause", "instruction_or_policy_bearing", "task_specific_field"]


def test_spans_examples(spark):
    df = texts(spark, "Do not delete ORD-7781 before paying $15,000 by 2026-08-15.", "The account ORD-7781 costs $15,000.", "no spans here", "see [a](b) and {{ x }} `code` ~~~\nk=1\n~~~\nend")
    got = {}
    for r in G.explode_spans(df, "text").orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.span))
        assert r.text[r.start : r.end] == r.span
    assert [k for k, _ in got[0]] == ["constraint", "identifier", "money", "number"]
    assert got[1] == [("identifier", "ORD-7781"), ("money", "$15,000")]
    assert 2 not in got
    assert [k for k, _ in got[3]] == ["markdown_link", "template", "inline_code", "code_fence"]


def plain_spans(text):
    found = []
    for kind, p in P.SPANS.items():
        p = p.replace("(?<fence>", "(?P<fence>").replace(r"\k<fence>", "(?P=fence)")
        found += [(m.start(), m.end(), kind, m[0]) for m in re.finditer(p, text)]
    out = []
    for s in sorted(found, key=lambda x: (x[0], x[0] - x[1], list(P.SPANS).index(x[2]))):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def test_spans_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    incidents = corpus.incident_corpus(spark.read.parquet(f"{sf}/orders.parquet"))
    for df in (docs, incidents):
        rows = {r.doc_id: r.text for r in df.collect()}
        got = sorted((r.doc_id, r.start, r.end, r.kind, r.span) for r in G.explode_spans(df, "text").collect())
        assert got == sorted((i, *s) for i, t in rows.items() for s in plain_spans(t))


def test_clauses_example(spark):
    text = "Context only. The customer may receive a credit only if the outage exceeds 240 minutes. Keep retry_limit at 3 unless legal approves a written amendment."
    rows = G.explode_clauses(texts(spark, text), "text").orderBy("pos").collect()
    assert [r.critical for r in rows] == [False, True, True]


def test_percentiles_and_groups(spark):
    df = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 200.0), ("b", 1, None)], "k string, size long, ms double")
    (a,) = [r for r in reports.distribution(df, "ms", ["k"]).collect() if r.k == "a"]
    assert (a.n, a.p50, a.p90, a.mean) == (2, 150.0, 190.0, 150.0)
    assert sorted(r.group_type for r in reports.grouped_summary(df, ["k", "size"], "ms").collect()) == ["all"] * 3 + ["k"] * 2 + ["overall"] + ["size"] * 2


def test_cohort_checks(spark):
    rows = [("p", "raw", "h"), ("p", "det", "h"), ("q", "raw", "h"), ("r", "raw", "h"), ("r", "det", "other")]
    df = spark.createDataFrame(rows, "id string, condition string, digest string")
    assert {(r.id, r.missing, r.inputs) for r in C.verify_cohort(df, ["id"], "condition", "digest", ["raw", "det"]).collect()} == {("q", "det", 1), ("r", "", 2)}


def test_label_tokens(spark):
    terms = spark.createDataFrame([("LORATENANT",), ("ADAPTERACTIVE",)], "term string")
    rows = G.explode_label_tokens(texts(spark, "LORATENANT filler LORATENANT ADAPTERACTIVE"), "text", terms).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows if r.label] == [(0, 10), (18, 28), (29, 42)] and len(rows) == 4


@pytest.mark.parametrize(
    ("text", "kind"),
    [('{"a": 1}', "strict_json_object"), ("[1, 2]", "strict_json_array"), ('{"a": 1}\n{"b": 2}', "ndjson"), ('{"a": 1} {"b": 2}', "concatenated_json"), ('{"a": 1, // x\n}', "jsonc_like"), ("{a: 1}", "javascript_object_like"), ("{{ x }}", "template_like"), ('{"a" 1}', "invalid_balanced"), ('{"a": 1', "invalid_unbalanced")],
)
def test_json_syntax_class(spark, text, kind):
    assert one(spark, M.json_syntax_class, text) == kind


def test_whole_json(spark):
    assert one(spark, M.canonical_json_sha256, '{"b": 1, "a": 2}') == one(spark, M.canonical_json_sha256, '{"a":2,"b":1}')
    assert one(spark, M.canonical_json_sha256, '{"a": 1, "a": 2}') is None and one(spark, M.canonical_json_sha256, '{"a": 1} x') is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("a  \nb \nc", "a  \nb\nc"), ("a\n\n\n\n\nb", "a\n\n\nb"), ("```\nx   \n\n\n\n\ny\n```\nz ", "```\nx   \n\n\n\n\ny\n```\nz "), ("<html><body>x   </body></html>", "<html><body>x   </body></html>"), ("", ""), ("tail ", "tail ")],
)
def test_normalize_whitespace(spark, text, want):
    assert one(spark, R.normalize_whitespace, text) == want


@pytest.mark.parametrize(("text", "want"), [("two   words  here", "two words here"), ("| a  | b |", "| a  | b |"), ("1.  item  x", "1.  item  x"), ("> quote  x", "> quote  x"), ("key:  value  x", "key:  value  x"), ("  lead  x", "  lead  x"), ("hard   break  ", "hard break  "), ("You must not delete  it.", "You must not delete  it.")])
def test_collapse_prose(spark, text, want):
    assert one(spark, R.collapse_prose, text) == want


def test_page_text(spark):
    page = "<html><head><script>x</script></head><body><nav><ul><li>Home</li></ul></nav><h1>Title</h1><p>A &amp; B<br>C</p><!-- no --></body></html>"
    assert one(spark, R.page_text, page) == "- Home\n\n# Title\n\nA & B\nC"


def test_page_text_decodes_all_references(spark):
    assert one(spark, R.page_text, "<p>a&mdash;b caf&eacute; &#8217;x&#x27; &amp;lt; &hellip;&unknown; R&D</p>") == "a—b café ’x' &lt; …&unknown; R&D"


def test_page_text_leaves_cut_references(spark):
    assert one(spark, R.page_text, "<h1>a&amp;&amp</h1><p>&notit; &#65 &#65;</p>") == "# a&&amp\n\n&notit; &#65 A"


def test_labels_overlap_terms(spark):
    rows = texts(spark, "LORATENANT tenantnoise", "a big red-ish Dog, bigger dogs", None, "")
    terms = spark.createDataFrame([("ORATEN",), ("big red",), ("d dog",), ("ger d",), ("",)], "t string")
    got = {}
    for r in G.explode_label_tokens(rows, "text", terms).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.token, r.label))
    assert got == {0: [(0, 10, "LORATENANT", 1), (11, 22, "tenantnoise", 0)], 1: [(0, 1, "a", 0), (2, 5, "big", 1), (6, 13, "red-ish", 1), (14, 17, "Dog", 0), (19, 25, "bigger", 1), (26, 30, "dogs", 1)]}
    none = G.explode_label_tokens(rows, "text", terms.where("false"))
    assert {r.label for r in none.collect()} == {0}


def test_json_regions(spark):
    text = 'See {name} and {"a": [1, {"a": 2, "a": 3}]}x {"b": 1}\n\n[2] tail {"c": 1} {bad: 1} [' + "[" * 3000
    got = [(r.syntax, r.region, r.duplicate_keys, r.ambiguous) for r in G.explode_json_regions(texts(spark, text, None), "text").orderBy("start").collect()]
    assert got == [("strict_json_array", '[1, {"a": 2, "a": 3}]', ["a"], False), ("ndjson", '{"b": 1}', [], False), ("ndjson", "[2]", [], False), ("strict_json_object", '{"c": 1}', [], False)]
    (plain,) = G.explode_json_regions(texts(spark, 'é {"k": "]"}'), "text").collect()
    assert (plain.start, plain.end, plain.ambiguous) == (2, 12, False)


def test_overlaps_meet_once(spark):
    import random

    r = random.Random(8)
    make = lambda n, long: [(r.randint(0, 2), i, a := r.randint(0, 3000), a + r.randint(0, long)) for i in range(n)]  # noqa: E731, F841
    tokens, spans = make(150, 12), make(60, 2500)
    t = spark.createDataFrame(tokens, "doc long, pos long, start long, end long")
    s = spark.createDataFrame(spans, "doc long, pos long, start long, end long")
    got = sorted(tuple(x) for x in C.overlap_join(t, s, "doc", width=256).select("t.doc", "t.pos", "s.pos").collect())
    assert got == sorted((d, i, j) for d, i, a, b in tokens for e, j, x, y in spans if d == e and a < y and b > x)


def test_eval_checks(spark):
    schema = "case string, output string, original_tokens long, compressed_tokens long, elapsed_ms double, sections array<string>, required array<string>, spaceless array<string>, forbidden array<string>, section_kinds array<string>, min_reduction double, max_elapsed_ms double"
    rows = [("a", "keep  this", 10, 8, 5.0, ["prose"], ["keep"], ["keep this"], ["drop"], ["prose"], 0.1, 10.0), ("b", " ", 10, 12, 5.0, [], ["keep"], None, [" "], ["code"], 0.1, 1.0), ("c", "x", 0, 0, 1.0, None, None, None, None, None, None, None)]
    got = {}
    for r in reports.eval_checks(spark.createDataFrame(rows, schema), "case").collect():
        got.setdefault(r.case, {})[r.check] = (r.severity, r.passed)
    names = ["non_empty_output", "not_larger_than_input", "required_0", "required_whitespace_insensitive_0", "forbidden_0", "section_prose"]
    assert got["a"] == {n: ("error", True) for n in names} | {n: ("warning", True) for n in ("min_reduction", "max_elapsed_ms")}
    assert got["b"] == {n: ("error", False) for n in ("non_empty_output", "not_larger_than_input", "required_0", "forbidden_0", "section_code")} | {n: ("warning", False) for n in ("min_reduction", "max_elapsed_ms")}
    assert got["c"] == {"non_empty_output": ("error", True), "not_larger_than_input": ("error", True)}


def test_exact_percentiles(spark):
    import random
    from statistics import quantiles

    r = random.Random(5)
    rows = [(k, float(r.choice((r.randint(0, 9), r.random() * 100)))) for k in ("a", "b", None) for _ in range(301)] + [("one", 4.0), ("nulls", None), ("a", None)]
    got = {x.k: x.p for x in reports.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for k in ("a", "b", None):
        v = [x for g, x in rows if g == k and x is not None]
        assert got[k] == pytest.approx([min(v), *quantiles(v, n=4, method="inclusive"), max(v)])
    assert got["one"] == [4.0] * 5 and "nulls" not in got


def test_masks_round_trip(spark):
    text = "Call ORD-7781 and ORD-7782 for $15,000.\nThen mail a@b.co or see https://x.y/z now, item 12."
    row = texts(spark, text, "nothing").withColumn("m", R.mask_spans(F.col("text"))).select("text", "m.masked", "m.kept")
    for r in row.withColumn("back", R.restore_spans(F.col("masked"), F.col("kept"))).withColumn("whole", R.mask_is_whole(F.col("masked"), F.col("kept"))).collect():
        assert r.back == r.text and r.whole
        assert "__CK_KEEP_0000__" in r.masked or not r.kept


def test_aliases_expand_to_the_input(spark, sf):
    incidents = corpus.incident_corpus(spark.read.parquet(f"{sf}/orders.parquet"))
    rows = R.alias_literals(incidents, "doc_id", "text", min_tokens=1, min_reduction=0.01).collect()
    assert any(r.applied for r in rows)
    for r in rows:
        if r.applied:
            legend, body = r.aliased.split("\n", 1)
            alias, literal = legend.split("=", 1)
            assert body.replace(alias, literal) == r.text
    assert [one(spark, lambda c: R.alias_label(c.cast("int")), str(n)) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_chunks_join_to_the_text(spark):
    text = "word " * 5000 + "x" * 9000 + "\nend"
    rows = G.chunk_text(texts(spark, text, "short"), "text", 4000).orderBy("doc_id", "pos").collect()
    assert "".join(r.chunk for r in rows if r.doc_id == 0) == text and max(len(r.chunk) for r in rows) <= 4000


def test_tabular_encode(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "x,y"), ("h", 2, "z"), ("i", 1, "one")], "g string, n int, v string")
    got = {r.g: r for r in R.tabular_encode(df, "g", F.lit("items"), ["n", "v"], ["n"]).collect()}
    assert got["g"].encoded == "items[2]{n,v}:\n  1,a\n  2,b" and not got["h"].applied and got["i"].encoded == '[{"n":1,"v":"one"}]'


def test_messages(spark):
    df = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "assistant", "hi"), ("c", 2, "user", "hi"), ("c", 3, "user", " "), ("c", 4, "user", " "), ("d", 0, "user", "hi")], "conv string, turn int, role string, text string")
    assert sorted((r.conv, r.turn) for r in V.compact_duplicates(df, "conv", ["turn"], "text", "role").where("duplicate").collect()) == [("c", 2)]
    assert V.compact_empty(df, "role", "text").count() == 4


def test_segments_and_gate_on_whole_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = G.explode_segments(df.withColumn("t", F.concat("text", F.lit("\n```\ncode\n```\n"), "text")), "t").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append((r.kind, r.segment))
    for r in df.collect():
        assert "".join(s for _, s in got[r.doc_id]) == f"{r.text}\n```\ncode\n```\n{r.text}" and "code" in [k for k, _ in got[r.doc_id]]

    wrapper = "Generated support export. " + "routing code alpha beta gamma " * 8
    wrapped = df.withColumn("t", F.concat(F.lit(wrapper + "\n\n"), "text", F.lit("\n\n" + wrapper)))
    out = R.alias_duplicate_blocks(wrapped, "doc_id", "t", ["Generated support export."])
    want = F.concat(F.lit(f"[D1]={wrapper.strip()}\n[D1] \n\n"), "text", F.lit("\n\n[D1] "))
    before, after = M.token_count(F.col("t")), M.token_count(want)
    gates = {(r.applied, r.open, r.same) for r in out.select("applied", ((before - after >= 32) & (before - after >= before * 0.1)).alias("open"), (F.col("aliased") == F.when(F.col("applied"), want).otherwise(F.col("t"))).alias("same")).collect()}
    assert gates == {(True, True, True), (False, False, True)}


def test_label_tokens_on_whole_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat("text", F.lit(" LORATENANT tail")).alias("text"))
    got = {}
    for r in G.explode_label_tokens(df, "text", spark.createDataFrame([("LORATENANT",)], "term string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.token, r.label))
    long = 0
    for r in df.collect():
        assert sorted(got[r.doc_id]) == [(m.start(), m.end(), m[0], int(m[0] == "LORATENANT")) for m in re.finditer(P.WORD, r.text)]
        long += len(r.text) > 2000
    assert long > 20


def test_duplicates_compare_whole_messages(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    late = rows.withColumn("turn", F.col("turn") + 1000)
    near = late.withColumn("turn", F.col("turn") + 1000).withColumn("text", F.concat("text", F.lit(".")))
    found = V.compact_duplicates(rows.unionAll(late).unionAll(near), "conv_id", ["turn"], "text", "role").where("duplicate").collect()
    assert sorted((r.conv_id, r.turn) for r in found) == sorted((r.conv_id, r.turn) for r in late.where("role = 'user'").collect())


def test_profiles(spark):
    req = spark.createDataFrame([(" t ", 0.4), ("t", None), (None, None)], "tenant_id string, aggressiveness double")
    dim = spark.createDataFrame([("t", 0.3, " ")], "tenant_id string, default_aggressiveness double, profile_id string")
    assert sorted((r.tenant_id, r.effective, r["from"]) for r in profiles.resolve_profile(req, dim).collect()) == [("default", 0.15, "default"), ("t", 0.3, "profile"), ("t", 0.4, "request")]


def test_eval_run(spark):
    checks = [("a", "x", "error", True), ("a", "y", "warning", False), ("b", "x", "error", False)]
    got = {r.case: (r.errors, r.warnings, r.passed) for r in reports.eval_run(spark.createDataFrame(checks, "case string, check string, severity string, passed boolean"), "case").collect()}
    assert got == {"a": (0, 1, True), "b": (1, 0, False)}


def test_fingerprint(spark):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(500)]
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    for levels in ((6, 3), (2, 1), (1,)):
        got = reports.cohort_fingerprint(spark.createDataFrame(rows[::-1], "id long, h string"), "id", "h", levels).first()
        by = {}
        for i, h in rows:
            by.setdefault(hashlib.md5(str(i).encode()).hexdigest()[: levels[0]], []).append(f"{i}:{h}")
        tree = {b: sha(lines) for b, lines in by.items()}
        for digits in levels[1:]:
            up = {}
            for b in sorted(tree):
                up.setdefault(b[:digits], []).append(tree[b])
            tree = {b: sha(h) for b, h in up.items()}
        assert (got.rows, got.fingerprint) == (500, sha(tree[b] for b in sorted(tree))[:16])


def test_many_spans_of_one_text(spark):
    import time

    text = " ".join(f"{i}," for i in range(40_000))
    began = time.perf_counter()
    assert G.explode_spans(texts(spark, text, None), "text").count() == 40_000
    assert time.perf_counter() - began < 30
    masked = texts(spark, text[:60_000], None).withColumn("m", R.mask_spans(F.col("text"))).select("text", R.restore_spans(F.col("m.masked"), F.col("m.kept")).alias("back"))
    assert all(r.back == r.text for r in masked.collect())


@pytest.mark.parametrize("blank", range(6))
def test_blank_runs(spark, blank):
    gap = "\n" * blank
    for text in (gap, f"a{gap}", f"{gap}a", f"a{gap}b", f"a{gap}b{gap}c \n \nd{gap}"):
        run, out = 0, []
        for x in text.split("\n"):
            x = x.rstrip(" \t")
            run = run + 1 if x == "" else 0
            if run <= 2:
                out.append(x)
        assert one(spark, R.normalize_whitespace, text) == "\n".join(out)


def test_tool_exchange_and_contexts(spark):
    assert one(spark, M.has_tool_exchange, '[{"role": "TOOL"}]') and one(spark, M.has_tool_exchange, '{"a": {"tool_use_id": 1}}') and not one(spark, M.has_tool_exchange, '{"type": "text"}')
    assert one(spark, M.requires_exact_output, "Please RETURN THE INPUT EXACTLY") and not one(spark, M.requires_exact_output, "exactly")
    assert one(spark, M.verbatim_context, "Schema: x") and one(spark, M.verbatim_context, "preserve the template") and not one(spark, M.verbatim_context, "preserve it")
    assert one(spark, M.html_exact_context, "please preserve the page css") and not one(spark, M.html_exact_context, "exact\nhtml")


def test_boilerplate_counts_on_digests(spark):
    """Nulls, repeats in one record, records without a conversation; eligible ones alone are the same rows."""
    from quillspark.operators import mining as N

    line = "a quiet river runs past the old mill and the green meadow"
    rows = [("t", 1, "c1", f"{line}\n{line}\nown one"), ("t", 2, "c2", line), ("t", 3, None, line.replace(" ", "  ")), ("t", None, "c1", line), (None, 9, "c", line), ("u", 4, "c", line), ("u", 5, "c", None), ("t", 6, "c6", "")]
    docs = spark.createDataFrame(rows, "tenant string, record long, conversation string, text string")
    found = N.discover_boilerplate(docs, "tenant", "record", "conversation", "text", unit="line", min_records=2, min_fraction=0.1, min_tokens=4)
    got = {(r.tenant, r.block): (r.record_count, r.conversation_count, r.record_fraction, r.eligible) for r in found.collect()}
    assert got == {("t", line): (4, 2, 0.8, True), ("t", "own one"): (1, 1, 0.2, False), ("u", line): (1, 1, 0.5, False)}
    only = N.discover_boilerplate(docs, "tenant", "record", "conversation", "text", unit="line", min_records=2, min_fraction=0.1, min_tokens=4, only_eligible=True)
    assert sorted(only.collect()) == sorted(found.where("eligible").collect())


def test_route_features_come_from_the_text(spark):
    """Nulls and empty texts have none; densities are shares of characters and lines."""
    from quillspark.functions import measures as M

    rows = [(1, None), (2, ""), (3, "see https://a.example/x\n\n- one\n- two"), (4, "return only json"), (5, "the cat and the dog")]
    docs = spark.createDataFrame(rows, "i long, text string")
    found = {r.i: r for r in docs.withColumns(M.route_features(F.col("text"), F.regexp_replace("text", "the ", ""))).collect()}
    for i in (1, 2):
        assert (found[i].tokens, found[i].protected, found[i].structured, found[i].placeholders, found[i].deterministic, found[i].exact) == (0, 0.0, 0.0, 0, 0.0, False)
    assert found[1].segments == 0 and found[3].segments == 2 and found[3].structured == 0.5 and found[3].placeholders >= 1
    assert found[3].protected >= len("https://a.example/x") / len(rows[2][1]) and found[5].deterministic == 0.4 and found[5].tokens == 3

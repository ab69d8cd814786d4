"""Bracketed regions, nested segments, budgeted chunks and many terms at once, on worked examples."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.brackets import regions
from quillspark.operators import generators as G
from quillspark.operators import matching as X
from quillspark.operators import rewrite as R
from quillspark.operators import segments as S


def kinds(text):
    return [(r["syntax"], text[r["start"] : r["end"]]) for r in regions(text)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('prefix {"ok":true} suffix', [("strict_json_object", '{"ok":true}')]),
        ('{"a":1}{"b":2}', [("concatenated_json", '{"a":1}'), ("concatenated_json", '{"b":2}')]),
        ('{"a":1}\n{"b":2}', [("ndjson", '{"a":1}'), ("ndjson", '{"b":2}')]),
        ('{"a":1,}', [("jsonc_like", '{"a":1,}')]),
        ('{"a":1 // b\n}', [("jsonc_like", '{"a":1 // b\n}')]),
        ("{'a': 1}", [("javascript_object_like", "{'a': 1}")]),
        ("{a: 1}", [("javascript_object_like", "{a: 1}")]),
        ("[x](http://a.b)", [("template_or_bracket_syntax", "[x](http://a.b)")]),
        ('{"a":01}', [("invalid_balanced", '{"a":01}')]),
        ('{"a":[1', [("invalid_unbalanced", '{"a":[1'), ("invalid_unbalanced", "[1")]),
        ('["] \\" }"] {}', [("concatenated_json", '["] \\" }"]'), ("concatenated_json", "{}")]),
        ("", []),
        ("no brackets", []),
    ],
)
def test_classes(text, wanted):
    assert kinds(text) == wanted


def test_flags_keys_and_parents():
    (inner,) = [r for r in regions('[invalid {"ticket":"UT-1042"}]') if r["syntax"] == "strict_json_object"]
    assert inner["ambiguous"]
    assert regions('{"a":1,"b":{"c":2,"c":3}}')[0]["duplicate_keys"] == ["c"]
    far = regions("# Exact output schema\n" + "description text " * 40 + '\n{"ticket":"UT-1042"}')[0]
    assert far["flags"] == ["exact_output", "schema"]
    assert regions("# Schema\n\n# Other\n[1]")[0]["flags"] == []


def test_strict_regions_are_what_a_decoder_takes():
    import json

    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(['{', '}', '[', ']', '"', ':', ',', '"a"', '1', 'true', ' ', '\\', '"b":', '-', '0.5']) for _ in range(r.randint(1, 14)))
        for x in regions(text):
            part = text[x["start"] : x["end"]]
            if x["syntax"] in G.SOUND:
                json.loads(part)
            elif x["syntax"] in ("jsonc_like", "invalid_balanced") and x["end"] == len(text):
                with pytest.raises(ValueError):
                    json.loads(part)


@pytest.mark.parametrize("unit", ["[", "[1,", '{"a":[', '["[', '{"\\"[', "{x}", '{"a":1} '])
def test_scanning_is_linear(unit):
    began = time.perf_counter()
    regions(unit * (100_000 // len(unit) + 1))
    assert time.perf_counter() - began < 20


def test_segments_nest_and_join():
    text = "a <nocompress>``` {\"x\": 1}</nocompress> {\"y\": [1]}\n# DATA TO PROCESS\n[1]\n---\n```json\n[2]\n```\n~~~\n[3]\n<pre>\n~~~\n<pre>{\"z\": 2}</pre> <svg> end"
    found = S.pieces(text)
    assert "".join(text[p["start"] : p["end"]] for p in found) == text
    assert [(p["kind"], p["rewritable"]) for p in found] == [
        ("prose", True), ("nocompress", False), ("prose", True), ("json", True), ("prose", True), ("verbatim", False), ("prose", True),
        ("json", False), ("code", False), ("html", False), ("prose", True),
    ]
    merged = S.pieces("# CONTENT FORMATS\nx\n# OPTIONAL FOLLOW-ON CONTENT\ny")
    assert [p["kind"] for p in merged] == ["verbatim"]
    assert S.pieces("<html><p>x</p></html>")[0]["kind"] == "html"
    assert S.pieces("<!DOCTYPE html>\n<html></html>") == [{"start": 0, "end": 29, "kind": "html", "rewritable": False}]
    r = random.Random(2)
    bits = ["<nocompress>", "</nocompress>", "```", "\n", "json\n", "[UI]\n", "[/UI]\n", "# FAILURE MODES\n", "---\n", '{"a":1}', "{", "<pre>", "</pre>", "<b>", "word ", "~~~\n"]
    for _ in range(500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert "".join(text[p["start"] : p["end"]] for p in S.pieces(text)) == text


@pytest.mark.parametrize("unit", ["<nocompress>", "[UI]\n", "<pre>", "```", "~~~~\n", "# CONTENT FORMATS\n"])
def test_segmenting_is_linear(unit):
    began = time.perf_counter()
    S.pieces(unit * 20_000)
    assert time.perf_counter() - began < 20


def test_segments_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (3, "x", "r")], "doc_id long, text string, pos string").withColumnRenamed("pos", "p")
    assert [(r.doc_id, r.kind, r.segment, r.p) for r in S.explode_nested_segments(rows, "text").collect()] == [(3, "prose", "x", "r")]
    assert S.chunk_masked(rows, "text").select("doc_id", "chunk").collect() == [(3, "x")]


def test_chunks_meet_both_budgets(spark):
    r = random.Random(5)
    text = "".join(r.choice(["word ", "line\n", "x" * 70, f"__CK_KEEP_{i:04}__"]) for i in range(4000))
    for most, kept in ((100, 3), (500, 2), (24_000, 80)):
        chunks = S.packed(text, most, kept)
        assert "".join(c for c, _ in chunks) == text
        assert all(len(c) <= most and n <= kept and n == len(S.PLACEHOLDER.findall(c)) for c, n in chunks)
    assert sum(n for _, n in S.packed(text, 500, 2)) == len(re.findall("__CK_KEEP_", text))
    with pytest.raises(ValueError):
        S.chunk_masked(spark.createDataFrame([("a",)], "t string"), "t", 10)


def test_five_thousand_aliases_in_one_text(spark):
    names = [f"LONG_IDENTIFIER_{i:05}_TAIL" for i in range(5000)]
    text = " ".join(f"{n} a {n} b {n} c {n} d {n}" for n in names)
    began = time.perf_counter()
    out = R.alias_literals(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert time.perf_counter() - began < 60
    (one,) = [r for r in out if r.doc_id == 1]
    legend = dict(x.split("=", 1) for x in one.aliased.split("\n")[:5000])
    body = one.aliased.split("\n", 5000)[-1]
    assert one.applied and X.spliced(body, legend) == text


def test_longest_literal_wins_and_clashes_revert(spark):
    assert X.spliced("abcab", {"ab": "1", "abc": "2"}) == "21"
    clash = "[A] " + " ".join(["VERY_LONG_IDENTIFIER_NAME"] * 30)
    (row,) = R.alias_literals(spark.createDataFrame([(1, clash)], "doc_id long, text string"), "doc_id", "text", 1, 0.0).collect()
    assert not row.applied and row.aliased == clash


def test_ten_thousand_rules_in_one_walk(spark):
    docs = spark.createDataFrame([(1, "a", 'has term00007 and {"k": {"deep": 1}}'), (2, "b", None), (3, "c", "x"), (4, None, "x")], "id long, tenant string, text string")
    rules = spark.range(10_000).select(F.lit("a").alias("tenant"), F.lit("forbidden").alias("kind"), F.format_string("term%05d", "id").alias("term"))
    more = spark.createDataFrame([("a", "json_key", "deep"), ("a", "json_key", "missing"), ("a", "spaceless", "hasterm 00007"), ("b", "required", "y"), ("b", "forbidden", "y"), (None, "required", "x"), ("a", "required", None)], "tenant string, kind string, term string")
    found = X.constraint_scan(docs, rules.unionByName(more).unionByName(more), "id", "tenant", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.rules, r.failed, r.misses) for r in found.collect()}
    assert got == {1: (10_003, 2, ["forbidden:term00007", "json_key:missing"]), 2: (2, 1, ["required:y"])}


def test_phrases_of_a_key_only(spark):
    rows = spark.createDataFrame([("a", "Kind regards, the team. Sent from my phone. Bye"), ("b", "Sent from my phone. Bye"), ("c", None)], "k string, t string")
    phrases = spark.createDataFrame([("a", "Sent from my phone."), ("a", "Sent from my"), ("b", "Never remove this.")], "k string, phrase string")
    got = {r.k: r.dropped for r in R.drop_phrases(rows, "t", "k", phrases).collect()}
    assert got == {"a": "Kind regards, the team. Bye", "b": "Sent from my phone. Bye", "c": None}


def test_rules_that_a_text_keeps_cost_it_nothing(spark):
    """5,000 texts of a group with 20,000 rules: a step for each pair would take 100 million."""
    import time

    docs = spark.range(5_000, numPartitions=1).selectExpr("id", "'g' as tenant", "concat('code-', id, ' is here') as text")
    rules = spark.range(20_000).selectExpr("'g' as tenant", "'forbidden' as kind", "concat('code-', id + 4990, ' ') as term")
    found = X.constraint_scan(docs, rules, "id", "tenant", "text")
    began = time.time()
    rows = {r["id"]: (r["rules"], r["failed"], r["misses"]) for r in found.collect()}
    assert time.time() - began < 10
    assert rows[7] == (20_000, 0, []) and rows[4_995] == (20_000, 1, ["forbidden:code-4995 "])

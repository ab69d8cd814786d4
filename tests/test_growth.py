"""What larger tables cost: arrays made once, texts matched once and kept out of joins, Python objects of few rows at once."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import batches as B
from quillspark.functions import measures as M
from quillspark.functions import patterns as P
from quillspark.operators import generators as G
from quillspark.operators import rewrite as R
from quillspark.plans import registry
from quillspark.sources import prompts as PR


def optimized(spark, sf, name) -> str:
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["f8_transform_details", "f8_transform_funnel", "f1_discover_boilerplate", "e11_alias_duplicate_blocks", "e13_prune_to_rate", "b9_densities", "d2_span_kind_counts", "f9_nested_totals"])
def test_no_filter_makes_an_array_again(spark, sf, name):
    """Spark infers a filter on the size of an array that is exploded, below ``repartition``."""
    assert "Filter (size(" not in optimized(spark, sf, name)


def test_details_read_their_records_once(spark, sf):
    assert optimized(spark, sf, "f8_transform_details").count("Relation [") == 1


@pytest.mark.parametrize("name", ["j4_integrity_classes", "j5_accept_or_rollback"])
def test_second_version_stands_beside_the_first(spark, sf, name):
    assert optimized(spark, sf, name).count("Join ") == 1


def test_texts_stay_out_of_the_verdict(spark, sf):
    """Only keys and answers reach the join."""
    joined = optimized(spark, sf, "j4_integrity_classes").split("Join LeftOuter")[1].split("\n")[1]
    assert re.search(r"Project \[doc_id#\d+L, exists\(", joined)


def test_pieces_are_cut_in_one_pass(spark):
    """Also where a text holds the mark; each span is what stands at its offsets."""
    texts = ["pay $5 and $6.50, mail a@b.example", "\x01pay $5\x01 now \x01$7\x01", "$1", "", None, "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["doc_id"], r["start"], r["end"], r["span"]) for r in G.explode_spans(docs, "text", ("money",)).collect()]
    want = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer(P.SPANS["money"], t or "")]
    assert sorted(found) == want
    cut = docs.select(G.pieces(F.col("text"), P.JAVA_SPANS["money"]).alias("p")).first()["p"]
    assert [x["m"] for x in cut] == [None, "$5", None, "$6.50", None]


def test_boundaries_look_at_the_first_character(spark):
    for kind in ("constraint", "identifier", "number", "constant"):
        assert P.JAVA_SPANS[kind].replace("(?i)", "").startswith("(?=[") or P.JAVA_SPANS[kind].startswith(r"(?i)(?=\d)")
    # Where words may be missing, or begin with what need not stand there, no character is sure.
    assert "(?=[" not in P.java(r"\b(?:foo|bar)?baz") and "(?=[" not in P.java(r"\b(?:a?b|c)") and "(?=[" not in P.java(r"\b(?:a\(b|c\)d|e)")
    assert P.java(r"\b(?:do\s+not|must(?:\s+not)?|can(?:not|'t)?)\b").startswith("(?=[cdm])")


def test_python_holds_few_rows_at_once():
    seen = []

    def work(part: pa.Array) -> pa.Array:
        seen.append(len(part))
        return part

    texts = pa.array(["x" * 1000] * 500 + [None, ""] + ["y" * 5000])
    assert G.by_slices(work, texts, most=20_000).equals(texts)
    assert sum(seen) == len(texts) and max(seen) < 100
    assert len(G.by_slices(work, texts.slice(0, 0))) == 0


def test_labels_of_many_slices(spark):
    text = "keep tenant keeper é x" * 3
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit(text + " "), 10), F.col("id").cast("string")).alias("text")).coalesce(1)
    found = G.explode_label_tokens(docs, "text", spark.createDataFrame([("keep",)], "t string"))
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("label").alias("kept"), F.max_by("token", "pos").alias("last")).collect()
    n = len(re.findall(P.WORD, (text + " ") * 10 + "1"))
    assert len(rows) == 4000 and {(r["n"], r["kept"]) for r in rows} == {(n, 60)}
    assert all(r["last"] == str(r["doc_id"]) for r in rows)


def test_addresses_about_one_mark(spark):
    """Read outwards from the only @, they are what the pattern finds."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab_.+-1é ,\n", k=rng.randint(0, 12))) + "@" + "".join(rng.choices("ab_.+-1é ,\n", k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ["ops3@example.com.", "..a.b@x.y", "..@x.y", "@", "a@b", "a@b.c@d.e", "x y@z.w-", "𝒜b@c.d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["doc_id"], r["start"], r["end"], r["span"]) for r in G.explode_spans(docs, "text", ("email",)).collect()]
    assert sorted(found) == [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer(P.SPANS["email"], t)]
    plain = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.JAVA_SPANS["email"]), F.lit(0))).alias("m")).collect()
    assert sorted((r["doc_id"], r["m"]) for r in plain) == sorted((i, m) for i, _, _, m in found)


def test_a_line_is_rewritten_in_few_steps(spark, sf):
    """A lambda that names a costly value several times would hold it as often."""
    text = optimized(spark, sf, "e3_collapse_prose")
    assert text.count("regexp_replace(") < 60 and text.count("zip_with(") == 1


def test_tokens_of_batches_are_those_of_matching(spark):
    """Also at the edges of texts, for empty and null ones and beyond ASCII."""
    rng = random.Random(4)
    texts = ["", None, "a", "a b", "ab", "\x1c\x0b \t", "-", "é", "naïve fool", "a b", "日本 2", "💡x", "x_y"] + ["".join(chr(rng.choice((rng.randrange(128), 97, 32, 45))) for _ in range(rng.randrange(40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = docs.select("text", B.batch_token_count(F.col("text")).alias("a"), M.token_count(F.col("text")).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == [] and sum(r.a is None for r in rows) == 1
    ascii_only = docs.where("text = 'a b'").select(B.batch_token_count(F.col("text")))
    assert "RegExpExtractAll" not in ascii_only._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1]


def test_addresses_about_the_only_at_sign_are_those_of_matching(spark):
    rng = random.Random(5)
    texts = ["a@b.c", "..a.b@c.d.", "@", "a@", "x é.a@b-c.dé y", "a@b..c", "a@b.c-", "--@a.b", "a@b.c, d@e.f", "+a@b.c"] + ["".join(rng.choice("ab.+-@ é_") for _ in range(14)) for _ in range(500)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = docs.select("text", M._matches_of(F.col("text"), "email").alias("a"), F.regexp_extract_all("text", F.lit(P.JAVA_SPANS["email"]), F.lit(0)).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == [] and sum(len(r.a) for r in rows) > 20


def test_a_text_is_lower_cased_once_for_all_phrases(spark):
    """A chain of ors lower-cases for each phrase, as what follows the first is worked out only at need."""
    found = spark.createDataFrame([("Byte Exact",), ("no",), (None,)], "text string").select(M.requires_exact_output(F.col("text")).alias("x"))
    assert [r.x for r in found.collect()] == [True, False, None]
    assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_unit_names_its_number_once(spark):
    """``md5`` stands once for each of the three parts."""
    cases = spark.createDataFrame([(1, 100, 0.3, 0.3)], "i long, t long, j double, h double")
    made = PR.synthesize_prompts(cases, "i", "t", "j", "h").select("prose", "json_block", "html_block")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 3


def test_white_space_is_squashed_as_before(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a b", "a  b", "\ta\n", "   x 　y\x85", "a b"] + ["".join(rng.choice("ab  \t\n  \x1f") for _ in range(12)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = docs.select("text", G.squash(F.col("text")).alias("a"), F.trim(F.regexp_replace("text", rf"[{P.SPACE_CLASS}]+", " ")).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []
    assert docs.where("text = 'a b'").select(F.regexp_count(F.col("text"), F.lit(rf"[{P.SPACE_CLASS}&&[^ ]][{P.SPACE_CLASS}]*+| [{P.SPACE_CLASS}]++"))).first()[0] == 0


def test_a_text_without_critical_words_is_not_cut(spark):
    """The same answer as from each clause; parts of a test may stand in different clauses."""
    rng = random.Random(7)
    parts = ["keep", "must not", "above", "7", "exact format", "the", ".", "! ", "\n", " ", "unless", "returning", "x"]
    texts = [None, "", "Keep it. You must", "must keep", "exact\nformat", "exact format", "set.above 5"] + [" ".join(rng.choice(parts) for _ in range(6)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    clauses = F.exists(F.split("text", r"(?<=[.!?])|\n"), M.is_critical_clause)
    rows = docs.select("text", M.has_critical_clause(F.col("text")).alias("a"), clauses.alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == [] and {r.a for r in rows} == {True, False, None}
    plan = docs.select(M.has_critical_clause(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert " AND exists(split(" in plan


def test_boilerplate_texts_are_not_sorted(spark, sf):
    made = registry.QUERIES["f1_discover_boilerplate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in made


def test_words_by_table_are_those_of_the_pattern():
    """Also where marks stand at the edges of texts, beside each other or beside other characters."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab.-'’_ \n9é‘€\x00A") for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += [None, "", "a.", "b", "’", "a’", "’b", "a’b", "a’’b", "a.b-c'd", "日a本"] * 2
    want = [re.findall(P.WORD, t or "") for t in texts]
    assert B.word_lists(pa.array(texts)) == want and B.word_lists(pa.array(texts).slice(40, 900)) == want[40:940]
    assert B.word_lists(pa.array([], pa.string())) == [] and B.word_lists(pa.array([None], pa.string())) == [[]]


def test_words_are_no_rows_of_a_shuffle(spark, sf):
    """A document's words are ranked in its row, and what is joined are words that no function holds."""
    plan = optimized(spark, sf, "e13_prune_to_rate")
    assert "Window" not in plan and "regexp_extract_all" not in plan


def pruned(rows, scores, rate, forced=()):
    """By plain loops: words of an id's texts by position, then by word, as the rows of one id leave ties open."""
    words = {}
    for i, t in rows:
        words.setdefault(i, []).extend(enumerate(re.findall(P.WORD, (t or "").lower())))
    for i, found in words.items():
        best = sorted(sorted(found), key=lambda x: (x[1] not in forced, -scores.get(x[1], 0.0)))
        kept = sorted(best[: max(1, math.ceil(len(found) * rate), sum(w in forced for _, w in found))])
        if found:
            yield i, len(found), len(kept), " ".join(w for _, w in kept)


@pytest.mark.parametrize("most_held", [0, 7, 30, 1 << 17])
@pytest.mark.parametrize("forced", [(), ("w3", "w39")])
def test_pruning_is_the_same_whatever_is_held(spark, most_held, forced):
    rng = random.Random(9)
    some = lambda: " ".join(f"W{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(40)))
    rows = [(i, some()) for i in range(60)] + [(5, some()), (5, some()), (6, None), (70, None), (71, ""), (72, "–"), (73, "x" * 100 + " x"), (None, "w1 of none"), (None, "w2")]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(5)
    holders = {}
    for i, t in rows:
        for w in re.findall(P.WORD, (t or "").lower()):
            holders.setdefault(w, set()).add(i)
    ids = len({i for i, _ in rows if i is not None})
    scores = {w: round(math.log(ids / len(of)), 6) for w, of in holders.items()}
    assert {r.word: r.score for r in R.idf_scores(docs, "id", "t").collect()} == pytest.approx(scores)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = [tuple(r) for r in R.prune_to_rate(docs, "id", "t", 0.3, forced=forced, most_held=most_held).collect()]
    assert sorted(got, key=key) == sorted(pruned(rows, scores, 0.3, forced), key=key)
    given = {f"w{i}": float(i % 7) for i in range(1, 40)} | {"w50": None, "w51": float("nan"), "x": -1.0}
    table = spark.createDataFrame(list(given.items()), "word string, score double")
    got = [tuple(r) for r in R.prune_to_rate(docs, "id", "t", 0.6, table, forced, most_held).collect()]
    known = {w: s for w, s in given.items() if s is not None and s == s}
    assert sorted(got, key=key) == sorted(pruned(rows, known, 0.6, forced), key=key)

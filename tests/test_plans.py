"""Plans: heavy functions run once for each input row."""

import re

from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import patterns as P
from quillspark.operators import compare as C
from quillspark.operators import generators as G
from quillspark.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def passes(df) -> int:
    """Arrow evaluations in the plan."""
    return plan(df).count("ArrowEvalPython [")


def test_exploded_functions_run_once(spark):
    docs = spark.createDataFrame([(1, "pay $5 by 2024-01-02 {\"a\": 1}"), (2, None), (3, "")], "doc_id long, text string")
    for found in (G.explode_spans(docs, "text"), G.explode_json_regions(docs, "text"), G.explode_label_tokens(docs, "text", spark.createDataFrame([("pay",)], "t string"))):
        assert passes(found) == 1
        assert "size(" not in plan(found)
        assert {r["doc_id"] for r in found.collect()} == {1}


def test_each_version_is_read_once(spark, sf):
    for name in ("f12_retention_by_kind", "g2_multiset_diff"):
        assert passes(registry.QUERIES[name](spark, sf)) == 2


def test_null_keys_of_both_sides_meet(spark):
    a = spark.createDataFrame([(None,), (None,), ("x",)], "k string")
    b = spark.createDataFrame([(None,), ("y",)], "k string")
    found = {r["k"]: (r["n_a"], r["n_b"], r["missing"], r["added"]) for r in C.multiset_diff(a, b, ["k"]).collect()}
    assert found == {None: (2, 1, 1, 0), "x": (1, 0, 1, 0), "y": (0, 1, 0, 1)}
    assert C.multiset_diff(a.where(F.lit(False)), b.where(F.lit(False)), ["k"]).count() == 0


def test_percentiles_scan_their_input_once(spark, sf):
    """What is read again are the counts of values, from the shared folder."""
    for name in ("f6_lineitem_distribution", "f7_grouped_summary"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "lineitem.parquet" not in text and "documents.parquet" not in text
        assert "value-counts" in text


def test_values_of_percentiles_are_never_broadcast(spark, sf):
    """And the edges of their ranges are the same for all who read them."""
    text = plan(registry.QUERIES["f7_grouped_summary"](spark, sf))
    assert "percentile_approx" not in text and "percentile-edges" in text
    assert text.count("SortMergeJoin [") >= 3 and "BroadcastHashJoin [" not in text


def test_exploded_tokens_are_never_broadcast(spark, sf):
    assert "BroadcastHashJoin" not in plan(registry.QUERIES["g7_overlap_join"](spark, sf))


def test_route_features_match_each_pattern_once(spark):
    text = "Mail a.b+c@x-y.example and x@ y@@z.example, pay $5.10 by 2024-01-02 for INC-000042\n\n# head\n- item\n{\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    made = docs.withColumns(M.route_features(F.col("text"), F.col("text")))
    assert "lambda" not in plan(made).lower()
    rows = {r["doc_id"]: r for r in made.collect()}
    found = {k: [m.group() for m in re.finditer(P.SPANS[k], text)] for k in M.DENSE_KINDS}
    assert found["email"] == ["a.b+c@x-y.example"]
    assert rows[1]["placeholders"] == sum(map(len, found.values()))
    assert rows[1]["protected"] == sum(len(m) for v in found.values() for m in v) / len(text)
    assert rows[1]["structured"] == 3 / 6 and rows[1]["segments"] == 2 and rows[1]["deterministic"] == 0
    for i in (2, 3):
        assert (rows[i]["tokens"], rows[i]["placeholders"], rows[i]["protected"], rows[i]["identifier"], rows[i]["deterministic"]) == (0, 0, 0.0, 0.0, 0.0)

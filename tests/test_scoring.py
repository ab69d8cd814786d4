"""Prompts filled to budgets, scores by tenant, gains of a candidate scorer."""

import json
import re

from pyspark.sql import functions as F

from quillspark.functions.measures import token_count
from quillspark.operators import scoring as SC
from quillspark.sources import prompts as PR


def test_each_part_meets_its_share(spark):
    cases = PR.grid(spark, [1, 64, 999, 20_000], [0.0, 0.1, 0.5, 1.0], [0.0, 0.25])
    assert cases.count() == 4 * 7 and cases.where("json_share + html_share > 1").count() == 0
    made = PR.synthesize_prompts(cases, "case_id", "target_tokens", "json_share", "html_share")
    sizes = [token_count(F.col(c)).alias(f"n_{c}") for c in ("prose", "json_block", "html_block")]
    units = [token_count(u(F.lit(5).cast("long"))).alias(k) for k, u in (("up", PR.prose_unit), ("uj", PR.json_unit), ("uh", PR.html_unit))]
    frames = [token_count(F.lit(x)).alias(k) for k, x in (("fj", PR.JSON_HEAD + PR.JSON_TAIL), ("fh", PR.HTML_HEAD + PR.HTML_TAIL))]
    for r in made.select("*", *sizes, *units, *frames).collect():
        bj, bh = int(r.target_tokens * r.json_share), int(r.target_tokens * r.html_share)
        for n, budget, unit, frame in ((r.n_prose, max(1, r.target_tokens - bj - bh), r.up, 0), (r.n_json_block, bj, r.uj + 1, r.fj), (r.n_html_block, bh, r.uh, r.fh)):
            assert n == 0 if budget == 0 else max(budget - 1, 0) <= n <= max(budget, frame) + unit, r.case_id
        if r.json_block:
            records = json.loads(r.json_block.partition("\n")[2])["records"]
            assert len({x["ticket"] for x in records}) >= len(records) * 0.98 and all(x["retry_limit"] in (3, 4) for x in records)
        assert r.html_block.count("<section") == r.html_block.count("</section>")
        assert r.text.startswith(PR.TASK) and r.text.endswith(PR.CLOSING) and not re.search("\n\n\n", r.text)
    again = PR.synthesize_prompts(cases, "case_id", "target_tokens", "json_share", "html_share")
    assert again.exceptAll(made).count() == 0


def test_prompts_of_null_rows(spark):
    cases = spark.createDataFrame([(None, None, None, None), ("a", 100, None, 0.5), ("b", 100, 2.0, 0.0)], "k string, t long, j double, h double")
    rows = {r.k: r for r in PR.synthesize_prompts(cases, "k", "t", "j", "h").collect()}
    assert rows[None].prose and not rows[None].json_block and not rows[None].html_block
    assert rows["a"].html_block and not rows["a"].json_block and rows["b"].json_block and rows["b"].prose
    assert PR.synthesize_prompts(cases.where("false"), "k", "t", "j", "h").count() == 0


def test_own_scores_then_base_then_default(spark):
    docs = spark.createDataFrame([("a", 1, "red Blue"), ("a", 2, "red"), ("a", 2, "red"), ("b", 3, "green"), (None, 4, "red"), ("c", 5, None)], "tenant string, doc long, text string")
    own = SC.tenant_scores(docs, "tenant", "doc", "text", 2)
    assert {(r.tenant, r.unit): r.score for r in own.collect()} == {("a", "red"): 0.0, ("a", "blue"): 0.693147}
    base = spark.createDataFrame([("red", 9.0), ("green", 5.0)], "unit string, score double")
    units = spark.createDataFrame([("a", "red"), ("a", "red"), ("a", "green"), ("b", "red"), (None, "red"), ("b", "grey"), ("b", None)], "tenant string, unit string")
    found = {(r.tenant, r.unit): (r.n, r.score, r.scored_by) for r in SC.score_units(units, own, base, default=-1.0).collect()}
    assert found == {("a", "red"): (2, 0.0, "tenant"), ("a", "green"): (1, 5.0, "base"), ("b", "red"): (1, 9.0, "base"), (None, "red"): (1, 9.0, "base"), ("b", "grey"): (1, -1.0, "default"), ("b", None): (1, -1.0, "default")}


def test_gain_is_detected_by_margin_and_change(spark):
    """Means of terms, not of tokens; terms and cases without tokens count as 0."""
    rows = []
    for case, keep in ((1, 0.9), (2, 0.9), (3, 0.5), (4, 0.42)):
        rows += [(case, "candidate", "k", keep), (case, "candidate", "k", keep), (case, "candidate", "d", 0.1), (case, "base", "k", 0.3), (case, "base", "d", 0.1)]
    rows += [(4, "base", "k", 0.3)] * 3
    scores = spark.createDataFrame(rows, "case long, side string, term string, score double")
    outputs = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, None)], "case long, changed boolean")
    found = {r.case: (r.base_margin, r.candidate_margin, r.gain, r.detected, r.failed) for r in SC.detect_gain(scores, outputs, ["k"], ["d"], gain=0.15).collect()}
    assert found == {
        1: (0.2, 0.8, 0.6, True, ""), 2: (0.2, 0.8, 0.6, False, "output_unchanged"), 3: (0.2, 0.4, 0.2, True, ""),
        4: (0.2, 0.32, 0.12, False, "gain_too_small"), 5: (0.0, 0.0, 0.0, False, "output_unchanged,margin_too_small,gain_too_small"),
    }
    halved = SC.detect_gain(scores, outputs, ["k", "never"], ["d"]).where("case = 1").first()
    assert (halved.base_margin, halved.candidate_margin) == (0.05, 0.35)

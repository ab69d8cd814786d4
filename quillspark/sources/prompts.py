"""Prompts of prose, JSON and HTML in given shares of a token budget, the same on every run."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.measures import TokenCounter, token_count

TASK = "Prepare a handover for the support desk. Keep ticket numbers, links, dates and limits as they are."
CLOSING = "Answer with a summary, the open risks and the next three steps."
JSON_HEAD, JSON_TAIL = 'Ticket data:\n{"version": "tickets.v1", "records": [', "\n]}"
HTML_HEAD = 'Saved page:\n<!doctype html>\n<html><head><title>Tickets</title><style>nav{color:gray}</style></head>\n<body><nav><a href="/">Start</a></nav>\n<main>\n'
HTML_TAIL = "</main>\n<footer>Support desk</footer></body></html>"


def grid(spark: SparkSession, tokens: list[int], json_shares: list[float], html_shares: list[float]) -> DataFrame:
    """n, case_id, target_tokens, json_share, html_share: all combinations whose shares fit into one."""
    fits = [(t, float(j), float(h)) for t, j, h in product(tokens, json_shares, html_shares) if j + h <= 1]
    rows = [(n, f"tok{t}_json{round(j * 100)}_html{round(h * 100)}", t, j, h) for n, (t, j, h) in enumerate(fits)]
    return spark.createDataFrame(rows, "n long, case_id string, target_tokens long, json_share double, html_share double")


def _number(seed: Column, kind: str, i: Column) -> Column:
    """A number below 2^32 from the case, the part and the record's place."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.lit(kind), i.cast("string"))), 1, 8), 16, 10).cast("long")


def _six(n: Column) -> Column:
    return F.lpad((n % 1_000_000).cast("string"), 6, "0")


def prose_unit(n: Column) -> Column:
    day = F.lpad((1 + n % 28).cast("string"), 2, "0")
    return F.concat(F.lit("Ticket TCK-"), _six(n), F.lit(" reports slow checkout and repeated retries; its owner expects an update by 2026-09-"), day, F.lit(", see https://status.example.com/t/"), _six(n), F.lit(". "))


def json_unit(n: Column) -> Column:
    region = F.element_at(F.array(F.lit("north"), F.lit("east"), F.lit("west")), (1 + n % 3).cast("int"))
    return F.concat(
        F.lit('\n  {"ticket": "TCK-'), _six(n), F.lit('", "region": "'), region, F.lit('", "retry_limit": '), (3 + n % 2).cast("string"), F.lit(', "p95_ms": '), (250 + n % 700).cast("string"),
        F.lit(', "link": "https://status.example.com/t/'), _six(n), F.lit('"}'),
    )


def html_unit(n: Column) -> Column:
    return F.concat(F.lit('<section id="t'), _six(n), F.lit('"><h2>Ticket TCK-'), _six(n), F.lit("</h2>\n<p>Checkout latency rose; never raise retry_limit above 3. See https://status.example.com/p/"), _six(n), F.lit(".</p></section>\n"))


def _fill(seed: Column, kind: str, unit: Callable[[Column], Column], budget: Column, frame: Column, count: TokenCounter, least: int, between: str = "") -> Column:
    """As many units as the budget needs beside the frame; every unit has the same number of tokens."""
    each = count(F.concat(unit(F.lit(0).cast("long")), F.lit(between)))
    n = F.greatest(F.lit(least).cast("long"), F.ceil((budget - frame) / each))
    # Numbers first: a unit names its number several times, and a lambda would make it for each.
    numbers = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: _number(seed, kind, i))
    return F.array_join(F.transform(numbers, unit), between)


def synthesize_prompts(cases: DataFrame, seed: str, tokens: str, json_share: str, html_share: str, count: TokenCounter = token_count) -> DataFrame:
    """Adds prose, json_block, html_block and text.

    Each part has its share of the budget or up to one unit more (a block with a share holds one
    unit at least, prose always does). Shares over one in all leave prose one unit. The numbers in
    a part follow from ``seed``, so equal rows give equal texts; null budgets and shares are 0.
    """
    total = F.coalesce(F.col(tokens), F.lit(0)).cast("double")
    for_json, for_html = (F.floor(total * F.coalesce(F.col(c), F.lit(0.0)).cast("double")) for c in (json_share, html_share))
    key = F.coalesce(F.col(seed).cast("string"), F.lit(""))
    json = F.concat(F.lit(JSON_HEAD), _fill(key, "json", json_unit, for_json, count(F.lit(JSON_HEAD + JSON_TAIL)), count, 1, ","), F.lit(JSON_TAIL))
    html = F.concat(F.lit(HTML_HEAD), _fill(key, "html", html_unit, for_html, count(F.lit(HTML_HEAD + HTML_TAIL)), count, 1), F.lit(HTML_TAIL))
    made = cases.select(
        "*", _fill(key, "prose", prose_unit, F.greatest(F.lit(1.0), total - for_json - for_html), F.lit(0), count, 1).alias("prose"),
        F.when(for_json > 0, json).otherwise("").alias("json_block"), F.when(for_html > 0, html).otherwise("").alias("html_block"),
    )
    return made.withColumn("text", F.array_join(F.filter(F.array(F.lit(TASK), "prose", "json_block", "html_block", F.lit(CLOSING)), lambda x: x != ""), "\n\n"))

"""Measures and predicates: each takes and gives a Column, so plans stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.batches import batch_token_count

TokenCounter = Callable[[Column], Column]


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(P.java(pattern))


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a lower-cased text contains one of the phrases; ``greatest`` lower-cases it once, a chain of ors for each."""
    low = F.lower(text)
    found = [low.contains(p) for p in phrases]
    return F.greatest(*found) if len(found) > 1 else found[0]


# --- measures -------------------------------------------------------------------------------


def token_count(text: Column) -> Column:
    """Runs of letters and numbers count 1, as does every other character that is no space."""
    return count_of(text, P.TOKEN)


def content_tokens(parts: Column, count: TokenCounter = token_count) -> Column:
    """Tokens over the text parts of an array<struct<type, text>>; other parts count 0."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.when(is_text_part(p), count(p["text"])).otherwise(F.lit(0)))


def is_text_part(part: Column) -> Column:
    kind = part["type"]
    return (F.coalesce(part["text"], F.lit("")) != "") & (kind.isNull() | kind.isin("text", "input_text"))


def text_part_count(parts: Column) -> Column:
    return F.size(F.filter(parts, is_text_part)).cast("long")


def merge_labels(label: Column, default: str = "none") -> Column:
    """Aggregate: the one label, ``mixed:a,b`` in order, or the default."""
    labels = F.array_sort(F.collect_set(label))
    return F.when(F.size(labels) == 0, default).when(F.size(labels) == 1, F.element_at(labels, 1)).otherwise(F.concat(F.lit("mixed:"), F.array_join(labels, ",")))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def whole_json(text: Column) -> Column:
    """The text as a variant; null if it is no JSON, repeats a key, or goes on after the value."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_parse_json(text))


def canonical_json_sha256(text: Column) -> Column:
    """Hash of key-sorted compact JSON; null if the text is no JSON or repeats a key."""
    return F.sha2(F.to_json(whole_json(text)), 256)


def target_rate(aggressiveness: Column, floor: float | Column = 0.45) -> Column:
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), aggressiveness))
    low = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.lit(floor) if isinstance(floor, float) else floor))
    return F.when(a == 0, 1.0).when(a == 1, low).otherwise(1.0 - a * (1.0 - low))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def stage_savings(original: Column, middle: Column, final: Column) -> dict[str, Column]:
    first, second, total = (F.greatest(F.lit(0).cast("long"), x) for x in (original - middle, middle - final, original - final))
    return {
        "deterministic_tokens_saved": first,
        "model_tokens_saved": second,
        "total_tokens_saved": total,
        "deterministic_reduction": ratio(first, original),
        "model_reduction": ratio(second, middle),
        "total_reduction": ratio(total, original),
        "residual_tokens": total - first - second,
    }


def structural_features(text: Column) -> dict[str, Column]:
    """Counts of lines, marks and tags; duplicate lines need ``operators.mining.duplicate_lines``.

    Only line feeds part lines (hence the flag ``d``), and an empty text is one empty line. An empty last line,
    where Java's ``^`` does not match, is counted on its own.
    """
    last = F.when((text == "") | text.endswith("\n"), F.lit(1)).otherwise(F.lit(0))
    return {
        "chars": F.length(text).cast("long"),
        "blank_lines": count_of(text, r"(?dm)^[ \t\r]*$") + last,
        "trailing_space_lines": count_of(text, r"[ \t](?![^\n])"),
        "multi_space_runs": count_of(text, r"(?<=[^\n ]) {2,}"),
        "html_tags": count_of(text, r"</?[A-Za-z][^>]*>"),
        "html_comments": count_of(text, r"<!--[\s\S]*?-->"),
        "headings": count_of(text, r"(?dm)^#{1,6}[ \t]"),
        "bullets": count_of(text, r"(?dm)^[ \t]*[-*+][ \t]+"),
        "json_like_lines": count_of(text, r"(?dm)^[ \t]*[\"{\[]"),
    }


def balanced(text: Column) -> Column:
    """Equal numbers of brackets of each kind, and an even number of quotes."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (n("{") == n("}")) & (n("[") == n("]")) & (F.pmod(n('"'), F.lit(2)) == 0)


def safety_lexemes(text: Column) -> dict[str, Column]:
    return {k: count_of(text, P.java(p)) for k, p in P.SAFETY.items()}


def role_policy(role: Column, aggressiveness: Column, overrides: dict[str, float] | None = None) -> Column:
    """System and tool 0, user the given value, overrides by lower-cased role; others null (kept as they are)."""
    table = {"system": F.lit(0.0), "tool": F.lit(0.0), "user": aggressiveness.cast("double")} | {k.lower(): F.lit(float(v)) for k, v in (overrides or {}).items()}
    found = F.lit(None).cast("double")
    for name, value in table.items():
        found = F.when(F.lower(F.trim(role)) == name, value).otherwise(found)
    return found


def json_value_profile(text: Column) -> dict[str, Column]:
    """Parses?, object / array / scalar, number of keys at any depth, canonical hash."""
    value = whole_json(text)
    shape = F.when(value.isNull(), "invalid").when(F.substring(F.ltrim(text), 1, 1) == "{", "object").when(F.substring(F.ltrim(text), 1, 1) == "[", "array").otherwise("scalar")
    return {"parses": value.isNotNull(), "shape": shape, "keys": count_of(text, r'"(?:[^"\\]|\\.)*"\s*:'), "canonical_sha256": canonical_json_sha256(text)}


def json_syntax_class(text: Column) -> Column:
    """What kind of JSON, or near-JSON, a whole value is."""
    t = F.trim(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    parses = whole_json(t).isNotNull()
    return (
        F.when(parses & t.startswith("{"), "strict_json_object")
        .when(parses & t.startswith("["), "strict_json_array")
        .when((F.size(lines) > 1) & F.forall(lines, lambda x: whole_json(x).isNotNull()), "ndjson")
        .when(t.rlike(r"^(?:\{[^{}]*\}\s*){2,}$"), "concatenated_json")
        .when(t.rlike(r"\$\{|\{\{|\{%"), "template_like")
        .when(t.rlike(r"//|/\*|,\s*[}\]]"), "jsonc_like")
        .when(t.rlike(r"[{,]\s*[A-Za-z_$][A-Za-z0-9_$]*\s*:|'[^'\r\n]*'\s*[,}:\]]"), "javascript_object_like")
        .when(balanced(t), "invalid_balanced")
        .otherwise("invalid_unbalanced")
    )


# --- predicates -----------------------------------------------------------------------------


def requires_exact_output(text: Column) -> Column:
    return any_of(text, P.EXACT_OUTPUT)


def verbatim_context(text: Column) -> Column:
    return any_of(text, P.VERBATIM_JSON) | matches(F.lower(text), r"\b(?:schema|template|fixture)\s*:") | (any_of(text, P.VERBATIM_EXACT) & any_of(text, P.VERBATIM_TARGET))


def html_exact_context(text: Column) -> Column:
    """A line of the last 300 characters asks for HTML to stay as it is."""
    tail = F.substring(text, -300, 300)
    return F.exists(F.split(tail, "\n"), lambda x: (matches(x, P.HTML_EXACT) & matches(x, P.HTML_TARGET)) | matches(x, P.HTML_PRESERVE))


def is_critical_clause(clause: Column) -> Column:
    action = matches(clause, P.CLAUSE_ACTION)
    return (action & matches(clause, P.CLAUSE_POLICY)) | matches(clause, P.CLAUSE_FORMAT) | (action & matches(clause, P.CLAUSE_VALUE))


def may_hold(text: Column, kind: str) -> Column:
    """Whether a text holds what each match of the kind does; looking for that is cheaper than matching."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in P.NEEDED.get(kind, ())] or [text.isNotNull()])


def has_protected_span(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [may_hold(text, k) & text.rlike(p) for k, p in P.JAVA_SPANS.items()])


def has_critical_clause(text: Column) -> Column:
    """What a clause holds stands in the text too, with the same edges, so most texts are never cut into clauses."""
    return is_critical_clause(text) & F.exists(F.split(text, r"(?<=[.!?])|\n"), is_critical_clause)


def boilerplate_reasons(phrase: Column) -> Column:
    """Why a phrase may not be treated as boilerplate; empty if it may."""
    return F.filter(
        F.array(
            F.when(has_protected_span(phrase) | has_critical_clause(phrase), "contains_protected_span_or_clause"),
            F.when(matches(phrase, P.INSTRUCTION) | matches(phrase, P.IMPERATIVE), "instruction_or_policy_bearing"),
            F.when(phrase.contains("?"), "contains_question"),
            F.when(matches(phrase, P.TASK_FIELD), "task_specific_field"),
        ),
        lambda x: x.isNotNull(),
    )


def safe_boilerplate(phrase: Column) -> Column:
    return F.size(boilerplate_reasons(phrase)) == 0


def has_tool_exchange(json: Column) -> Column:
    markers, types = "|".join(P.TOOL_MARKERS), "|".join(P.TOOL_TYPES)
    return json.rlike(rf'(?i)"role"\s*:\s*"(?:tool|function)"') | json.rlike(rf'"(?:{markers})"\s*:') | json.rlike(rf'"type"\s*:\s*"(?:{types})"')


def collapsible_line(line: Column) -> Column:
    """Prose whose inner runs of blanks carry no layout."""
    layout = reduce(lambda a, b: a | b, [line.rlike(p) for p in (P.ORDERED_LIST, P.UNORDERED_LIST, P.TABLE_RULE, P.YAML_LIKE, r"^[ \t>]")])
    aligned = (count_of(line, r"\S {3,}(?=\S)") >= 2) & ~line.rlike(r"[.!?]")
    return (F.trim(line) != "") & ~line.contains("|") & ~layout & ~aligned


def is_candidate(text: Column, rate: Column | float = 0.5, count: TokenCounter = token_count) -> Column:
    return (F.length(F.trim(text)) >= P.MIN_SEGMENT_CHARS) & (count(text) >= P.MIN_SEGMENT_TOKENS) & (F.lit(rate) < 1)


# --- decisions ------------------------------------------------------------------------------


def expected_reduction(tokens: Column, segments: Column, deterministic: Column, protected: Column, identifier: Column, structured: Column, idle: float | None = 0.0) -> Column:
    """The share a model may cut: ``idle`` of a text without tokens or, where that is None, what the same steps give."""
    cut = lambda test: F.when(test, 0.02).otherwise(0.0)
    average = F.when(segments > 0, tokens / segments)
    base = F.when(structured < 0.10, 0.08).otherwise(0.05)
    found = F.greatest(F.lit(0.0), base - cut(protected > 0.10) - cut(identifier > 0.10) - cut(average < 120) - cut(deterministic >= 0.10))
    return found if idle is None else F.when(tokens <= 0, idle).otherwise(found)


def projected_chunks(chars: Column) -> Column:
    return F.when(chars <= 0, 0).otherwise(F.ceil(chars / P.CHUNK_CHARS)).cast("long")


def projected_cost(chars: Column, fixed: Column, per_chunk: Column, tokens: Column, idle: float | None = 0.0) -> Column:
    """Null where a baseline is missing; ``idle`` for no chunks or, where that is None, what is paid without any."""
    n = projected_chunks(chars)
    found = fixed + n * per_chunk + tokens
    return found if idle is None else F.when(n == 0, idle).otherwise(found)


def compression_path(before: Column, after: Column, model_ran: Column) -> Column:
    return F.when(model_ran, "deterministic_plus_model").when(before == after, "unchanged").otherwise("deterministic_only")


#: Kinds of spans whose characters make a text dense with what must not change.
DENSE_KINDS = ("email", "number", "identifier", "constant", "money", "url")


def _matches_of(text: Column, kind: str) -> Column:
    """All matches of a kind, which a text that lacks what they need is not searched for.

    Those of an address about a text's only @ lie in the characters around it that may belong to one.
    """
    word = r"\p{L}\p{N}_"
    where = F.when(may_hold(text, kind), text)
    if kind == "email":
        one = F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit(""))) == 1
        front = F.regexp_extract(F.reverse(F.substring_index(text, "@", 1)), f"^[{word}.+-]*", 0)
        around = F.concat(F.reverse(front), F.lit("@"), F.regexp_extract(F.substring_index(text, "@", -1), f"^[{word}.-]*", 0))
        where = F.when(one, around).when(may_hold(text, kind), text)
    return F.regexp_extract_all(where.otherwise("") if kind in P.NEEDED else text, F.lit(P.JAVA_SPANS[kind]), F.lit(0))


def route_features(text: Column, compacted: Column, count: TokenCounter = batch_token_count, kinds: Iterable[str] = DENSE_KINDS, plain: bool = False) -> dict[str, Column]:
    """What ``route``, ``expected_reduction`` and ``projected_cost`` ask of a text, read from it.

    ``compacted`` is the text after the cheap rewrites: its tokens are what is left to a model.
    Densities are shares of characters (a character of two kinds counts for both) and shares of
    lines (headings, bullets, JSON). A null text has no tokens and no density, and a share of nothing is 0;
    ``plain`` leaves them as they are divided: all of a null text is null, and a share of nothing not a number.

    Each pattern is matched once a text, as generated code shares equal expressions that are always
    worked out, and only where the text holds what a match needs.
    """
    found = {k: _matches_of(text, k) for k in kinds}
    chars = {k: F.length(F.array_join(m, "")) for k, m in found.items()}
    part = lambda n, of: F.coalesce(n / F.nullif(of, F.lit(0)), F.when(of == 0, float("nan")) if plain else F.lit(0.0))
    known = lambda c, other: c if plain else F.coalesce(c, F.lit(other))
    total, lines = F.length(text), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    marks = structural_features(text)
    needed = {"headings": ["#"], "bullets": [m + s for m in "-*+" for s in " \t"], "json_like_lines": list('"{[')}
    holds = lambda these: reduce(lambda a, b: a | b, [text.contains(x) for x in these])
    marked = reduce(lambda a, b: a + b, [F.when(holds(these), marks[k]).otherwise(F.lit(0)) for k, these in needed.items()])
    blank = F.when(holds([f"\n{x}" for x in "\n \t\r"]), count_of(text, r"\n[ \t\r]*\n")).when(text.isNotNull(), F.lit(0))
    before, after = (known(count(t), 0) for t in (text, compacted))
    return {
        "tokens": after.cast("long"),
        "exact": known(requires_exact_output(text), False),
        "deterministic": part(F.greatest(F.lit(0), before - after), before),
        "protected": part(reduce(lambda a, b: a + b, chars.values()), total),
        "identifier": part(chars["identifier"], total) if "identifier" in chars else F.lit(0.0),
        "structured": part(marked, lines),
        "placeholders": known(reduce(lambda a, b: a + b, (F.size(m) for m in found.values())), 0).cast("long"),
        "segments": known(blank + 1, 0).cast("long"),
    }


#: ``prose`` is the number of tokens that is no prose at all, below 0 if there is none such.
ROUTE_LIMITS = {"prose": 0, "tokens": 20000, "deterministic": 0.12, "protected": 0.20, "structured": 0.35, "placeholders": 400, "cost": 60000.0, "saving": 2000, "reduction": 0.05}


def route(mode: Column, rate: Column, tokens: Column, exact: Column, deterministic: Column, protected: Column, structured: Column, placeholders: Column, cost: Column, expected: Column, limits: dict | None = None) -> Column:
    """The first reason to leave the model out, or ``run``; ``force`` ignores what is only likely."""
    x = ROUTE_LIMITS | (limits or {})
    auto = mode == "model_auto"
    ladder = [
        (mode == "deterministic", "skipped_mode_deterministic"),
        (rate >= 1, "skipped_aggressiveness_zero"),
        (tokens <= x["prose"], "skipped_no_candidate_prose"),
        (exact, "skipped_exact_output_context"),
        (auto & (tokens < x["tokens"]), "skipped_low_candidate_tokens"),
        (auto & (deterministic >= x["deterministic"]), "skipped_deterministic_savings_sufficient"),
        (mode == "model_force", "run"),
        (protected > x["protected"], "skipped_high_protected_density"),
        (structured > x["structured"], "skipped_high_structured_density"),
        (placeholders > x["placeholders"], "skipped_high_placeholder_count"),
        (cost.isNull(), "skipped_missing_latency_baseline"),
        (cost > x["cost"], "skipped_high_projected_latency"),
        ((F.floor(tokens * expected) < x["saving"]) | (expected < x["reduction"]), "skipped_low_expected_incremental_savings"),
    ]
    return F.coalesce(*[F.when(test, reason) for test, reason in ladder], F.lit("run"))

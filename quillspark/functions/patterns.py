"""Patterns, phrases and thresholds whose exact form decides results.

Patterns are written with ``\\b`` and ``\\w`` in their Unicode sense; ``java`` turns them into
what Spark's engine needs, whatever the Java version.
"""

from __future__ import annotations

import re

SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{SPACE_CLASS}]"
WORD = r"[A-Za-z0-9_]+(?:['’.-][A-Za-z0-9_]+)*"

# Protected literals, in order of precedence at equal start and length.
SPANS = {
    "code_fence": r"(?s)(?<fence>`{3,}|~{3,})[^\n]*\n.*?(?:\n\k<fence>[ \t]*(?:\n|$)|$)",
    "markdown_link": r"!?\[[^\]\r\n]+\]\([^\s)\r\n]+\)",
    "citation": r"(?i)\[citation:[^\]\r\n]+\]",
    "template": r"\{\{[-~]?\s*[^{}\r\n]+?\s*[-~]?\}\}|\{%[-~]?\s*[^%\r\n]+?\s*[-~]?%\}|\$\{[^}\r\n]+\}|\{[A-Za-z_][A-Za-z0-9_.-]*\}",
    "url": r"(?i)https?://[^\s<>\"']+",
    "email": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "inline_code": r"`[^`]+`",
    "money": r"\$\s?\d+(?:[.,]\d+)*",
    "constraint": r"(?i)\b(?:do\s+not|don't|never|must\s+not|cannot|can't)\s+(?:delete|remove|alter|change|increase|decrease|modify|recommend)\b",
    "identifier": r"\b[A-Z][A-Z0-9_]*(?:[-_][A-Z0-9]+)+\b",
    "number": r"(?i)\b\d+(?:[.,:/-]\d+)*(?:%|ms|s|sec|seconds|m|min|hours|gb|mb|kb|usd|dollars)?\b",
    "constant": r"\b[A-Z][A-Z0-9_]{2,}\b",
}
#: One of these stands in each match of the kind.
NEEDED = {
    "code_fence": ("```", "~~~"), "markdown_link": ("](",), "citation": ("[",), "template": ("{",), "url": ("://",), "email": ("@",), "inline_code": ("`",), "money": ("$",),
}
IDENTIFIER_KINDS = ("constant", "email", "identifier", "money", "number", "url")

CLAUSE_ACTION = r"(?i)\b(?:add|alter|approve|change|create|delete|deliver|emit|exceed|include|increase|keep|modify|output|preserve|provide|raise|receive|remove|respond|return|send|set|use|write)(?:s|d|ing)?\b"
CLAUSE_POLICY = r"(?i)\b(?:do\s+not|don't|never|without|must(?:\s+not)?|shall(?:\s+not)?|should(?:\s+not)?|may(?:\s+not)?|can(?:not|'t)?|required|permitted|only\s+if|unless|except|scope|within)\b"
CLAUSE_FORMAT = r"(?i)\b(?:required|exact|specified)\s+(?:output\s+)?(?:format|ordering|order|schema)\b"
CLAUSE_VALUE = r"(?i)\b(?:at|above|below|under|over|equals?|exceeds?|within|before|after)\b.*(?:\d|https?://|\b[A-Z][A-Z0-9_]*(?:[-_][A-Z0-9]+)+\b)"

INSTRUCTION = r"(?i)\b(?:must|shall|should|may|can|cannot|can't|do\s+not|don't|never|unless|except|only|all|any|each|every|delete|remove|keep|return|output|respond|deadline|owner)\b"
IMPERATIVE = r"(?i)^(?:add|change|check|create|delete|do|ensure|include|keep|provide|remove|return|review|send|use|write)\b"
TASK_FIELD = r"(?i)\b(?:account|case|customer|incident|order|request|task|tenant|ticket)[-_ ]?(?:id|number)?\b"
UNSAFE_WRAPPER = r"(?i)\b(?:do\s+not|don't|never|must|shall|should|may|cannot|can't|unless|except|only\s+if|required|delete|remove|change|keep|return|output)\b"

SAFETY = {
    "negation": r"(?i)\b(?:no|not|never|without|unless|except|cannot|can't|don't)\b",
    "obligation": r"(?i)\b(?:must|shall|required|require|mandatory|should)\b",
    "scope": r"(?i)\b(?:only|all|any|each|every|always)\b",
    "permission": r"(?i)\b(?:may|might|can|could|allowed|prohibited)\b",
    "destructive_action": r"(?i)\b(?:delete|remove|drop|overwrite|reset|alter|change)\b",
}
SAFETY_TERMS = {
    "negation": ("no", "not", "never", "without", "unless", "except", "cannot", "can't"),
    "obligation": ("must", "shall", "required", "require", "mandatory"),
    "scope": ("only", "all", "any", "each", "every", "always"),
    "permission": ("may", "might", "can", "could", "allowed", "prohibited"),
    "destructive_action": ("delete", "remove", "drop", "overwrite", "reset"),
}

EXACT_OUTPUT = (
    "byte-stable", "byte stable", "byte-exact", "byte exact", "return exactly as written", "return exactly as provided", "return the input exactly",
    "output the input exactly", "preserve formatting exactly", "preserve whitespace exactly", "verbatim output", "do not modify the text", "do not change the text",
)
VERBATIM_JSON = (
    "exact json", "exactly this json", "valid json", "json syntax", "json schema", "return json", "respond with json", "output json", "must be json",
    "json template", "template json", "json fixture", "fixture json", "json example", "example json",
)
VERBATIM_EXACT = ("verbatim", "unchanged", "preserve", "do not change", "don't change", "return exactly")
VERBATIM_TARGET = ("json", "schema", "template", "fixture")
HTML_EXACT = r"(?i)\b(audit|debug|exact|review|source|verbatim)\b"
HTML_TARGET = r"(?i)\b(accessibility|css|dom|html|markup|render|selector)\b"
HTML_PRESERVE = r"(?i)\bpreserve(?:\s+\w+){0,3}\s+(?:accessibility|css|dom|html|markup|render|selector)\b"
TOOL_MARKERS = ("functionCall", "functionResponse", "function_call", "tool_call", "tool_call_id", "tool_calls", "tool_result", "tool_use", "tool_use_id")
TOOL_TYPES = ("function", "function_call", "function_call_output", "tool_call", "tool_result", "tool_use")

TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
ORDERED_LIST = r"^\s*\d+[.)]\s+"
UNORDERED_LIST = r"^\s*[-+*]\s+"
YAML_LIKE = r"^\s*[A-Za-z0-9_.-]+\s*:\s+\S"

MIN_SEGMENT_CHARS, MIN_SEGMENT_TOKENS = 160, 24
CHUNK_CHARS = 24000
DUPLICATE_BLOCK_TOKENS = 32
RATE_LIMITS = {"compress": 30, "messages": 20, "estimate": 120, "health": 120}
TIERS = {"blocked": 0.0, "strict": 0.5, "default": 1.0, "trusted": 4.0}
PERIOD_SECONDS = 60

_START = r"(?<![\p{L}\p{N}_])"
_EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


#: What may follow a word boundary in our patterns, where looking back is enough: a digit, a capital or one of some words.
_FIRST = re.compile(r"\\d|\[A-Z\]|\(\?:((?:[A-Za-z][^()|]*(?:\([^()]*\)[^()|]*)*\|?)+)\)(?![?*{])")


def _begins(rest: str) -> str | None:
    """A test for the first character of what follows a word boundary; None if that may be no word character.

    It stands in front of looking back, which costs much more at every place of a text.
    """
    m = _FIRST.match(rest)
    if m is None:
        return None
    if m[1] is None:
        return f"(?={m[0]})"
    words = re.sub(r"\([^()]*\)", "", m[1]).split("|")
    if r"\(" in m[1] or r"\)" in m[1] or any(w[1:2] in ("?", "*", "{") for w in words):
        return None
    return "(?=[" + "".join(sorted({w[0] for w in words if w})) + "])"


def java(pattern: str) -> str:
    """The pattern with Unicode word boundaries and word characters spelt out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            # Before what can only be a word character, looking back is enough.
            first = _begins(pattern[i + 2 :])
            starts = first or pattern.startswith("(?:", i + 2) and pattern[i + 5 : i + 6].isalpha()
            out.append((first or "") + (_START if starts else _EDGE))
            i += 2
        elif two == r"\w":
            out.append(r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


JAVA_SPANS = {k: java(p) for k, p in SPANS.items()}
# What stands before the @ can hold none, so giving letters back never helps.
JAVA_SPANS["email"] = JAVA_SPANS["email"].replace("]+@", "]++@", 1)

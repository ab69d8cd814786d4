"""Bracketed regions of a text, told apart in one pass: JSON, what merely looks like it, templates.

Every opening bracket outside a region of sound JSON begins a region. Strings and brackets are
followed by one stack; each open bracket carries the state of a small JSON grammar, so that
balance and soundness of all nested regions are known when their brackets close. A bracket inside
a string of a region that closes is part of that string. Where a region never closes, as after a stray
bracket in prose, its strings may be none: brackets in them are read a second time, and
only a second time, so that work stays linear.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left

# Syntax that decides the class of a region, and terms of a section that flag it.
TOKEN = re.compile(r"""[ \t\r\n]+|"(?:[^"\\]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.+-])|(?:true|false|null|NaN|-?Infinity)\b|[\[\]{}:,]|[^\[\]{}:,"\s]+|.""", re.ASCII | re.DOTALL)
SOUND_STRING = re.compile(r"""(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*""")
SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
LOOSE = {
    "jsonc_like": (re.compile(r"(?=(//|/\*))"), re.compile(r"(?=(,\s*[}\]]))")),
    "javascript_object_like": (re.compile(r"(?=([{,]\s*[A-Za-z_$][\w$]*\s*:))"), re.compile(r"(?=('[^'\r\n]*'\s*[,}:\]]))")),
}
HEADING = re.compile(r"(?m)^#{1,6}\s+")
FLAGS = {"schema": ("schema",), "fixture": ("fixture",), "example": ("example",), "template": ("template",), "tool_protocol": ("tool call", "tool result", "function call", "protocol")}
EXACT, STRUCTURED = ("exact", "verbatim", "unchanged", "do not change"), ("json", "schema", "template", "fixture", "output format")
AFTER = ",.;:!?)]}{["
STRICT = ("strict_json_object", "strict_json_array")
BLOCKING = {"ambiguous_parent", "exact_output", "example", "fixture", "schema", "template", "tool_protocol"}

# States of an open bracket: what the grammar wants next.
FIRST, COLON, VALUE, COMMA, KEY = range(5)
OPENS = {"{": "}", "[": "]"}


class _Open:
    __slots__ = ("at", "close", "state", "sound", "keys", "twice")

    def __init__(self, at: int, bracket: str) -> None:
        self.at, self.close, self.state, self.sound = at, OPENS[bracket], FIRST, True
        self.keys: set[str] = set()
        self.twice: set[str] = set()

    def value(self) -> None:
        """A value that is no key: sound where the grammar wants one."""
        self.sound = self.sound and (self.state == VALUE or self.state == FIRST and self.close == "]")
        self.state = COMMA

    def string(self, body: str) -> None:
        if not SOUND_STRING.fullmatch(body):
            self.sound = False
        if self.close == "}" and self.state in (FIRST, KEY):
            self.state = COLON
            if self.sound:
                key = json.loads(f'"{body}"') if "\\" in body else body
                if key in self.keys:
                    self.twice.add(key)
                self.keys.add(key)
        else:
            self.value()

    def mark(self, token: str) -> None:
        if token == ":" and self.state == COLON:
            self.state = VALUE
        elif token == "," and self.state == COMMA:
            self.state = KEY if self.close == "}" else VALUE
        else:
            self.sound = False


def _follow(text: str, start: int, found: dict[int, tuple]) -> list[tuple[int, int, int]]:
    """Adds (end, sound, keys that occur twice) for the bracket at start and those it holds; end None if it never closes.

    Returns strings, as start, end and the bracket that they stand in.
    """
    stack: list[_Open] = []
    strings: list[tuple[int, int, int]] = []
    at = start
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            break
        token, here, at = m[0], at, m.end()
        first = token[0]
        if first in "[{":
            if here in found:  # an earlier pass has been here, in the same state
                end, sound, twice = found[here]
                if end is None:
                    break
                at = end
                _close(stack, sound, twice)
            else:
                stack.append(_Open(here, first))
        elif first in "]}":
            if stack[-1].close != first:
                stack[-1].sound = False
                continue
            top = stack.pop()
            sound = top.sound and top.state in (FIRST, COMMA)
            found[top.at] = at, sound, top.twice
            if not stack:
                return strings
            _close(stack, sound, top.twice)
        elif first == '"':
            if len(token) == 1:
                break  # a string without an end: nothing open closes
            stack[-1].string(token[1:-1])
            strings.append((here, at, stack[-1].at))
        elif first in ":,":
            stack[-1].mark(token)
        elif not first.isspace():
            if SCALAR.fullmatch(token):
                stack[-1].value()
            else:
                stack[-1].sound = False
        elif first not in " \t\r\n":
            stack[-1].sound = False
    for x in stack:
        found[x.at] = None, False, set()
    return strings


def _close(stack: list[_Open], sound: bool, twice: set[str]) -> None:
    top = stack[-1]
    top.value()
    top.sound = top.sound and sound
    if len(twice) > len(top.twice):
        top.twice, twice = twice, top.twice
    top.twice |= twice


class _Places:
    """Where a pattern's matches begin and end; asks whether one lies inside a range."""

    def __init__(self, text: str, *patterns: re.Pattern) -> None:
        found = [[(m.start(1), m.end(1)) for m in p.finditer(text)] for p in patterns]
        self.found = [([a for a, _ in x], [b for _, b in x]) for x in found if x]

    def inside(self, low: int, high: int) -> bool:
        """The ends of one pattern's matches grow with their starts, so the first that begins inside tells."""
        for starts, ends in self.found:
            i = bisect_left(starts, low)
            if i < len(starts) and ends[i] <= high:
                return True
        return False


def _terms(text: str, terms: tuple[str, ...]) -> _Places:
    return _Places(text, *[re.compile(f"(?=({t}))", re.IGNORECASE | re.ASCII) for t in terms])


class _Context:
    """Flags of the section that a place stands in: terms between its last heading and the place."""

    def __init__(self, text: str) -> None:
        spots = [(m.start(), m.end()) for m in HEADING.finditer(text)]
        self.heads, self.ends = [a for a, _ in spots], [b for _, b in spots]
        self.terms = {k: _terms(text, v) for k, v in FLAGS.items()}
        self.exact, self.structured = _terms(text, EXACT), _terms(text, STRUCTURED)

    def flags(self, at: int) -> set[str]:
        i = bisect_left(self.ends, at + 1) - 1
        low = self.heads[i] if i >= 0 else 0
        found = {k for k, places in self.terms.items() if places.inside(low, at)}
        return found | ({"exact_output"} if self.exact.inside(low, at) and self.structured.inside(low, at) else set())


def _plausible(text: str, at: int) -> bool:
    i = at + 1
    while i < len(text) and text[i].isspace():
        i += 1
    after = text[i : i + 1]
    if text[at] == "{":
        return after in ('"', "}")
    return bool(after) and (after in '{["]-' or after.isdigit() or text.startswith(("true", "false", "null"), i))


def regions(text: str) -> list[dict]:
    """start, end, syntax, duplicate_keys, ambiguous, flags of each region, in order of start."""
    starts = [m.start() for m in re.finditer(r"[\[{]", text)]
    if not starts:
        return []
    balanced: dict[int, tuple] = {}
    loose = {k: _Places(text, *v) for k, v in LOOSE.items()}
    closes, rounds = [m.start() for m in re.finditer("]", text)], [m.start() for m in re.finditer(r"\)", text)]
    context, out, free, reach = _Context(text), [], 0, 0
    hidden: set[int] = set()
    again: set[int] = set()

    def add(start: int, end: int, syntax: str, flags: set[str], keys: list[str] | None = None) -> None:
        out.append({"start": start, "end": end, "syntax": syntax, "duplicate_keys": keys or [], "ambiguous": "ambiguous_parent" in flags, "flags": sorted(flags)})

    for at in starts:
        if at < free or at in hidden and at not in balanced:
            continue
        if at not in balanced:
            for a, b, bracket in _follow(text, at, balanced):
                inner = starts[bisect_left(starts, a) : bisect_left(starts, b)]
                (hidden if at in again or balanced[bracket][0] else again).update(inner)
        end, sound, twice = balanced[at]
        template = text[max(0, at - 1) : at + 1] == "${" or text.startswith(("{{", "{%"), at)
        i = bisect_left(closes, at)
        link = text[at] == "[" and i < len(closes) and text[closes[i] + 1 : closes[i] + 2] == "("
        if template or link:
            if not template:
                j = bisect_left(rounds, closes[i] + 2)
                end = rounds[j] + 1 if j < len(rounds) else len(text)
            add(at, end or at + 1, "template_or_bracket_syntax", {"template"})
            continue
        kind = next((k for k, places in loose.items() if end and places.inside(at, end)), None)
        if not _plausible(text, at):
            if end and end > at + 1:
                reach = max(reach, end)
            add(at, end or at + 1, kind or "template_or_bracket_syntax", set())
        elif not sound:
            reach = max(reach, end or 0)
            add(at, end or len(text), (kind or "invalid_balanced") if end else "invalid_unbalanced", context.flags(at))
        elif end < len(text) and not text[end].isspace() and text[end] not in AFTER:
            add(at, end, "invalid_balanced", context.flags(at))
        else:
            flags = context.flags(at) | ({"ambiguous_parent"} if at < reach else set())
            add(at, end, STRICT[text[at] == "["], flags, sorted(twice))
            free = end
    strict = [r for r in out if r["syntax"] in STRICT]
    for a, b in zip(strict, strict[1:]):
        if not (between := text[a["end"] : b["start"]]).strip():
            a["syntax"] = b["syntax"] = "ndjson" if "\n" in between else "concatenated_json"
    return out

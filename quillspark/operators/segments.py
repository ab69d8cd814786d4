"""Prompts cut into nested regions, and into chunks under two budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import patterns as P
from quillspark.functions.brackets import BLOCKING, regions
from quillspark.operators.generators import SOUND

# What opens and closes a region of a prompt.
WRAPPED = re.compile(r"(?i)<(nocompress)>")
PANEL = re.compile(r"(?m)^\[(UI|FOLLOW_ON_QUESTIONS|SWITCH_PANEL_AGENT)\]\s*\n")
SECTIONS = (
    re.compile(r"(?ms)^# (?:UI RENDERING CONTRACT|CONTENT FORMATS|USER-FACING VOCABULARY|ALLOWED UI COMPONENTS)\b.*?(?=^# (?:OPERATING MODE|DATA TO PROCESS|FAILURE MODES|OPTIONAL FOLLOW-ON CONTENT|CHIP-|RULE PRECEDENCE|FINAL RULES)\b|\Z)"),
    re.compile(r"(?ms)^# FAILURE MODES\b.*?(?:^---\s*$(?:\n|$)|(?=^# (?:OPTIONAL FOLLOW-ON CONTENT|CHIP-|RULE PRECEDENCE|FINAL RULES)\b|\Z))"),
    re.compile(r"(?ms)^# OPTIONAL FOLLOW-ON CONTENT\b.*?(?=^# (?:RULE PRECEDENCE|FINAL RULES)\b|\Z)"),
    re.compile(r"(?ms)^# DATA TO PROCESS\b.*?(?=^---\s*$|\Z)"),
)
RUN = re.compile(r"`{3,}|~{3,}")
MARKUP = re.compile(r"(?i)<(html|head|body|pre|code|script|style|template|svg)\b[^>]*>")
DOCTYPE = re.compile(r"(?i)<!doctype\s+html\b[^>]*>\s*$")


def _blocks(text: str, opening: re.Pattern, closing) -> Iterator[tuple[int, int, re.Match]]:
    """Regions from an opening to its closing; a name whose closing is missing once is not looked for again."""
    at, missing = 0, set()
    while m := opening.search(text, at):
        name = m[1].lower()
        end = None if name in missing else closing(m[1]).search(text, m.end())
        if end is None:
            missing.add(name)
            at = m.end()
        else:
            yield m.start(), end.end(), m
            at = end.end()


def _wrapped(text: str) -> list[tuple[int, int, str, bool]]:
    if "<" not in text:
        return []
    return [(a, b, "nocompress", False) for a, b, _ in _blocks(text, WRAPPED, lambda _: re.compile(r"(?i)</nocompress>"))]


def _contract(text: str) -> list[tuple[int, int, str, bool]]:
    """Panels and contract sections; those that overlap or touch are one region."""
    if "[" not in text and "#" not in text:
        return []
    found = [(a, b) for a, b, _ in _blocks(text, PANEL, lambda name: re.compile(rf"(?m)^\[/{name}\][ \t]*(?:\n|$)"))]
    found += [m.span() for p in SECTIONS for m in p.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b, "verbatim", False) for a, b in merged]


def _sound(body: str) -> bool:
    found = regions(body.strip())
    return bool(found) and found[0]["syntax"] in SOUND and found[0]["start"] == 0 and found[0]["end"] == len(body.strip())


def _fences(text: str) -> list[tuple[int, int, str, bool]]:
    """From a run of marks, with what follows on its line, to the next run that can close it.

    A fence is as long as its run, or as the longest of the same mark that comes behind the line if
    that is shorter; the first one so long closes it. Runs are listed once, so the walk is linear.
    """
    runs = [m.span() for m in RUN.finditer(text)]
    longest = {"`": [0] * (len(runs) + 1), "~": [0] * (len(runs) + 1)}
    for i in range(len(runs) - 1, -1, -1):
        for mark, most in longest.items():
            most[i] = max(most[i + 1], runs[i][1] - runs[i][0] if text[runs[i][0]] == mark else 0)
    out, at = [], 0
    for i, (a, b) in enumerate(runs):
        line = text.find("\n", b) if a >= at else -1
        if line < 0:
            continue
        mark, later = text[a], i + 1
        while later < len(runs) and runs[later][0] < line:
            later += 1
        size = min(b - a, longest[mark][later])
        if size < 3:
            continue
        while text[runs[later][0]] != mark or runs[later][1] - runs[later][0] < size:
            later += 1
        close = runs[later][0]
        info, body = text[a + size : line], text[line + 1 : close]
        tail = re.compile(r"[ \t]*(?:\n|\Z)").match(text, close + size) if body.endswith("\n") else None
        at = tail.end() if tail else close + size
        is_json = info.split(maxsplit=1)[:1] and info.split(maxsplit=1)[0].lower() == "json" and _sound(body)
        out.append((a, at, "json" if is_json else "code", False))
    return out


def _values(text: str) -> list[tuple[int, int, str, bool]]:
    """Sound JSON outside brackets that hold none; may be rewritten where keys are single and nothing in front forbids it."""
    out, free = [], 0
    for r in regions(text):
        if r["start"] >= free and r["syntax"] in SOUND and not r["ambiguous"]:
            out.append((r["start"], r["end"], "json", r["syntax"].startswith("strict") and not r["duplicate_keys"] and not BLOCKING & set(r["flags"])))
            free = r["end"]
    return out


def _markup(text: str) -> list[tuple[int, int, str, bool]]:
    out, free = [], 0
    for a, b, m in _blocks(text, MARKUP, lambda tag: re.compile(rf"(?i)</{tag}\s*>")) if "<" in text else ():
        front = DOCTYPE.search(text, free, a) if m[1].lower() == "html" else None
        out.append((front.start() if front else a, b, "html", False))
        free = b
    return out


LEVELS = (_wrapped, _contract, _fences, _values, _markup)


def pieces(text: str) -> list[dict]:
    """start, end, kind, rewritable of pieces that join to the text.

    A stack holds stretches still to be looked at and the level to look for: what a level takes is a
    piece, and the stretches between go on to the next level, each as a text of its own.
    """
    out, stack = [], [(0, len(text), 0)]
    while stack:
        low, high, level = stack.pop()
        if level == len(LEVELS):
            out.append({"start": low, "end": high, "kind": "prose", "rewritable": True})
            continue
        part, at = text[low:high], 0
        for a, b, kind, free in LEVELS[level](part):
            if at < a:
                stack.append((low + at, low + a, level + 1))
            out.append({"start": low + a, "end": low + b, "kind": kind, "rewritable": free})
            at = b
        if low + at < high:
            stack.append((low + at, high, level + 1))
    return sorted(out, key=lambda x: x["start"])


PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("rewritable", T.BooleanType())]))


@F.arrow_udf(PIECES)
def _pieces(text: pa.Array) -> pa.Array:
    return pa.array([pieces(t) if t else [] for t in text.to_pylist()], to_arrow_type(PIECES))


def explode_nested_segments(df: DataFrame, text: str) -> DataFrame:
    """pos, start, end, kind, rewritable, segment: pieces of each text, which joined in order give it back.

    Kinds, each looked for outside those before it: nocompress wrappers; verbatim panels and contract
    sections; code fences (json if so marked and sound); json values in the open; html blocks;
    prose. Only prose and some json may be rewritten. A null or empty text has no pieces.
    """
    rows = df.withColumn("__pieces", _pieces(F.col(text))).select("*", F.posexplode_outer("__pieces").alias("pos", "__row")).where("__row is not null")
    rows = rows.select(*df.columns, "pos", "__row.*")
    return rows.withColumn("segment", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))


PLACEHOLDERS = 80
PLACEHOLDER = re.compile(r"__CK_KEEP_\d{4,}__")


def _parts(text: str, most: int) -> Iterator[str]:
    """Stretches of at most so many characters, cut behind the last line feed or space that is not their first."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (gap := max(text.rfind("\n", at + 1, end), text.rfind(" ", at + 1, end))) > at:
            end = gap + 1
        yield text[at:end]
        at = end


def packed(text: str, most: int, placeholders: int) -> list[tuple[str, int]]:
    """Chunks and their placeholders: filled greedily until either budget would be passed."""
    out, chunk, size, kept, at = [], [], 0, 0, 0

    def units() -> Iterator[tuple[str, int]]:
        nonlocal at
        for m in PLACEHOLDER.finditer(text):
            yield from ((x, 0) for x in _parts(text[at : m.start()], most))
            yield m[0], 1
            at = m.end()
        yield from ((x, 0) for x in _parts(text[at:], most))

    for unit, n in units():
        if chunk and (kept + n > placeholders or size + len(unit) > most):
            out.append(("".join(chunk), kept))
            chunk, size, kept = [], 0, 0
        chunk.append(unit)
        size += len(unit)
        kept += n
    return [*out, ("".join(chunk), kept)] if chunk else out


CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk", T.StringType()), T.StructField("placeholders", T.IntegerType())]))


def chunk_masked(df: DataFrame, text: str, max_chars: int = P.CHUNK_CHARS, max_placeholders: int = PLACEHOLDERS) -> DataFrame:
    """pos, chunk, placeholders: a masked text in pieces within both budgets; joined in order they are the text.

    Placeholders are never cut, so ``max_chars`` has to hold one; ``max_placeholders`` is 1 at least.
    """
    if max_placeholders < 1 or max_chars < len("__CK_KEEP_0000__"):
        raise ValueError("a chunk has to hold one placeholder")

    @F.arrow_udf(CHUNKS)
    def chunks(column: pa.Array) -> pa.Array:
        rows = [[{"chunk": c, "placeholders": n} for c, n in packed(t or "", max_chars, max_placeholders)] for t in column.to_pylist()]
        return pa.array(rows, to_arrow_type(CHUNKS))

    found = df.withColumn("__chunks", chunks(F.col(text))).select("*", F.posexplode_outer("__chunks").alias("pos", "__row")).where("__row is not null")
    return found.select(*df.columns, "pos", "__row.*")

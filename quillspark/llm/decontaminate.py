"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ in ``floor(rate * n)`` edits. Cut into one piece more
than that, at least one piece of a leaked item is untouched, so exact piece hits (one
Aho-Corasick scan of each text) find every leak. Around a hit, Myers' bit-parallel algorithm
gives the smallest edit distance of the whole item to any stretch of the text. Short items
must begin and end at word boundaries, as they would else be found inside of words.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 20
PORTION_CHARS = 1 << 25
SPACE = re.compile(r"\s+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")  # scripts without spaces between words
HITS = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("budget", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
HITS_DDL = "id long, item_id long, distance long, budget long, start long, end long"


def fold(text: str) -> str:
    """Lower case; white space runs are one space."""
    return " ".join(text.lower().split())


def folded_positions(text: str) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, where it stands in the original."""
    out, at = [], []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(" ")
            at.append(m.start() - 1)
        for i, c in enumerate(m[0], m.start()):
            low = c.lower()
            out.append(low)
            at.extend([i] * len(low))
    return "".join(out), at


def infix_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edits between the pattern and any stretch of the text, and the first end of one."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    pv, mv, score = full, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


def locate(pattern: str, text: str) -> tuple[int, int, int]:
    """Distance, start and end of the nearest stretch: the end forwards, the start backwards."""
    best, end = infix_distance(pattern, text)
    back = infix_distance(pattern[::-1], text[:end][::-1])[1]
    return best, end - back, end


def _word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM" and not UNSPACED.match(c)


def boundary(text: str, at: int) -> bool:
    """No word goes on across this place."""
    return at in (0, len(text)) or not (_word(text[at - 1]) and _word(text[at]))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def locate_words(pattern: str, text: str, starts: list[int], budget: int) -> tuple[int, int, int] | None:
    """Distance, start and end of the nearest stretch of whole words near one of the sorted starts."""
    best, n = None, len(pattern)
    for at in starts:
        for a in range(max(0, at - budget), min(len(text), at + budget + 1)):
            if not boundary(text, a):
                continue
            for b in range(max(a + 1, a + n - budget), min(len(text), a + n + budget) + 1):
                if boundary(text, b) and (d := edits(pattern, text[a:b])) <= budget:
                    best = min(best or (d, a, b), (d, a, b))
        if best and not best[0]:
            break
    return best


def pieces(item: str, rate: float) -> list[tuple[str, int]]:
    k = int(len(item) * rate) + 1
    cuts = [len(item) * j // k for j in range(k + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0) -> None:
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, _) in enumerate(self.items):
            for piece, at in pieces(t, rate):
                found.setdefault(piece, []).append((n, at))
        self.scan = ahocorasick.Automaton()
        for piece, places in found.items():
            self.scan.add_word(piece, (len(piece), places))
        self.scan.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, start, end) of each item near some stretch; the nearest, then first."""
        low = fold(text)
        diagonals: dict[int, list[int]] = {}
        for end, (n, places) in self.scan.iter(low):
            for item, at in places:
                diagonals.setdefault(item, []).append(end + 1 - n - at)
        found, where = [], None
        for item, starts in diagonals.items():
            name, pattern, budget = self.items[item]
            best, lo, hi, starts = None, None, None, sorted(set(starts))
            short = len(pattern) < self.min_chars
            if short:
                best = locate_words(pattern, low, starts, budget)
            for s in [] if short else [*starts, None]:
                if lo is not None and (s is None or s > hi + 2 * budget):
                    a = max(0, lo - budget)
                    d, x, y = locate(pattern, low[a : hi + len(pattern) + budget])
                    if d <= budget and (best is None or d < best[0]):
                        best = (d, a + x, a + y)
                    lo = None
                if lo is None:
                    lo = s
                hi = s
            if best:
                if where is None:
                    where = folded_positions(text)[1]
                found.append((name, best[0], budget, where[best[1]], where[best[2] - 1] + 1))
        return sorted(found)


def _pack(block: list[tuple[int, str]]) -> bytes:
    return zlib.compress(json.dumps(block).encode())


def _unpack(block: bytes) -> list[tuple[int, str]]:
    return [tuple(x) for x in json.loads(zlib.decompress(block))]


def portions(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[list[tuple[int, str]]]:
    """(id, text) pairs in lists that end with the batch (0 chars) or once they hold that many characters."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch["id"].to_pylist(), batch["body"].to_pylist(), strict=True):
            held.append(row)
            size += len(row[1])
            if chars and size >= chars:
                yield held
                held, size = [], 0
        if held and not chars:
            yield held
            held = []
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08, min_chars: int = 16) -> DataFrame:
    """One row for each document and benchmark item found in it: id, item_id, distance, budget,
    start, end (code points of the original text).

    Both sides are compared in lower case with white space runs as one space. Items that are
    null or empty after that match nothing; those shorter than ``min_chars`` match stretches of
    whole words within the same edit budget (0 or 1 edits by default). Null and empty texts have
    no hit. A row without an id is searched like others and reported with a null id. Repeated
    rows give repeated hits; an empty table on either side gives an empty result. Only the
    named columns are read.

    The items are a query set, sent in blocks of about ``BLOCK_CHARS`` characters. Documents are
    scanned once: with several blocks a task holds up to ``PORTION_CHARS`` of text (or one longer
    text) and lets one block's automaton after the other run over it. So a task holds one automaton,
    one portion and the packed blocks, some 0.4 bytes for each character of the benchmark.
    """
    spark = docs.sparkSession
    query = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    total = query.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_CHARS))
    blocks = []
    for b in range(n):
        rows = query.where(F.pmod(F.xxhash64("body"), F.lit(n)) == b).collect()
        block = [(r[0], t) for r in rows if (t := fold(r[1]))]
        if block:
            blocks.append(spark.sparkContext.broadcast(_pack(sorted(block, key=lambda x: (x[0] is None, x)))))
    if not blocks:
        return spark.createDataFrame([], HITS_DDL)
    limit = PORTION_CHARS

    def search(batches):
        only = Matcher(_unpack(blocks[0].value), rate, min_chars) if len(blocks) == 1 else None
        for texts in portions(batches, 0 if only else limit):
            for shared in blocks:
                matcher = only or Matcher(_unpack(shared.value), rate, min_chars)
                rows = [(i, *h) for i, t in texts for h in matcher.hits(t)]
                yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(HITS)], schema=HITS)

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).where("body is not null")
    return source.mapInArrow(search, HITS_DDL)

"""HTML extraction by nearest-URL page differencing.

Pages are ordered by host and URL path; each page's partner is the neighbour of the same host
with the longer common path. The text lines of a page and its partner are aligned by their
longest common subsequence, and shared lines, which come from the site's template, are
deleted; the page's own lines stay, wherever they are. In a declared main region (``article`` or
``main``) one page's word is not enough, as authors repeat and copy lines: there a line goes
only if all neighbours within REACH of the same host share it, AGREE of them at least. Markup
rules then drop what a template fills differently on each page (menus, adverts, footers).
"""

from __future__ import annotations

import html
import re
from collections import deque
from hashlib import blake2b
from math import isqrt
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea|iframe|head|title)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<[!?/]?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
LABELS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHROME = frozenset("nav footer aside form menu dialog button select".split())
CHROME_LABELS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead complementary contentinfo "
    "cookie cookies consent notice notices newsletter subscribe popup modal overlay comment comments disqus share sharing social related recommended widget login signup".split()
)
FILLERS = frozenset("area bar block bottom box buttons container content global group inner item items left links list main outer page right section site slot thread top unit wrap wrapper".split())  # beside such a word
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = frozenset("br td th option wbr".split()) - {"wbr"}
REACH = 2  # neighbours looked at on each side
AGREE = 3  # of them, those that must share a line of a main region
MAIN, PLAIN, FRAME = 2, 1, 0


def labelled(tag: str) -> bool:
    """Whether a class, id or role is made of chrome words alone: ``ad-slot``, not ``related-work``."""
    for found in LABELS.findall(tag):
        for name in "".join(found).lower().split():
            words = {w.rstrip("0123456789") for w in re.split(r"[^a-z0-9]+", name)} - {""}
            if words & CHROME_LABELS and words <= CHROME_LABELS | FILLERS:
                return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order, each with MAIN, PLAIN or FRAME (menus, adverts and the like)."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    main, hidden, depth, at = 0, "", 0, 0

    def role() -> int:
        return FRAME if hidden else MAIN if main else PLAIN

    def close() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, role()))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
        at, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            words.append(html.escape(tag[9:].removesuffix("]]>"), quote=False))
            continue
        if m[1] or not (n := NAME.match(tag)):
            continue
        name, opens = n[1].lower(), tag[1] != "/"
        if name in BLOCKS:
            close()
        elif name in SPACED:
            words.append(" ")
        if hidden:
            if name in ("article", "main") and opens and name != hidden:
                hidden = ""
            elif name == hidden:
                depth += 1 if opens else -1
                if not depth:
                    if words:
                        close()
                    hidden = ""
                continue
            else:
                continue
        if opens:
            if name not in ("html", "body") and not tag.endswith("/>") and (name in CHROME or name == "header" and not main or "=" in tag and labelled(tag)):
                if words:
                    close()
                hidden, depth = name, 1
                continue
        if name in ("article", "main"):
            main = main + 1 if opens else max(0, main - 1)
    if at < len(page):
        words.append(page[at:])
    close()
    return out


def line_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indexes into a of a longest common subsequence with b.

    One number holds a row of the table, a bit for each line of b that is 0 where the length
    grows; len(a) * len(b) / 64 steps whatever repeats. Rows are kept at every ``step``, and those
    between are made again on the way back, so that memory is len(b) * sqrt(len(a)) / 4 bytes.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found, rows, cols = {*range(lo), *range(len(a) - hi, len(a))}, len(a) - hi - lo, len(b) - hi - lo
    at: dict[int, int] = {}
    for j in range(cols):
        at[b[lo + j]] = at.get(b[lo + j], 0) | 1 << j
    full, step = (1 << cols) - 1, isqrt(rows) + 1

    def follow(row: int, start: int, end: int) -> list[int]:
        out = [row]
        for i in range(start, end):
            if here := row & at.get(a[lo + i], 0):
                row = (row + here | row - here) & full
            out.append(row)
        return out

    marks = [full]
    for start in range(0, rows - step, step):
        marks.append(follow(marks[-1], start, start + step)[-1])
    i, j = rows, cols
    while i and j:
        start = (i - 1) // step * step
        table = follow(marks[start // step], start, i)
        while i > start and j:
            if table[i - start] >> j - 1 & 1:
                j -= 1
            elif table[i - 1 - start] >> j - 1 & 1:
                i, j = i - 1, j - 1
                found.add(lo + i)
            else:
                i -= 1
    return found


def template(own: list[int], other: list[int], main: set[int] = frozenset()) -> set[int] | None:
    """Indexes of own lines shared with another page; None if that is empty or a copy.

    A copy has the page's whole text, or the whole of its declared main region (``main``, indexes of
    its lines); what such a page shares tells nothing about a template.
    """
    if not other or own == other:
        return None
    found = shared(own, other)
    return None if main and main <= found else found


def main_text(page: str, partner: list[int] | None, others: list[list[int]] = ()) -> str:
    """The page's main text, given the line hashes of its partner page and of further neighbours."""
    blocks = lines(page)
    own = [line_hash(t) for t, _ in blocks]
    main = {i for i, (_, r) in enumerate(blocks) if r == MAIN}
    found = [template(own, p or [], main) for p in (partner, *others)]
    gone, told = found[0] or set(), [f for f in found if f is not None]
    agreed = set.intersection(*told) if len(told) >= AGREE else set()
    return "\n".join(t for i, (t, r) in enumerate(blocks) if r != FRAME and i not in (agreed if r == MAIN else gone))


def address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


LINES = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64()))])
PAIRS = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("common", pa.int32()), ("away", pa.int32()), ("part", pa.int32()), ("host", pa.string()), ("path", pa.string())])
PAIRS_DDL = "id long, other long, common int, away int, part int, host string, path string"
AWAY = [k for k in range(-REACH, REACH + 1) if k]


def _addressed(batches):
    for b in batches:
        urls = [address(u) for u in b["url"].to_pylist()]
        hashes = [[line_hash(t) for t, _ in lines(h)] for h in b["html"].to_pylist()]
        yield pa.record_batch([b["id"], pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()), pa.array(hashes, pa.list_(pa.int64()))], schema=LINES)


def _paired(x: tuple, y: tuple, away: int) -> list[tuple]:
    """Both directions of a pair of (host, path, id); y stands ``away`` rows behind x."""
    n = common(x[1], y[1])
    return [(x[2], y[2], n, away), (y[2], x[2], n, -away)]


def _neighbours(batches):
    """Pairs up to REACH rows apart within a sorted partition, and its outer rows for the seams.

    An outer row carries its place from the front (``away``) and the partition's size (``common``).
    """
    part, first, last, size = TaskContext.get().partitionId(), [], deque(maxlen=REACH), 0
    for b in batches:
        rows = []
        for now in zip(b["host"].to_pylist(), b["path"].to_pylist(), b["id"].to_pylist(), strict=True):
            for k, before in enumerate(reversed(last), 1):
                if before[0] == now[0]:
                    rows += [(*p, None, None, None) for p in _paired(before, now, k)]
            if size < REACH:
                first.append(now)
            last.append(now)
            size += 1
        yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PAIRS)], schema=PAIRS)
    outer = {**dict(enumerate(first)), **dict(enumerate(last, size - len(last)))}
    rows = [(x[2], None, size, at, part, x[0], x[1]) for at, x in outer.items()]
    yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PAIRS)], schema=PAIRS)


def _seams(batches):
    """Pairs across partition borders, from each partition's outer rows."""
    rows, ends = [], []
    for b in batches:
        ends += b.to_pylist()
    ends.sort(key=lambda r: (r["part"], r["away"]))
    start, part, size, placed = 0, None, 0, []
    for r in ends:
        if r["part"] != part:
            start, part, size = start + size, r["part"], r["common"]
        placed.append((start + r["away"], r["part"], (r["host"], r["path"], r["id"])))
    for i, (at, part, x) in enumerate(placed):
        for there, other, y in placed[i + 1 : i + 1 + REACH]:
            if there - at <= REACH and part != other and x[0] == y[0]:
                rows += _paired(x, y, there - at)
    yield pa.record_batch([pa.array([r[k] for r in rows], PAIRS.field(k).type) for k in range(4)], names=["id", "other", "common", "away"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text for each row.

    A null page is empty and gives an empty text. A null or broken URL is the host "" with the
    URL as path. Rows without an id have no partner and are read by markup alone; rows that
    share an id share one partner, and one neighbour at each distance. Ties in common path length
    go to the smaller partner id. A partner that holds the page's whole text, or its whole declared
    main region, is a copy and deletes nothing; nor does such a neighbour count as one. An empty table gives an empty result. Only
    the named columns are read.

    Ordering is a range sort over all hosts, so a hot host spreads over many partitions; only
    the outer REACH rows of each partition meet to pair across borders.
    """
    source = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    seen = cut_lineage(source.where("id is not null").mapInArrow(_addressed, "id long, host string, path string, hashes array<long>"))
    ordered = seen.select("host", "path", "id").repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id")
    pairs = cut_lineage(ordered.mapInArrow(_neighbours, PAIRS_DDL))
    seams = pairs.where("part is not null").coalesce(1).mapInArrow(_seams, "id long, other long, common int, away int")
    near = pairs.where("part is null").select("id", "other", "common", "away").unionAll(seams).where("id <> other")
    best = near.groupBy("id").agg(*[F.max(F.when(F.col("away") == k, F.struct("common", (-F.col("other")).alias("minus")))).alias(f"at{k}") for k in AWAY])
    partner = F.greatest("at-1", "at1")["minus"]
    asked = F.array_distinct(F.array(*[F.col(f"`at{k}`")["minus"] for k in AWAY]))
    chosen = best.select("id", partner.alias("partner"), F.explode(asked).alias("minus")).where("minus is not null")
    chosen = chosen.select("id", (-F.col("minus")).alias("other"), F.equal_null("minus", "partner").alias("nearest"))
    theirs = seen.groupBy(F.col("id").alias("other")).agg(F.max("hashes").alias("theirs"))
    found = chosen.join(theirs, "other").groupBy("id")
    partner = found.agg(F.max(F.when(F.col("nearest"), F.col("theirs"))).alias("theirs"), F.collect_list(F.when(~F.col("nearest"), F.col("theirs"))).alias("others"))

    zipped = pa.schema([("id", pa.int64()), ("url", pa.string()), ("body", pa.binary())])

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b["id"], b["url"], pa.array([pack.compress(h.encode("utf-8", "replace")) for h in b["html"].to_pylist()], pa.binary())], schema=zipped)

    def read(batches):
        loosen = zstandard.ZstdDecompressor()
        for b in batches:
            near = zip(b["body"].to_pylist(), b["theirs"].to_pylist(), b["others"].to_pylist(), strict=True)
            texts = [main_text(loosen.decompress(z).decode(), p, more or []) for z, p, more in near]
            yield pa.record_batch([b["id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    small = source.mapInArrow(squeeze, "id long, url string, body binary")
    return small.join(partner, "id", "left").mapInArrow(read, "page_id long, url string, text string")

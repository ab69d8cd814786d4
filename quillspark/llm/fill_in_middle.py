"""Fill-in-the-middle documents, with chunks that texts share counted once.

A rolling hash over the last WINDOW bytes cuts each text into content-defined chunks, so that
passages which documents share become equal chunks wherever they stand. What a chunk adds to a
document is memoized in a cache whose keys are the chunk's bytes, which are therefore compared,
not only hashed: its code points, whether a marker lies inside, and its first and last two bytes,
over which markers between chunks are found. Summed code points tell which chunk holds a cut; only
that chunk is searched for the byte. Texts never leave their row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.text_hash import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
WINDOW = 32
#: A chunk ends where the window's hash is 0 in SPREAD_BITS bits: after 512 bytes on average, LEAST at least, MOST at most.
SPREAD_BITS, LEAST, MOST = 9, 64, 4096
#: Bytes hashed at a time, and bytes of chunks that a task remembers.
SLAB, REMEMBERED = 1 << 20, 32 << 20

_BYTES = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_BASE = np.uint32(0x9E3779B1)


def _rolled(data: np.ndarray) -> np.ndarray:
    """For each byte the polynomial hash of the WINDOW bytes that end there (of fewer at the start).

    Windows of twice the length are put together from two halves: five steps make 32 bytes.
    """
    found, power, n = _BYTES[data], _BASE, 1
    while n < WINDOW:
        longer = found.copy()
        longer[n:] += found[:-n] * power
        found, power, n = longer, np.uint32(int(power) ** 2 & 0xFFFFFFFF), 2 * n
    return found


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after the other; ``starts`` also has the last end.

    Whether a byte may end a chunk depends on the WINDOW bytes before it alone; candidates closer
    than LEAST to the last cut or to the text's start are passed over, so no window reaches
    into another text.
    """
    likely = []
    for at in range(0, len(data), SLAB):
        back = max(0, at - WINDOW + 1)
        hashes = _rolled(data[back : at + SLAB])[at - back :]
        likely.append(np.flatnonzero(hashes >> np.uint32(32 - SPREAD_BITS) == 0) + at + 1)
    likely = np.concatenate([*likely, np.zeros(0, dtype=np.int64)])
    ends, bounds = [], np.searchsorted(likely, starts)
    for text, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        last = begin
        for cut in [*likely[bounds[text] : bounds[text + 1]].tolist(), end]:
            if cut == last or cut - last < LEAST and cut != end:
                continue
            while cut - last > MOST:
                last += MOST
                ends.append(last)
            ends.append(cut)
            last = cut
    return np.array(ends, dtype=np.int64)


class Summaries:
    """Chunk bytes to (code points, holds a marker, first two bytes, last two bytes).

    Two generations bound what is remembered: the young one grows to half the bytes and then
    takes the old one's place. A forgotten chunk is summed up again, with the same outcome.
    """

    def __init__(self, remembered: int = REMEMBERED) -> None:
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.size, self.limit, self.made = 0, remembered // 2, 0

    def of(self, chunk: bytes) -> tuple:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.made += 1
                points = int(np.count_nonzero(np.frombuffer(chunk, dtype=np.int8) >= -64))
                found = points, any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:]
            if self.size > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = found
            self.size += len(chunk)
        return found


def _lead(chunk: bytes, point: int) -> int:
    """Where the code point of this number begins among those that begin in the chunk."""
    return int(np.flatnonzero(np.frombuffer(chunk, dtype=np.int8) >= -64)[point])


class Located:
    """A text's chunks with running counts of code points."""

    def __init__(self, chunks: list[bytes], summaries: Summaries) -> None:
        self.chunks, self.before, self.marked, edge = chunks, [0], False, b""
        for chunk in chunks:
            points, inside, head, tail = summaries.of(chunk)
            self.marked = self.marked or inside or any(m in edge + head for m in MARKERS)
            edge = (edge + tail)[-2:]
            self.before.append(self.before[-1] + points)
        self.n = self.before[-1]

    def byte(self, point: int) -> int:
        """Byte offset at which this many code points are over."""
        if point >= self.n:
            return sum(map(len, self.chunks))
        at = int(np.searchsorted(self.before, point, side="right")) - 1
        return sum(map(len, self.chunks[:at])) + _lead(self.chunks[at], point - self.before[at])


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits from the SHA-256 of ``1:`` and the key."""
    digest = hashlib.sha256(b"1:" + key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(key: str, text: bytes, chunks: list[bytes], summaries: Summaries, plain_from: int, spm_below: int) -> tuple:
    """n, form, code points of prefix and middle, output."""
    found, (h1, h2, h3, h4) = Located(chunks, summaries), draws(key)
    if not found.n or found.marked or h3 % 100 >= plain_from:
        return found.n, "plain", None, None, text
    first, second = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
    a, b = found.byte(first), found.byte(second)
    p, s, m = MARKERS
    if h4 % 100 < spm_below:
        return found.n, "spm", first, second - first, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return found.n, "psm", first, second - first, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output for each row; see ``restore`` for the way back.

    A text of n code points is cut at two places that the SHA-256 of ``1:`` and its id draws; form
    is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) in ``spm_below`` of 100 draws, or
    ``plain`` (the text itself; null lengths) if the text is empty, holds a marker, or the draw of
    100 is ``plain_from`` or more. A null text is an empty one; a null id draws as an empty string.
    Equal rows give equal rows; rows that share an id draw alike. Other columns are not looked at,
    whatever their names. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys = ["" if k is None else k for k in batch.column(1).to_pylist()]
            for low, high in _groups([len(t) for t in texts]):
                some = texts[low:high]
                starts = np.cumsum([0] + [len(t) for t in some])
                data = b"".join(some)
                ends = cut_points(np.frombuffer(data, dtype=np.uint8), starts)
                at, rows, last = 0, [], 0
                for i, (k, t) in enumerate(zip(keys[low:high], some, strict=True)):
                    chunks = []
                    while at < len(ends) and ends[at] <= starts[i + 1]:
                        chunks.append(data[last : ends[at]])
                        last = int(ends[at])
                        at += 1
                    rows.append(transform(k, t, chunks, summaries, plain_from, spm_below))
                n, form, prefix, middle, out = zip(*rows, strict=True)
                columns = [batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    slim = docs.select(F.col(doc_id).alias("id"), F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, schema)


def _groups(sizes: list[int], limit: int = 4 * SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts stay within the limit; a longer text stands alone."""
    at, used = 0, 0
    for i, n in enumerate(sizes):
        if i > at and used + n > limit:
            yield at, i
            at, used = i, 0
        used += n
    if at < len(sizes):
        yield at, len(sizes)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    No text in ``psm`` or ``spm`` form holds a marker, and markers don't overlap each other, so
    the three found from left to right are those that were put in.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = """
with hashed as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
drawn as (
  select *, ('0x' || substr(s, 1, 8))::bigint % (n + 1) as c1, ('0x' || substr(s, 9, 8))::bigint % (n + 1) as c2,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(s, 17, 8))::bigint % 100 >= 90 then 'plain'
         when ('0x' || substr(s, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from hashed),
parted as (
  select *, substr(t, 1, least(c1, c2)) as p, substr(t, least(c1, c2) + 1, abs(c1 - c2)) as m, substr(t, greatest(c1, c2) + 1) as x from drawn)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parted
"""

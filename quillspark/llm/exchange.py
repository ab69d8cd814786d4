"""Compact exchange of sorted keys between document chunks and key segments.

Finding what repeats in a corpus would shuffle one row for each window. Here documents are
first dealt to *chunks* by a hash (one shuffle of the text, which Spark reuses for each later
pass). A chunk sends its distinct sorted keys, delta coded, as one blob for each key
*segment*; a segment merges the blobs and answers each chunk with one bit for each key. A key
that half of the corpus holds is one entry from each chunk, so no segment gets hot.

A chunk sends at most FAN blobs, however many chunks there are: beyond FAN chunks the exchange
has levels (``climb``). On each level a node merges the blobs of ``fan`` senders for one key range and
sends the merged keys on, cut into ``fan`` smaller ranges, so blobs stay large and their number
grows with chunks times levels, not with the square of chunks. Answers go back the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20  # two Python workers with a chunk each fit beside a 2 GB heap in 3 GB
MIN_CHUNKS = 24
FAN = 256  # most blobs that a chunk, or a node between levels, sends
NO_ID = (1 << 63) - 1


def chunk_count(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """One pass over the text column; the only figure that reaches the driver."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(MIN_CHUNKS, -(-int(total) // chunk_bytes))


def chunked(docs: DataFrame, doc_id: str, text: str, chunks: int) -> DataFrame:
    """chunk, id, body: a null id sorts after all others, a null text is empty."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )



def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def squeeze(array: np.ndarray) -> bytes:
    """Bytes of equal rank stand together, so zstd sees the zero bytes of small numbers."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(loosen(blob, dtype), dtype=dtype)


def fans(chunks: int) -> tuple[int, int]:
    """Levels of the exchange, and how many senders a node has and ranges it sends to."""
    levels = 1
    while FAN**levels < chunks:
        levels += 1
    fan = 1
    while fan**levels < chunks:
        fan += 1
    return levels, fan


class Ranges:
    """Some consecutive ones of ``total`` equal ranges of keys below 2**bits."""

    def __init__(self, bits: int, total: int, first: int, count: int) -> None:
        self.first, self.count = first, count
        self.edges = np.array([(i << bits) // total for i in range(first + 1, first + count)], dtype=np.uint64)

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """Where each range begins in the sorted keys, and their end."""
        return np.concatenate([[0], np.searchsorted(keys, self.edges), [len(keys)]])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's range."""
        return self.first + np.searchsorted(self.edges, keys, side="right")


def send(node: int, part: int, blobs: list[tuple[int, bytes]]) -> list[tuple]:
    """Rows of a sender: one for each (segment, blob)."""
    return [(node, part, seg, blob) for seg, blob in blobs]


def sent_table(rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SENT)}, schema=SENT)


def pack_ranges(keys: np.ndarray, ranges: Ranges) -> list[tuple[int, bytes]]:
    """(segment, blob of its keys) for each range that has keys."""
    at = ranges.cut(keys)
    return [(ranges.first + i, pack_sorted(keys[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]


SENT = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("seg", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "chunk int, part int, seg int, blob binary"


def bits_of(replies: pa.Table, part: int, keys: np.ndarray, ranges: Ranges) -> np.ndarray:
    """The bits that came back for one part, in the order of its sorted keys."""
    at, flags = ranges.cut(keys), np.zeros(len(keys), dtype=bool)
    for p, seg, blob in zip(replies["part"].to_pylist(), replies["seg"].to_pylist(), replies["blob"].to_pylist(), strict=True):
        if p == part:
            i = seg - ranges.first
            flags[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))[: at[i + 1] - at[i]]
    return flags


def climb(sent: DataFrame, levels: int, fan: int, by: tuple[str, ...], merge: Callable, settle: Callable, answer: Callable) -> DataFrame:
    """Answers (chunk, part, seg, blob) to what chunks sent, for rows grouped by ``by``.

    On the last level ``settle(table)`` answers its senders. On each level before, ``merge(table, total)``
    sends on to the ``total`` ranges of the next one, and ``answer(table, replies, total)`` makes answers
    to its own senders of the replies. Tables between levels have the node in column ``up``.
    """
    up, rows, below = F.expr(f"cast(chunk div {fan} as int)"), sent, []

    # Spark tells functions apart by the number of their arguments, so each gets its own small one.
    def settling(table: pa.Table) -> pa.Table:
        return settle(table)

    def merging(total: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            return merge(table, total)

        return run

    def answering(total: int) -> Callable:
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            return answer(table, replies, total)

        return run

    for level in range(1, levels):
        total, rows = fan ** (level + 1), rows.withColumn("up", up)
        below.append((rows, total))
        rows = rows.groupBy("up", *by).applyInArrow(merging(total), SENT_DDL)
    back = rows.groupBy(*by).applyInArrow(settling, SENT_DDL)
    for rows, total in reversed(below):
        asked = back.withColumn("up", F.col("chunk")).withColumn("parent", F.expr(f"cast(seg div {fan} as int)"))
        pairs = rows.groupBy("up", *by).cogroup(asked.groupBy("up", *("parent" if c == "seg" else c for c in by)))
        back = pairs.applyInArrow(answering(total), SENT_DDL)
    return back


class Repeats:
    """The exchange for "does another chunk have this key too": one bit for each key sent."""

    def __init__(self, bits: int, fan: int) -> None:
        self.bits, self.fan = bits, fan

    def below(self, table: pa.Table, total: int) -> Ranges:
        return Ranges(self.bits, total, table["seg"][0].as_py() * self.fan, self.fan)

    def merge(self, table: pa.Table, total: int) -> pa.Table:
        keys = distinct(np.concatenate([unpack_sorted(b) for b in table["blob"].to_pylist()]))
        return sent_table(send(table["up"][0].as_py(), table["part"][0].as_py(), pack_ranges(keys, self.below(table, total))))

    def settle(self, table: pa.Table) -> pa.Table:
        return self.answer(table, None, 0)

    def answer(self, table: pa.Table, replies: pa.Table | None, total: int) -> pa.Table:
        if not len(table):
            return sent_table([])
        keys = [unpack_sorted(b) for b in table["blob"].to_pylist()]
        every = np.sort(np.concatenate(keys))
        many = every[1:][every[1:] == every[:-1]]
        if replies is not None:
            unique = distinct(every)
            many = distinct(np.concatenate([many, unique[bits_of(replies, table["part"][0].as_py(), unique, self.below(table, total))]]))
        bits = [np.packbits(among(many, k)).tobytes() for k in keys]
        return pa.table({"chunk": table["chunk"], "part": table["part"], "seg": table["seg"], "blob": bits}, schema=SENT)


def among(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted keys occur in the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == wanted


def documents(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids as they are, ids to order by, and bodies of a chunk, in a fixed order."""
    ids, bodies = table["id"].to_pylist(), table["body"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, bodies[i]))
    ids, bodies = [ids[i] for i in order], [bodies[i] for i in order]
    return ids, np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), bodies

"""Substring dedup: repeated word windows found behind a count-min prefilter.

1. Each chunk of documents hashes all its word windows and sends a two-row count-min sketch:
   for each row the sorted cells that it fills. Segments merge the rows; a chunk learns which
   of its cells another chunk fills too. An estimate (the minimum over the rows) is never
   below the true count, so no repeated window is lost.
2. Windows estimated repeated, and only those, are grouped exactly by 128-bit keys; each
   chunk learns for which of its keys a smaller document exists elsewhere.
3. The chunk marks every occurrence but the first and drops the covered words.

The text is shuffled once; the later passes reuse that exchange. The sketch is sparse (sorted
cells, delta coded) and its width follows the number of input bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import exchange as X
from quillspark.llm.text_hash import Rolling, Words, slabs

FLAGS, KEYS = 9, 2
RESULT = "id long, n_words long, n_removed long, kept string"


class ChunkWindows:
    """All windows of a chunk: document index, first word, and one or two 64-bit hashes."""

    def __init__(self, bodies: list[bytes], n: int, both: bool) -> None:
        rolling, docs, starts, one, two = Rolling(), [], [], [], []
        self.words: list[tuple[int, np.ndarray, np.ndarray, bytes]] = []
        for lo, hi in slabs([len(b) for b in bodies]):
            w = Words(bodies[lo:hi])
            at = w.whole(n)
            docs.append((w.doc[at] + lo).astype(np.int32))
            starts.append((at - w.first[w.doc[at]]).astype(np.int32))
            one.append(rolling.fixed(w.hashes(rolling, 0), n, 0)[at] if len(at) else np.zeros(0, np.uint64))
            if both:
                two.append(rolling.fixed(w.hashes(rolling, 1), n, 1)[at] if len(at) else np.zeros(0, np.uint64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.doc, self.start = join(docs, np.int32), join(starts, np.int32)
        self.h1, self.h2 = join(one, np.uint64), join(two, np.uint64) if both else None


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]


def _candidates(w: ChunkWindows, flags: list[np.ndarray], cells: list[tuple]) -> np.ndarray:
    """Windows whose estimate is two or more: filled twice here, or by another chunk too, in each row."""
    keep = np.ones(len(w.h1), dtype=bool)
    for (unique, counts), flag, own in zip(cells, flags, _cells(w.h1, w.bits), strict=True):
        keep &= X.among(unique[flag | (counts > 1)], own)
    return np.flatnonzero(keep)


def _distinct_keys(w: ChunkWindows, at: np.ndarray, order: np.ndarray):
    """Candidates sorted by key; where each key starts; each key's smallest id."""
    ids = order[w.doc[at]]
    by = np.lexsort((w.start[at], w.doc[at], ids, w.h2[at], w.h1[at]))
    at, ids = at[by], ids[by]
    h1, h2 = w.h1[at], w.h2[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return at, ids, new, np.flatnonzero(new)


def _pack(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> bytes:
    blobs = [X.pack_sorted(h1), X.squeeze(h2), X.squeeze(ids)]
    return np.array([len(b) for b in blobs[:2]], dtype=np.uint32).tobytes() + b"".join(blobs)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n1, n2 = np.frombuffer(blob[:8], dtype=np.uint32)
    b = blob[8:]
    return X.unpack_sorted(b[:n1]), X.loosen(b[n1 : n1 + n2], np.uint64), X.loosen(b[n1 + n2 :], np.int64)


class LeastIds:
    """The exchange for "does another chunk have this key in a smaller document"."""

    def __init__(self, fan: int) -> None:
        self.fan = fan

    def merged(self, arrays: list[tuple]) -> tuple:
        """Distinct keys in order with their least id, and each sent key's place among them."""
        h1, h2, ids = (np.concatenate([a[i] for a in arrays]) for i in range(3))
        by = np.lexsort((ids, h2, h1))
        s1, s2 = h1[by], h2[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        first, of = np.flatnonzero(new), np.zeros(len(by), dtype=np.int64)
        of[by] = np.cumsum(new) - 1
        return s1[first], s2[first], ids[by][first], of, ids

    def below(self, table: pa.Table, total: int) -> X.Ranges:
        return X.Ranges(64, total, table["seg"][0].as_py() * self.fan, self.fan)

    def sent(self, table: pa.Table) -> tuple[list[dict], list[tuple]]:
        rows = [r for r in table.to_pylist() if r["part"] != FLAGS]
        return rows, [_unpack(r["blob"]) for r in rows]

    def merge(self, table: pa.Table, total: int) -> pa.Table:
        rows, arrays = self.sent(table)
        if not rows:
            return X.sent_table([])
        h1, h2, ids, _, _ = self.merged(arrays)
        return X.sent_table(X.send(table["up"][0].as_py(), KEYS, _ranged(h1, h2, ids, self.below(table, total))))

    def settle(self, table: pa.Table) -> pa.Table:
        return self.answer(table, None, 0)

    def answer(self, table: pa.Table, replies: pa.Table | None, total: int) -> pa.Table:
        """What a chunk sent as flags goes back as it is."""
        rows, arrays = self.sent(table)
        out = [(r["chunk"], r["part"], r["seg"], r["blob"]) for r in table.to_pylist() if r["part"] == FLAGS]
        if rows:
            h1, _, least, of, ids = self.merged(arrays)
            flag = least[of] < ids
            if replies is not None:
                flag |= X.bits_of(replies, KEYS, h1, self.below(table, total))[of]
            lo = 0
            for r, a in zip(rows, arrays, strict=True):
                out.append((r["chunk"], KEYS, r["seg"], np.packbits(flag[lo : lo + len(a[0])]).tobytes()))
                lo += len(a[0])
        return X.sent_table(out)


def _ranged(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, ranges: X.Ranges) -> list[tuple[int, bytes]]:
    at = ranges.cut(h1)
    return [(ranges.first + i, _pack(h1[a:b], h2[a:b], ids[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Removes each word covered by a window that also starts earlier (see ``RESULT``).

    A word is a run of bytes other than space and 0x09-0x0D. Earlier means in a document with
    a smaller id, or in the same row at an earlier word. A null text has no words; texts of
    fewer than ``window`` words keep all of them. A null id counts as larger than any id. Rows
    that share an id are separate documents, none earlier than the other. One row comes back
    for each input row; other columns are not read, so their names cannot clash. An empty
    table gives an empty result.
    """
    chunks = X.chunk_count(docs, text)
    (levels, fan), n = X.fans(chunks), window
    bits = min(60, max(20, math.ceil(math.log2(chunks * X.CHUNK_BYTES / 6)) + 4))
    dealt = X.chunked(docs, doc_id, text, chunks)
    cells_of, keys_of = X.Ranges(bits, fan, 0, fan), X.Ranges(64, fan, 0, fan)
    repeats, least = X.Repeats(bits, fan), LeastIds(fan)

    def windows(bodies: list[bytes], both: bool) -> ChunkWindows:
        w = ChunkWindows(bodies, n, both)
        w.bits = bits
        return w

    def sketch(table: pa.Table) -> pa.Table:
        w = windows(X.documents(table)[2], False)
        chunk = table["chunk"][0].as_py()
        return X.sent_table([row for part, c in enumerate(_cells(w.h1, bits)) for row in X.send(chunk, part, X.pack_ranges(X.distinct(c), cells_of))])

    def learn(table: pa.Table, replies: pa.Table):
        ids, order, bodies = X.documents(table)
        w = windows(bodies, True)
        cells = [np.unique(c, return_counts=True) for c in _cells(w.h1, bits)]
        return ids, order, bodies, w, cells

    def group(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return X.sent_table([])
        chunk = table["chunk"][0].as_py()
        _, order, _, w, cells = learn(table, replies)
        flags = [X.bits_of(replies, p, c[0], cells_of) for p, c in enumerate(cells)]
        at, ids, _, first = _distinct_keys(w, _candidates(w, flags, cells), order)
        keys = _ranged(w.h1[at[first]], w.h2[at[first]], ids[first], keys_of)
        return X.sent_table([(chunk, FLAGS, chunk % fan, X.squeeze(np.packbits(np.concatenate(flags)))), *X.send(chunk, KEYS, keys)])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept": []}
        if len(table):
            ids, order, bodies, w, cells = learn(table, replies)
            packed = next(b for p, b in zip(replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True) if p == FLAGS)
            flat = np.unpackbits(X.loosen(packed, np.uint8)).astype(bool)
            n0 = len(cells[0][0])
            flags = [flat[:n0], flat[n0 : n0 + len(cells[1][0])]]
            at, rank, new, first = _distinct_keys(w, _candidates(w, flags, cells), order)
            elsewhere = X.bits_of(replies, KEYS, w.h1[at[first]], keys_of)
            nth = np.cumsum(new) - 1
            again = ~new & (np.concatenate([[-1], w.doc[at[:-1]]]) == w.doc[at]) if len(at) else new
            gone = at[again | elsewhere[nth] | (rank > rank[first][nth])] if len(at) else at
            doc, start = w.doc[gone], w.start[gone]
            by = np.argsort(doc, kind="stable")
            edge = np.searchsorted(doc[by], np.arange(len(bodies) + 1))
            for i, body in enumerate(bodies):
                words = body.split()
                mine = start[by[edge[i] : edge[i + 1]]]
                if len(mine):
                    cover = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(cover, mine, 1)
                    np.add.at(cover, mine + n, -1)
                    left = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    kept = [words[j] for j in left]
                else:
                    kept = words
                out["id"].append(ids[i])
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    first = X.climb(dealt.groupBy("chunk").applyInArrow(sketch, X.SENT_DDL), levels, fan, ("part", "seg"), repeats.merge, repeats.settle, repeats.answer)
    second = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(group, X.SENT_DDL)
    second = X.climb(second, levels, fan, ("seg",), least.merge, least.settle, least.answer)
    return dealt.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(remove, RESULT)


#: The contract of the registered query, for DuckDB.
ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
 pos as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i, unnest(list_transform(range(1, len(ws) + 1), lambda i: case when i + 19 <= len(ws) then array_to_string(ws[i:i + 19], ' ') end)) as k from w),
 ranked as (select *, k is not null and row_number() over (partition by k order by doc_id, i) > 1 as again from pos),
 told as (select *, coalesce(bool_or(again) over (partition by doc_id order by i rows between 19 preceding and current row), false) as gone from ranked)
select w.doc_id, w.n::bigint as n_words, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (where not gone), '')) as kept_sha256
from (select doc_id, len(ws) as n from w) w left join told using (doc_id) group by w.doc_id, w.n
"""

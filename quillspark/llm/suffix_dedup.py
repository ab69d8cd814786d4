"""Suffix-array dedup of repeated byte strings by a distributed, prefix-aware merge sort.

A suffix of every byte would be dozens of times the input. Two occurrences of a string choose
the same *anchor* inside it (its minimiser: the k-byte piece of least hash), so suffixes are
sorted for anchors only. All windows that share an anchor form one stretch of text.

1. Chunks exchange the sorted hashes of their anchors, with the number of different contexts of
   each; an anchor that only one chunk and one document holds cannot be in a repeated string and
   is left out.
2. For the others, each chunk sorts its distinct suffixes (text from the anchor on, with the
   bytes before it as payload) and sends them as front-coded runs: length of the common prefix
   with the one before, and the rest. An anchor of more than HOT contexts would fill one task; its
   windows are suffixes of their own and go to segments by their own hashes.
3. A segment merges its runs with a loser tree that carries common-prefix lengths, so a known
   prefix is never compared again. Neighbours that share the k bytes are one anchor; there
   each window's smallest document is found on the bytes themselves. Beyond X.FAN chunks, nodes
   between merge runs the same way and send on one run for each smaller range.
4. Runs go back as one bit mask for each suffix; chunks cut the covered bytes.

The text is shuffled once; later passes reuse that exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import exchange as X
from quillspark.llm.text_hash import U64, Quick, byte_table, mix, slabs, stir

ANCHORS, RUN, WINDOWS, FLAGS = 0, 2, 3, 9
HOT = 4096  # an anchor of more different contexts is dealt out by its windows
RESULT = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def anchors(bodies: list[bytes], length: int, k: int):
    """For each stretch of windows with one anchor: document, first and last window, anchor, hashes of anchor and stretch."""
    rolling, table, parts = Quick(), byte_table(), []
    width, low = length - k + 1, U64(0xFFFFFFFF)
    for lo, hi in slabs([len(b) for b in bodies]):
        sizes = np.array([len(b) for b in bodies[lo:hi]])
        offset = np.concatenate([[0], np.cumsum(sizes)])
        if offset[-1] < length:
            continue
        values = table[np.frombuffer(b"".join(bodies[lo:hi]), dtype=np.uint8)]
        h = rolling.fixed(values, k, finish=stir)
        least = (h & ~low) | np.arange(len(h), dtype=U64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        # Windows from a document's last length - 1 bytes on would cross into the next one.
        begins, stops = offset[:-1], np.maximum(offset[1:] - length + 1, offset[:-1])
        edge = X.distinct(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begins, stops, [len(least)]]))
        edge = edge[edge <= len(least)]
        first, last = edge[:-1], edge[1:] - 1
        doc = np.searchsorted(begins, first, side="right") - 1
        real = first < stops[doc]
        first, last, doc = first[real], last[real], doc[real]
        at = (least[first] & low).astype(np.int64)
        parts.append((doc + lo, first - begins[doc], last - begins[doc], at - begins[doc], mix(h[at]), rolling.ranges(values, first, last + length)))
    if not parts:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate([p[i] for p in parts]) for i in range(6)]


def hashes_of(rows: np.ndarray) -> np.ndarray:
    """Hashes of equally long byte strings, a row each; those of ``anchors`` for k bytes.

    An anchor has the least hash around, so its hash is mixed once more: ranges of it are even.
    """
    up, table = Quick().table(rows.shape[1])[0][: rows.shape[1]], byte_table()
    return np.concatenate([np.zeros(0, U64), *(mix(stir((table[rows[i : i + 4096]] * up).sum(axis=1, dtype=U64))) for i in range(0, len(rows), 4096))])


class Suffixes:
    """The distinct suffixes of some stretches, sorted by segment, text from the anchor on, and
    text before it. Rows are fixed-width: segment (4 bytes), right text, left text, both lengths."""

    def __init__(self, bodies: list[bytes], ranks: np.ndarray, doc, first, last, anchor, seg, length: int, k: int) -> None:
        self.right, self.left = 2 * length - k, length - k
        n, self.each = len(doc), 4 + self.right + self.left + 2
        rows = np.zeros((n, self.each), dtype=np.uint8)
        rows[:, :4] = seg.astype(">u4").view(np.uint8).reshape(-1, 4)
        edge = np.searchsorted(doc, np.arange(len(bodies) + 1))
        for lo, hi in slabs([len(b) for b in bodies]):
            a, b = edge[lo], edge[hi]
            if a == b:
                continue
            buf = np.frombuffer(b"".join(bodies[lo:hi]) + bytes(self.right), dtype=np.uint8)
            base = np.cumsum([0] + [len(x) for x in bodies[lo:hi]])[doc[a:b] - lo]
            for to, width, start, size in ((4, self.right, anchor[a:b], last[a:b] + length - anchor[a:b]), (4 + self.right, self.left, first[a:b], anchor[a:b] - first[a:b])):
                col = np.arange(width)
                text = buf[np.minimum((base + start)[:, None] + col, len(buf) - 1)]
                text[col >= size[:, None]] = 0
                rows[a:b, to : to + width] = text
        rows[:, -2], rows[:, -1] = last + length - anchor, anchor - first
        keys = rows.view(f"V{self.each}").ravel()
        by = np.lexsort((doc, first)) if n else np.zeros(0, np.int64)  # any fixed order among equals
        by = by[np.argsort(rows[by].view(f"S{self.each}").ravel(), kind="stable")]
        keys = keys[by]
        new = np.ones(n, dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.flatnonzero(new)
        self.rows = rows[by[head]]
        self.ranks = np.minimum.reduceat(ranks[doc[by]], head) if n else np.zeros(0, np.int64)
        self.of = np.zeros(n, dtype=np.int64)  # each stretch's suffix
        self.of[by] = np.cumsum(new) - 1
        self.segments = np.ascontiguousarray(self.rows[:, :4]).view(">u4").ravel().astype(np.int64)

    def runs(self) -> list[tuple[int, bytes]]:
        """(segment, front-coded run)."""
        found = []
        for seg in np.unique(self.segments).tolist():
            a, b = np.searchsorted(self.segments, [seg, seg + 1])
            part = self.rows[a:b]
            found.append((seg, front_coded(part[:, 4 : 4 + self.right], part[:, 4 + self.right : -2], part[:, -2], part[:, -1], self.ranks[a:b])))
        return found


def front_coded(right: np.ndarray, left: np.ndarray, size: np.ndarray, before: np.ndarray, ranks: np.ndarray) -> bytes:
    """A run of sorted suffixes: each one's prefix shared with the one before, and the rest."""
    shared = np.zeros(len(right), dtype=np.uint8)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    col = np.arange(right.shape[1])
    rest = right[(col >= shared[:, None]) & (col < size[:, None])]
    payload = left[np.arange(left.shape[1]) < before[:, None]]
    blobs = [X.squeeze(x) for x in (shared, size, before, rest, payload, ranks)]
    return np.array([len(x) for x in blobs], dtype=np.uint32).tobytes() + b"".join(blobs)


class Run:
    """A front-coded run, read entry by entry."""

    def __init__(self, blob: bytes) -> None:
        sizes, at, parts = np.frombuffer(blob[:24], dtype=np.uint32).tolist(), 24, []
        for n in sizes:
            parts.append(blob[at : at + n])
            at += n
        common, size, before = (X.loosen(p, np.uint8).tolist() for p in parts[:3])
        rest, lefts = X.loosen(parts[3], np.uint8).tobytes(), X.loosen(parts[4], np.uint8).tobytes()
        self.common, self.ranks = common, X.loosen(parts[5], np.int64).tolist()
        self.rights, self.lefts, r, at, lt = [], [], b"", 0, 0
        for c, n, b in zip(common, size, before, strict=True):
            r = r[:c] + rest[at : at + n - c]
            at += n - c
            self.rights.append(r)
            self.lefts.append(lefts[lt : lt + b])
            lt += b


def merged(runs: list[Run]):
    """(run, position, prefix shared with the entry before) in sorted order, by a loser tree.

    Every contender carries the length of the prefix that it shares with the last winner. The
    longer shared prefix is the smaller string, without a look at the bytes; at a tie the
    comparison starts behind that prefix.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [r.rights[0] if r.rights else b"" for r in runs] + [b""] * (leaves - len(runs))
    shared = [0 if r.rights else -1 for r in runs] + [-1] * (leaves - len(runs))
    at, ends = [0] * len(runs), [len(r.rights) for r in runs]
    losers = [0] * leaves

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        i = shared[x]
        if i < 0:
            return x, y
        a, b = heads[x], heads[y]
        if a[i:] == b[i:]:
            shared[y] = len(b)
            return x, y
        most = min(len(a), len(b))
        while i < most and a[i] == b[i]:
            i += 1
        if i == len(a) or i < len(b) and a[i] < b[i]:
            shared[y] = i
            return x, y
        shared[x] = i
        return y, x

    level = list(range(leaves))
    node = leaves
    while len(level) > 1:
        node -= len(level) // 2
        up = []
        for j in range(0, len(level), 2):
            w, l = play(level[j], level[j + 1])
            losers[node + j // 2] = l
            up.append(w)
        level = up
    w = level[0]
    while shared[w] >= 0:
        i = at[w]
        yield w, i, shared[w]
        at[w] = i = i + 1
        if i < ends[w]:
            heads[w], shared[w] = runs[w].rights[i], runs[w].common[i]
        else:
            shared[w] = -1
        node = (leaves + w) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1


def unique_entries(runs: list[Run]) -> tuple[list[tuple[bytes, bytes, int]], list[np.ndarray]]:
    """Distinct (right, left, least rank) in order, and each run's places among them."""
    out: list[tuple[bytes, bytes, int]] = []
    place = [np.zeros(len(r.rights), dtype=np.int64) for r in runs]
    same: list[tuple[int, int]] = []

    def close() -> None:
        by: dict[bytes, list[tuple[int, int]]] = {}
        for w, i in same:
            by.setdefault(runs[w].lefts[i], []).append((w, i))
        for left in sorted(by):
            for w, i in by[left]:
                place[w][i] = len(out)
            w, i = by[left][0]
            out.append((runs[w].rights[i], left, min(runs[w].ranks[i] for w, i in by[left])))

    for w, i, common in merged(runs):
        if same and not (common == len(runs[w].rights[i]) == len(runs[same[-1][0]].rights[same[-1][1]])):
            close()
            same = []
        same.append((w, i))
    if same:
        close()
    return out, place


def masks(blobs: list[bytes], length: int, k: int) -> list[np.ndarray]:
    """For each run and entry: a bit for each window that also starts in a smaller document."""
    runs = [Run(b) for b in blobs]
    found = [np.zeros(len(r.rights), dtype=np.uint64) for r in runs]

    def settle(group: list[tuple[int, int]]) -> None:
        least: dict[bytes, int] = {}
        for w, i in group:
            full, rank = runs[w].lefts[i] + runs[w].rights[i], runs[w].ranks[i]
            if rank < least.get(full, X.NO_ID + 1):
                least[full] = rank
        if len(least) == 1:
            (full, rank), = least.items()
            every = (1 << (len(full) - length + 1)) - 1
            for w, i in group:
                if runs[w].ranks[i] > rank:
                    found[w][i] = every
            return
        windows = {}
        for full, rank in least.items():
            for j in range(len(full) - length + 1):
                s = full[j : j + length]
                if rank < windows.get(s, X.NO_ID + 1):
                    windows[s] = rank
        for w, i in group:
            full, rank, bits = runs[w].lefts[i] + runs[w].rights[i], runs[w].ranks[i], 0
            for j in range(len(full) - length + 1):
                if windows[full[j : j + length]] < rank:
                    bits |= 1 << j
            found[w][i] = bits

    group: list[tuple[int, int]] = []
    for w, i, common in merged(runs):
        if common < k and group:
            if len(group) > 1:
                settle(group)
            group = []
        group.append((w, i))
    if len(group) > 1:
        settle(group)
    return found


def window_hashes(bodies: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that start at some places of their documents."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    at = np.cumsum([0] + [len(b) for b in bodies])[doc] + start
    return np.concatenate([np.zeros(0, U64), *(hashes_of(data[at[i : i + 65_536, None] + np.arange(length)]) for i in range(0, len(at), 65_536))])


def ranged_counts(keys: np.ndarray, counts: np.ndarray, ranges: X.Ranges) -> list[tuple[int, bytes]]:
    """(segment, blob) of sorted keys and their counts, which are mostly 1."""
    at, counts, found = ranges.cut(keys), np.minimum(counts, 1 << 30).astype(np.uint32), []
    for i, (a, b) in enumerate(zip(at, at[1:])):
        if a < b:
            blob = X.pack_sorted(keys[a:b])
            found.append((ranges.first + i, len(blob).to_bytes(4, "little") + blob + X.squeeze(counts[a:b])))
    return found


class AnchorCounts:
    """The exchange for "does another chunk hold this anchor, and has it more than ``most`` contexts"."""

    def __init__(self, bits: int, fan: int, most: int) -> None:
        self.bits, self.fan, self.most = bits, fan, most

    @staticmethod
    def flags(replies: pa.Table, keys: np.ndarray, ranges: X.Ranges) -> np.ndarray:
        """Two rows of bits for sorted keys: held elsewhere, hot."""
        at, found = ranges.cut(keys), np.zeros((2, len(keys)), dtype=bool)
        for seg, blob in zip(replies["seg"].to_pylist(), replies["blob"].to_pylist(), strict=True):
            a, b = at[seg - ranges.first], at[seg - ranges.first + 1]
            found[:, a:b] = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))[: 2 * (b - a)].reshape(2, -1)
        return found

    def read(self, table: pa.Table) -> tuple:
        """Distinct keys, how many senders hold each and how many contexts it has; each sender's places."""
        keys, counts = [], []
        for blob in table["blob"].to_pylist():
            n = 4 + int.from_bytes(blob[:4], "little")
            keys.append(X.unpack_sorted(blob[4:n]))
            counts.append(X.loosen(blob[n:], np.uint32).astype(np.int64))
        unique, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
        return unique, np.bincount(of, minlength=len(unique)), total, np.split(of, np.cumsum([len(k) for k in keys])[:-1])

    def below(self, table: pa.Table, total: int) -> X.Ranges:
        return X.Ranges(self.bits, total, table["seg"][0].as_py() * self.fan, self.fan)

    def merge(self, table: pa.Table, total: int) -> pa.Table:
        keys, _, contexts, _ = self.read(table)
        return X.sent_table(X.send(table["up"][0].as_py(), ANCHORS, ranged_counts(keys, contexts, self.below(table, total))))

    def settle(self, table: pa.Table) -> pa.Table:
        return self.answer(table, None, 0)

    def answer(self, table: pa.Table, replies: pa.Table | None, total: int) -> pa.Table:
        keys, senders, contexts, places = self.read(table)
        many, hot = senders > 1, contexts > self.most
        if replies is not None:
            elsewhere, hot = self.flags(replies, keys, self.below(table, total))
            many |= elsewhere
        blobs = [np.packbits(np.concatenate([many[of], hot[of]])).tobytes() for of in places]
        return pa.table({"chunk": table["chunk"], "part": table["part"], "seg": table["seg"], "blob": blobs}, schema=X.SENT)


class Runs:
    """The merge sort of front-coded runs: masks of repeated windows for every suffix sent."""

    def __init__(self, bits: int, fan: int, length: int, k: int) -> None:
        self.bits, self.fan, self.length, self.keys = bits, fan, length, {RUN: k, WINDOWS: length}

    def parts(self, table: pa.Table):
        """(part, anchor length, its rows)."""
        rows = table.to_pylist()
        for part, k in self.keys.items():
            if mine := [r for r in rows if r["part"] == part]:
                yield part, k, mine

    def split(self, table: pa.Table, total: int, entries: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's range on the next level, and the entries in the order of range and text."""
        ranges = X.Ranges(self.bits, total, table["seg"][0].as_py() * self.fan, self.fan)
        head = np.frombuffer(b"".join(e[0][:k] for e in entries), dtype=np.uint8).reshape(-1, k)
        seg = ranges.of(hashes_of(head) >> U64(64 - self.bits))
        return seg, np.argsort(seg, kind="stable")

    def merge(self, table: pa.Table, total: int) -> pa.Table:
        out = []
        for part, k, rows in self.parts(table):
            entries, _ = unique_entries([Run(r["blob"]) for r in rows])
            seg, order = self.split(table, total, entries, k)
            right, left = (
                np.frombuffer(b"".join(e[i].ljust(width, b"\0") for e in entries), dtype=np.uint8).reshape(-1, width) for i, width in ((0, 2 * self.length - k), (1, max(1, self.length - k)))
            )
            size, before = (np.array([len(e[i]) for e in entries], dtype=np.uint8) for i in (0, 1))
            ranks, blobs = np.array([e[2] for e in entries], dtype=np.int64), []
            for g in np.unique(seg).tolist():
                at = order[slice(*np.searchsorted(seg[order], [g, g + 1]))]
                blobs.append((g, front_coded(right[at], left[at], size[at], before[at], ranks[at])))
            out += X.send(table["up"][0].as_py(), part, blobs)
        return X.sent_table(out)

    def settle(self, table: pa.Table) -> pa.Table:
        out = [(r["chunk"], FLAGS, r["seg"], r["blob"]) for r in table.to_pylist() if r["part"] == FLAGS]
        for part, k, rows in self.parts(table):
            found = masks([r["blob"] for r in rows], self.length, k)
            out += [(r["chunk"], part, r["seg"], X.squeeze(mask)) for r, mask in zip(rows, found, strict=True)]
        return X.sent_table(out)

    def answer(self, table: pa.Table, replies: pa.Table, total: int) -> pa.Table:
        """An entry that is not its suffix's least has all its windows in a smaller document."""
        out = [(r["chunk"], FLAGS, r["seg"], r["blob"]) for r in table.to_pylist() if r["part"] == FLAGS]
        back = {(r["part"], r["seg"]): r["blob"] for r in replies.to_pylist()}
        for part, k, rows in self.parts(table):
            runs = [Run(r["blob"]) for r in rows]
            entries, places = unique_entries(runs)
            seg, order = self.split(table, total, entries, k)
            mask, least = np.zeros(len(entries), dtype=np.uint64), np.array([e[2] for e in entries])
            mask[order] = np.concatenate([X.loosen(back[part, g], np.uint64) for g in np.unique(seg).tolist()])
            whole = (U64(1) << np.array([len(e[0]) + len(e[1]) - self.length + 1 for e in entries], dtype=np.uint64)) - U64(1)
            for r, run, at in zip(rows, runs, places, strict=True):
                bits = np.where(least[at] < np.array(run.ranks), whole[at], mask[at])
                out.append((r["chunk"], part, r["seg"], X.squeeze(bits)))
        return X.sent_table(out)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, k: int = 24) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that starts in a smaller document.

    Texts are their UTF-8 bytes; matches stay within a document and are judged on the input. A
    null or short text keeps all its bytes. A null id counts as larger than any id; rows that
    share an id never repeat each other. One row for each input row: spans are the maximal
    removed runs, kept the other bytes. Columns other than the two named are not read. An
    empty table gives an empty result. ``k`` is the anchor's length: 2k <= length + 1 is not
    needed, length - k < 64 is.
    """
    if not 0 < k <= length or length - k >= 63 or 2 * length - k > 250:
        raise ValueError("anchors need 0 < k <= length < k + 63 and 2 * length - k <= 250")
    chunks = X.chunk_count(docs, text)
    levels, fan = X.fans(chunks)
    bits = min(60, max(24, math.ceil(math.log2(chunks * X.CHUNK_BYTES / 14)) + 8))
    dealt = X.chunked(docs, doc_id, text, chunks)
    ranges, anchor_counts = X.Ranges(bits, fan, 0, fan), AnchorCounts(bits, fan, HOT)
    runs_of = Runs(bits, fan, length, k)

    def send_anchors(table: pa.Table) -> pa.Table:
        found = anchors(X.documents(table)[2], length, k)
        own = found[4] >> U64(64 - bits)
        by = np.lexsort((found[5], own))
        own, context = own[by], found[5][by]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (context[1:] != context[:-1])
        keys, counts = np.unique(own[new], return_counts=True)
        return X.sent_table(X.send(table["chunk"][0].as_py(), ANCHORS, ranged_counts(keys, counts, ranges)))

    def suffixes(bodies: list[bytes], order: np.ndarray, flags: np.ndarray | None, replies: pa.Table):
        """Flags of the anchors; then document, first window and suffixes of stretches, and of hot windows."""
        found = anchors(bodies, length, k)
        own = found[4] >> U64(64 - bits)
        unique = X.distinct(own)
        if flags is None:
            flags = AnchorCounts.flags(replies, unique, ranges)
        else:
            flags = flags[: 2 * len(unique)].reshape(2, -1)
        doc, by = found[0], np.searchsorted(unique, own)
        low, high = np.full(len(unique), X.NO_ID), np.full(len(unique), -X.NO_ID)
        np.minimum.at(low, by, order[doc])
        np.maximum.at(high, by, order[doc])
        many, hot = (flags[0] | (low < high))[by], flags[1][by]
        at, wide = np.flatnonzero(many & ~hot), np.flatnonzero(many & hot)
        plain = Suffixes(bodies, order, *(x[at] for x in found[:4]), ranges.of(own[at]), length, k)
        times = found[2][wide] - found[1][wide] + 1
        of = np.repeat(wide, times)
        start = found[1][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        seg = ranges.of(window_hashes(bodies, doc[of], start, length) >> U64(64 - bits))
        windows = Suffixes(bodies, order, doc[of], start, start, start, seg, length, length)
        return flags, (doc[at], found[1][at], found[2][at], plain), (doc[of], start, start, windows)

    def send_runs(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return X.sent_table([])
        chunk = table["chunk"][0].as_py()
        _, order, bodies = X.documents(table)
        flags, plain, windows = suffixes(bodies, order, None, replies)
        rows = [(chunk, FLAGS, chunk % fan, X.squeeze(np.packbits(flags)))]
        return X.sent_table(rows + X.send(chunk, RUN, plain[3].runs()) + X.send(chunk, WINDOWS, windows[3].runs()))

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in OUT}
        if len(table):
            ids, order, bodies = X.documents(table)
            back = {(r["part"], r["seg"]): r["blob"] for r in replies.to_pylist()}
            sent = next(b for (part, _), b in back.items() if part == FLAGS)
            _, *both = suffixes(bodies, order, np.unpackbits(X.loosen(sent, np.uint8)).astype(bool), replies)
            docs_, starts, masks_ = [], [], []
            for part, (doc, first, last, own) in zip((RUN, WINDOWS), both, strict=True):
                mask = np.concatenate([np.zeros(0, np.uint64), *(X.loosen(back[part, g], np.uint64) for g in np.unique(own.segments).tolist())])
                whole = (U64(1) << (last - first + 1).astype(np.uint64)) - U64(1)
                masks_.append(np.where(own.ranks[own.of] < order[doc], whole, mask[own.of]) if len(doc) else whole)
                docs_.append(doc)
                starts.append(first)
            doc, start, mask = np.concatenate(docs_), np.concatenate(starts), np.concatenate(masks_)
            by = np.argsort(doc, kind="stable")
            doc, start, mask = doc[by], start[by], mask[by]
            edge = np.searchsorted(doc, np.arange(len(bodies) + 1))
            bit = np.arange(length - k + 1, dtype=np.uint64)
            for i, body in enumerate(bodies):
                mine = slice(edge[i], edge[i + 1])
                spans, kept, gone = [], body, 0
                if edge[i] < edge[i + 1] and mask[mine].any():
                    r, j = np.nonzero((mask[mine, None] >> bit) & np.uint64(1))
                    s = start[mine][r] + j
                    cover = np.bincount(s, minlength=len(body) + 1)[: len(body) + 1] - np.bincount(s + length, minlength=len(body) + 1)
                    covered = np.cumsum(cover[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    spans = [{"start": x, "end": y} for x, y in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)]
                    gone = int(covered.sum())
                    kept = np.frombuffer(body, dtype=np.uint8)[~covered].tobytes()
                for name, v in zip(out, (ids[i], len(body), gone, spans, kept), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=OUT)

    first = dealt.groupBy("chunk").applyInArrow(send_anchors, X.SENT_DDL)
    first = X.climb(first, levels, fan, ("seg",), anchor_counts.merge, anchor_counts.settle, anchor_counts.answer)
    second = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_runs, X.SENT_DDL)
    second = X.climb(second, levels, fan, ("seg",), runs_of.merge, runs_of.settle, runs_of.answer)
    return dealt.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(remove, RESULT)


#: The contract of the registered query, for DuckDB. Texts are cut into pieces of 200 bytes and the 49 after
#: them, as taking a part of a long string costs what is in front of it.
ORACLE = r"""
with h as (select doc_id, hex(coalesce(text, '')) as s from documents),
 pieces as (select doc_id, o, len(s) // 2 - o as left_, substr(s, 2 * o + 1, 498) as p from (select doc_id, s, unnest(range(0, len(s) // 2, 200)) as o from h)),
 win as (select doc_id, o + unnest(range(least(200, left_))) as i, unnest(list_transform(range(least(200, left_)), lambda i: substr(p, 2 * i + 1, 2))) as byte,
   unnest(list_transform(range(least(200, left_)), lambda i: case when i + 50 <= left_ then substr(p, 2 * i + 1, 100) end)) as k from pieces),
 firsts as (select k, min(doc_id) as first, max(doc_id) as last from win where k is not null group by k having min(doc_id) < max(doc_id)),
 ranked as (select win.doc_id, i, byte, coalesce(first < win.doc_id, false) as again from win left join firsts using (k)),
 told as (select *, coalesce(bool_or(again) over (partition by doc_id order by i rows between 49 preceding and current row), false) as gone from ranked),
 runs as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from told)
select h.doc_id, h.n::bigint as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (where not gone), ''))) as kept_sha256
from (select doc_id, len(s) // 2 as n from h) h left join runs using (doc_id) group by h.doc_id, h.n
"""

"""Plain versions of the contracts, for small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows, n=20):
    rows = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    out = []
    for i, w in rows:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (i, s):
                gone.update(range(s, s + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def byte_strings(rows, n=50):
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    first, out = {}, []
    for i, b in rows:
        for s in range(len(b) - n + 1):
            first.setdefault(b[s : s + n], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < i:
                gone[s : s + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def near(rows, k=3, num=85):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    inverted = {}
    for i in ids:
        for s in sets[i]:
            inverted.setdefault(s, []).append(i)
    seen = {(a, b) for v in inverted.values() for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return [(i, len(sets[i]), root(i), root(i) == i) for i in ids]

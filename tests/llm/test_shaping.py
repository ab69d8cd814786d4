"""Fill-in-the-middle, mixtures and the prefix trie against plain versions, planted cases and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fill_in_middle as M
from quillspark.llm import mixture as X
from quillspark.llm import prefix_trie as P

# --- fill in the middle ------------------------------------------------------------------------


def plain_fim(key, text):
    t, d = text or "", hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_slicing_and_restores(spark):
    r = random.Random(11)
    alphabet = "ab <PSM>é漢😀\n"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 5, 70, 600, 9000])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "<P" + ">"), (1004, "a" * 5000 + "<M>"), (1005, "é" * 100_000), (None, "no id at all"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    out = M.fill_in_middle(docs).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(str((x.id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output)) for x in out)
    assert got == sorted(str((i, *plain_fim("" if i is None else i, t))) for i, t in rows)
    assert sorted(x.back for x in out) == sorted(t or "" for _, t in rows)
    assert {x.form for x in out} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.where("false")).collect() == []


def test_markers_over_chunk_borders_are_seen():
    seen = M.Summaries()
    for chunks in ([b"x<", b"P>"], [b"x<P", b">y"], [b"x<", b"P", b">y"], [b"<S>"]):
        assert M.Located(chunks, seen).marked
    assert not M.Located([b"<", b"x", b"P>"], seen).marked


def test_shared_passages_are_counted_once():
    r = random.Random(3)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(60_000))
    seen, made = M.Summaries(), []
    for front in (b"", b"some other start ", b"x" * 777):
        data = front + passage
        ends = M.cut_points(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= M.MOST
        found = M.Located([data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], seen)
        assert found.n == len(data) and found.byte(1000) == 1000
        made.append(seen.made)
    assert made[1] - made[0] < 6 and made[2] - made[1] < 6 and made[0] > 60
    small = M.Summaries(1000)
    assert [small.of(bytes([c]) * 300)[0] for c in b"abcdefgh" * 2] == [300] * 16
    assert small.made > 8


# --- mixture -----------------------------------------------------------------------------------


def plain_targets(sizes, cap=3.0, weights=(5, 2, 1)):
    """Water level by looking at every set of capped sources."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, free = total - sum(cap * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and w[s] * rest / free > cap * sizes[s]} if free else set()
        if not above:
            return {s: cap * sizes[s] if s in capped else w[s] * rest / free for s in names}
        capped |= above


def test_targets_copies_and_reruns(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 40, 400]))), r.choice(["a", "a", "a", "é", "b", "", None])) for i in range(3000)]
    rows += [(9001, None, "zero"), (9002, "  \t\n", "zero"), (9003, "lone word", "tiny"), (None, "no id", "a"), (5, "w w", "b"), (5, "w w", "b")]
    docs = spark.createDataFrame([(*x, "clash", 2) for x in rows], "doc_id long, text string, source string, size string, rate int")
    out = X.mixture(docs).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.copies in (int(x.rate), int(x.rate) + 1) and x.copies <= 3
        taken[x.source] += x.size * x.copies
    for s, n in sizes.items():
        if n > 10_000:
            assert abs(taken[s] - want[s]) < 0.01 * n
    assert sorted(map(str, out)) == sorted(map(str, X.mixture(docs.repartition(5)).collect()))
    sent = X.emit(docs, X.mixture(docs)).groupBy("doc_id", "source").count().collect()
    wanted = {(x.id, x.source): x.copies * (2 if x.id == 5 and x.source == "b" and x.size == 2 else 1) for x in out if x.copies}
    assert all(x["count"] % wanted[(x.doc_id, x.source)] == 0 for x in sent) and {(x.doc_id, x.source) for x in sent} == set(wanted)
    assert X.mixture(docs.where("false")).collect() == []
    assert {x.copies for x in X.mixture(docs.where("source = 'zero'")).collect()} == {0}


def test_sources_are_joined_alike_however_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 50:02}" if i % 9 else None) for i in range(600)], "doc_id long, text string, source string")
    one = sorted(map(str, X.mixture(docs).collect()))
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    assert sorted(map(str, X.mixture(docs).collect())) == one
    places = X.ranked(docs.select("source").distinct(), "source").collect()
    assert [x.source for x in sorted(places, key=lambda x: x.place)] == [*sorted({x.source for x in places} - {None}), None]
    assert sorted(x.place for x in places) == list(range(51))


# --- prefix trie -------------------------------------------------------------------------------


def plain_trie(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(own.get(c - c % group, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = sum(saved[k] for k in kids[seq]) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    out = []
    for seq, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(seq))))
        out.append((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def same_trie(spark, rows):
    docs = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).withColumn("node", F.lit(1))
    assert sorted((tuple(r) for r in P.prefix_trie(docs).collect()), key=str) == plain_trie(rows)


def test_trie_matches_a_plain_one(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(60), *range(100, 130), 205, 207, 250]:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "é漢"])))
    rows += [(3, None, "user", "first of all"), (4, 50, None, None), (5, 50, "", ""), (None, 1, "user", "belongs nowhere")]
    r.shuffle(rows)
    same_trie(spark, rows)


def test_trie_with_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "PACKED", 3)
    long = [(c, t, "user", f"t{t}" if t < 40 or c != 2 else f"u{t}") for c in (0, 1, 2) for t in range(60)]
    hot = [(c, t, "user", f"same{t}") for c in range(300, 340) for t in range(4)]
    same_trie(spark, long + hot)


def test_trie_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """Two equal chains of 300 turns: components halve, so few rounds are needed."""
    rounds = []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: (rounds.append("centre" in df.columns), cut(df))[1])
    rows = [(c, t, "user", "x" * (t % 5)) for c in (100, 200) for t in range(120)]
    same_trie(spark, rows)
    assert 5 <= sum(rounds) <= 9


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert P.prefix_trie(empty).collect() == []
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    same_trie(spark, [(short, 0, "user", "gone")])  # too short for its head: turnless
    same_trie(spark, [(100, 0, "user", "x"), (100, 0, "user", "x")])

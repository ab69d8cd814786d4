"""The dedup operators against plain versions, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from llm import brute

from quillspark.llm import exchange, queries, suffix_dedup
from quillspark.llm.graph import components
from quillspark.llm.line_dedup import drop_repeated_chunks
from quillspark.llm.minhash_dedup import least_matches, near_duplicates
from quillspark.llm.substring_dedup import repeated_windows
from quillspark.llm.suffix_dedup import Run, Suffixes, masks, merged, repeated_bytes

EXTRA = "doc_id long, text string, id long, body string, chunk int, kept string, row string"


def corpus(n=60, seed=5):
    """Random words with shared passages, copies, a long text, ties, nulls and odd characters."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ñandú", "語", "The", "the"]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 80))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(passages))
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, rows[4][1] + " tail"), (1003, None), (1004, ""), (1005, " \n "), (1006, "a b"), (1007, "a b"), (1008, "x " * 3000), (1009, "A B"), (1010, "\x00" * 120 + "z")]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_substring_matches_brute_force(spark):
    rows = corpus()
    for window in (20, 3):
        got = sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in repeated_windows(frame(spark, rows), window=window).collect())
        assert got == brute.substring(rows, window)


@pytest.mark.parametrize("fan", [2, 3])
def test_substring_over_levels_of_exchange(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(exchange, "MIN_CHUNKS", 11)
    rows = corpus(n=30)
    got = sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in repeated_windows(frame(spark, rows), window=4).collect())
    assert got == brute.substring(rows, 4)


def test_blobs_grow_with_chunks_times_levels():
    for chunks in (24, 250, 1_000, 7_150, 60_000, 1 << 20, 25 << 20):
        levels, fan = exchange.fans(chunks)
        assert fan <= exchange.FAN and fan**levels >= chunks and (levels == 1 or exchange.FAN ** (levels - 1) < chunks)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    for total in (1, 7, 256):
        at = np.concatenate([exchange.Ranges(40, total * 3, first * 3, 3).of(keys) for first in range(total)])
        assert (exchange.Ranges(40, total * 3, 0, total * 3).of(keys) < total * 3).all() and len(at) == total * len(keys)


def test_suffix_matches_brute_force(spark):
    rows = corpus(seed=9)
    for length, k in ((50, 24), (12, 6)):
        got = sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in repeated_bytes(frame(spark, rows), length=length, k=k).collect())
        assert got == brute.byte_strings(rows, length)


def test_loser_tree_merges_in_order_with_shared_prefixes():
    r = random.Random(3)
    import numpy as np

    bodies = [bytes(r.choices(b"ab", k=400)) for _ in range(4)]
    runs = []
    for d, body in enumerate(bodies):
        first = np.arange(0, 300, 7)
        s = Suffixes([body], np.array([d]), np.zeros(len(first), np.int64), first, first + 3, first + 2, np.zeros(len(first), np.int64), 12, 6)
        runs += [run for _, run in s.runs()]
    read = [Run(x) for x in runs]
    out = [(read[w].rights[i], shared) for w, i, shared in merged(read)]
    assert [x for x, _ in out] == sorted(x for run in read for x in run.rights)
    for (a, _), (b, shared) in zip(out, out[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared == n
    assert sum(int(m.sum()) > 0 for m in masks(runs, 12, 6)) > 0


def near_corpus():
    rows = corpus(seed=11)
    r = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"edit{i}"
        rows.append((2000 + i, " ".join(words).upper() if i % 2 else " ".join(words)))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    for k, percent in ((3, 85), (5, 80)):
        got = sorted(tuple(x) for x in near_duplicates(frame(spark, rows), words=k, percent=percent).collect())
        assert got == brute.near(rows, k, percent)


def test_near_duplicates_in_small_blocks(spark):
    """A group dealt to many block pairs loses no link."""
    rows = near_corpus()
    got = sorted(tuple(x) for x in near_duplicates(frame(spark, rows), words=3, percent=85, block=8).collect())
    assert got == brute.near(rows, 3, 85)


def twisted(n):
    """Two different words that every polynomial hash modulo 2**64 takes for the same."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_defeat_plain_polynomials(spark, n):
    a, b = twisted(n)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words[:10], x, *words[10:]]) for x in (a, b)] + [" ".join([*words[:5], b, *words[5:]]), a, b, f"{a} {a} {a} {a}", f"{b} {b} {b} {b}"]
    rows = list(enumerate(texts))
    assert sorted(tuple(x) for x in near_duplicates(frame(spark, rows), words=3, percent=85).collect()) == brute.near(rows)
    got = sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in repeated_windows(frame(spark, rows)).collect())
    assert got == brute.substring(rows)


def test_links_that_miss_the_least_id_of_a_band(spark):
    """Chains in which neighbours are alike and the ends are not; two groups around each other."""
    r = random.Random(21)
    base, rows = [f"c{i}" for i in range(100)], []
    for i in range(60):
        base[r.randrange(100)] = f"new{i}"
        rows.append((5000 - 7 * i, " ".join(base)))
    for g in range(2):
        words = [f"d{i}" for i in range(100)]
        words[: 9 * g] = [f"g{i}" for i in range(9 * g)]
        rows += [(9000 + 2 * i + g, " ".join(words[:99] + [f"end{g}{i}"])) for i in range(30)]
    for block in (4, 1024):
        got = sorted(tuple(x) for x in near_duplicates(frame(spark, rows), words=3, percent=85, block=block).collect())
        assert got == brute.near(rows)
        assert len({x[2] for x in got if x[0] < 9000}) < 30


def test_bayes_bounds_keep_what_is_likely():
    bounds = least_matches(0.85, 1e-5)
    assert [n for n, _ in bounds] == [25, 50, 75, 100, 125]
    assert all(0.5 < m / n < 0.85 for n, m in bounds[1:])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 202), (200, 203)]
    got = {r.id: r.component for r in components(frame(spark, links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 90, 95: 90} | {201: 200, 202: 200, 203: 200}
    assert components(frame(spark, [], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [repeated_windows, repeated_bytes, near_duplicates, drop_repeated_chunks])
def test_edge_cases(spark, run):
    """Nulls in any column, repeated rows, clashing names, empty tables."""
    text = "one two three four five six seven eight nine ten " * 3 + "\nline a\nline b\n" + "z" * 60
    rows = [(1, text, 5, "b", 1, "k", "r"), (1, text, None, None, None, None, None), (None, text, 1, "", 2, "", ""), (None, None, 1, "", 2, "", ""), (2, text, 1, "", 2, "", ""), (3, "", 1, "", 2, "", "")]
    out = run(frame(spark, rows, EXTRA))
    assert out.count() == len(rows)
    assert run(frame(spark, [], EXTRA)).count() == 0


def test_ids_shared_or_missing(spark):
    text = " ".join(f"u{i}" for i in range(40))
    got = {(r.id, r.n_removed) for r in repeated_windows(frame(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()}
    assert got == {(1, 0), (2, 40), (None, 40)}
    got = {(r.id, r.component_id, r.kept) for r in near_duplicates(frame(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True)}


@pytest.mark.parametrize(("fan", "hot"), [(256, 1), (2, 4096), (3, 2)])
def test_suffix_over_levels_and_hot_anchors(spark, monkeypatch, fan, hot):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(exchange, "MIN_CHUNKS", 11)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(12)
    phrase = " a common phrase of every document in this test, and quite long "
    rows = [(7 * i % 50, "".join(r.choices("abcdefgh ", k=60)) + phrase + r.choice(["", "ab", "tail of some"]) + "".join(r.choices("abcdefgh ", k=60))) for i in range(40)]
    rows += corpus(n=12, seed=4) + [(2000, rows[3][1]), (1999, rows[3][1][20:]), (2001, "\0" * 200), (2002, "\0" * 90)]
    rows = list({i: (i, t) for i, t in rows}.values())
    for length, k in ((50, 24), (12, 6)):
        got = sorted((x.id, x.n_bytes, x.n_removed, len(x.spans), sha(bytes(x.kept))) for x in repeated_bytes(frame(spark, rows), length=length, k=k).collect())
        assert got == brute.byte_strings(rows, length)


def test_line_chunks_are_shift_resistant(spark):
    body = "\n".join(f"shared line number {i}" for i in range(30))
    rows = [(1, "top\n" + body), (2, "another\nhead\n" + body + "\nend"), (3, "\n\n\n\n"), (4, "\n\n\n\n")]
    got = {r.row.doc_id: r for r in drop_repeated_chunks(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 20
    assert got[2].kept.startswith("another\nhead") and got[2].kept.endswith("end")
    assert got[4].n_removed == 0 and got[4].kept == "\n\n\n\n"


def test_queries_match_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op2_suffix_dedup(spark, sf).collect()) == brute.byte_strings(rows)
    assert sorted(tuple(r) for r in queries.op3_minhash_dedup(spark, sf).collect()) == brute.near(rows)
    assert sorted(tuple(r) for r in queries.op6_substring_dedup(spark, sf).collect()) == brute.substring(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE[name])
    columns = [c for c in want.columns if c in got.columns]
    assert sorted(columns) == sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())

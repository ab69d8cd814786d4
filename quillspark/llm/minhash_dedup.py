"""MinHash near-duplicates with sequential Bayesian verification.

1. Rows of equal shingle sets collapse to one class, whose least id stands for it.
2. Classes that share a signature band are banded pairs. A pair's signatures are compared in
   batches: given m of n equal values, the posterior of the similarity under a flat prior is
   Beta(m + 1, n - m + 1), and the pair is dropped once the chance that it reaches the
   threshold is below ``miss``. Survivors are verified on the words of both texts.
3. First each band's members are held against its least id, which is linear in their number
   and settles groups of near copies. What is left are pairs of a band whose two sides are not
   connected by then; they are compared block by block. A pair that is connected already adds
   nothing and is not looked at. Texts are fetched for rows of surviving pairs alone.
"""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.exchange import distinct
from quillspark.llm.graph import components, cut_lineage
from quillspark.llm.text_hash import U64, Rolling, Words, mix, slabs

BANDS, ROWS = 25, 5
BLOCK = 1024  # rows of a block
BLOCK_BYTES = 4 << 20  # and bytes of their texts
BATCH = 25
SIGNED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SIGNED_DDL = "id long, n_bytes long, n_shingles long, digest binary, bands array<long>, sig binary"
UNITS_DDL = "place int, unit long, i int, j int, side int, hub boolean, label long, id long, n_shingles long, bands array<long>, sig binary"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: list[bytes], k: int, rolling: Rolling):
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; modulo a prime, then mixed."""
    for lo, hi in slabs([len(t) for t in texts]):
        w = Words(texts[lo:hi])
        h = w.hashes(rolling, 0, lower=True)
        windows = rolling.fixed(h, k, 1)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                yield distinct(windows[a : b - k + 1])
            elif b > a:
                yield rolling.ranges(h[a:b], np.array([0]), np.array([b - a]), 1)
            else:
                yield np.zeros(0, dtype=U64)


def signatures(k: int):
    """mapInArrow function: id, size of text and set, 128-bit digest of the set, band keys, 16-bit signature."""

    def run(batches):
        rolling = Rolling()
        factor = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
        band = mix(np.arange(1, ROWS + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in SIGNED}
            ids, texts = batch["id"].to_pylist(), batch["body"].to_pylist()
            for doc, text, s in zip(ids, texts, shingle_sets(texts, k, rolling), strict=True):
                row = [doc, len(text), len(s), b"", [], b""]
                if len(s):
                    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=U64)
                    for at in range(0, len(s), 4096):
                        np.minimum(least, (s[at : at + 4096, None] * factor).min(axis=0), out=least)
                    least = mix(least)
                    keys = mix((least.reshape(BANDS, ROWS) * band).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
                    row[3:] = [blake2b(s.tobytes(), digest_size=16).digest(), keys.astype(np.int64), (least & U64(0xFFFF)).astype(np.uint16).tobytes()]
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            yield from pa.table(out, schema=SIGNED).to_batches()

    return run


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n compared, least matches) after each batch: fewer leave P(similarity >= threshold) < miss."""
    found = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                found.append((n, m))
                break
    return found


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as numbers that are equal for equal words only.

    Texts of fewer than ``k`` words get an empty set: they equal no other class.
    """
    w = Words(texts)
    buf = np.where((w.buf >= 65) & (w.buf <= 90), w.buf + 32, w.buf).astype(np.uint8)
    letters = np.zeros(len(buf) + 1, dtype=np.int8)
    letters[w.starts] += 1
    letters[w.ends] -= 1
    data = buf[np.cumsum(letters[:-1]) > 0].tobytes()
    offsets = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    code, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    key, size = code, many
    for j in range(1, k):
        if size * many >= 1 << 62:
            unique, key = np.unique(key, return_inverse=True)
            size = len(unique)
        key, size = key[:-1] * many + code[j:], size * many
    return [distinct(key[a : b - k + 1]) if b - a >= k else key[:0] for a, b in zip(w.first, w.first[1:])]


def surviving(rows: dict[str, np.ndarray], unit: int, percent: int, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right, equal values) of one unit that the posterior bound does not drop.

    A unit with hubs pairs them with the other rows; any other one pairs rows of different
    labels and, between two blocks, of different sides, if ``unit`` is the first band they share.
    """
    size, label, side, bands, sigs = (rows[c] for c in ("n_shingles", "label", "side", "bands", "sig"))
    hubs = np.flatnonzero(rows["hub"])
    two = (side != side[0]).any()
    left, right, score = [], [], []
    for i in hubs.tolist() or range(len(size) - 1):
        if len(hubs):
            j = np.flatnonzero((label != label[i]) & ~rows["hub"])
        else:
            j = np.arange(i + 1, len(size))
            j = j[label[j] != label[i]]
            if two:
                j = j[side[j] != side[i]]
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        if not len(hubs) and len(j):
            first = (bands[j] == bands[i]).argmax(axis=1)
            j = j[(bands[i][first] == unit) & (bands[j, first] == unit)]
        matches, at = np.zeros(len(j), dtype=np.int64), 0
        for n, least in bounds:
            matches += (sigs[j, at:n] == sigs[i, at:n]).sum(axis=1)
            keep = matches >= least
            j, matches, at = j[keep], matches[keep], n
        left.append(np.full(len(j), i))
        right.append(j)
        score.append(matches)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, score))


def units_of(table: pa.Table):
    """(unit, its rows in the table) of what a task got together."""
    keys = [table[c].to_numpy() for c in ("id", "side", "j", "i", "unit")]
    by = np.lexsort(keys)
    change = np.zeros(len(by), dtype=bool)
    change[:1] = True
    for k in keys[2:]:
        change[1:] |= k[by][1:] != k[by][:-1]
    cuts = np.append(np.flatnonzero(change), len(by))
    for a, b in zip(cuts, cuts[1:]):
        yield int(keys[4][by[a]]), by[a:b]


def columns(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.combine_chunks()
    rows = {c: table[c].to_numpy() for c in ("n_shingles", "label", "side", "hub", "id")}
    rows["bands"] = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), BANDS)
    rows["sig"] = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(len(table), BANDS * ROWS)
    return rows


def verified(rows: dict[str, np.ndarray], texts: list[bytes], unit: int, words: int, percent: int, bounds) -> list[tuple[int, int]]:
    """Links of one unit that span what is not connected yet, the most similar first."""
    left, right, score = surviving(rows, unit, percent, bounds)
    if not len(left):
        return []
    sets, links, up = exact_sets(texts, words), [], {x: x for x in rows["label"].tolist()}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    label, ids = rows["label"].tolist(), rows["id"].tolist()
    for p in np.argsort(-score, kind="stable").tolist():
        a, b = int(left[p]), int(right[p])
        ra, rb = root(label[a]), root(label[b])
        if ra != rb:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[rb] = ra
                links.append((ids[a], ids[b]))
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id, kept: linked are sets with 100 * |a & b| >= percent * |a | b|.

    A set holds the distinct ``words``-word shingles of the text, A-Z lower-cased; a shorter
    text is one shingle; a null or blank text has none and is linked with nothing. The banding
    (25 bands of 5) finds a pair with probability above 1 - 5e-5 at 0.8, 1 - 1e-6 at 0.85.
    component_id is the smallest id reachable. Rows that share an id are one node with all
    their links. A row without an id is never linked: its component_id is null, it is kept.
    Columns other than the two named are not read. An empty table gives an empty result.

    A band of any size is dealt to pairs of blocks of bounded size (one text longer than
    BLOCK_BYTES is a block of its own); no pair is emitted but the links that span a block.
    Within a band, the rows of the most frequent label are not compared with each other again.
    """
    bounds = least_matches(percent / 100, miss)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    signed = cut_lineage(source.mapInArrow(signatures(words), SIGNED_DDL))
    real = signed.where("n_shingles > 0 and id is not null")
    classes = real.groupBy("digest").agg(F.min("id").alias("rep"))
    copies = real.select("id", "digest").join(classes, "digest").where("id > rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = real.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")

    banded = reps.select("id", "n_bytes", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("band", "first")
    members = cut_lineage(banded.join(shared, "band").where("id > first"))
    # Texts are taken from the table once, for members of bands alone; both passes read these.
    ids = members.select("id").unionAll(members.select(F.col("first").alias("id"))).distinct()
    texts = cut_lineage(source.join(ids, "id", "left_semi"))

    def blocks(rows: str, size: str):
        return F.ceil(F.greatest(F.col(rows) / block, F.col(size) / BLOCK_BYTES)).cast("int")

    def compared(units: DataFrame) -> DataFrame:
        """Links of units: unit, i, j, side, hub, label, id, n_bytes."""
        rows, size = units.agg(F.count("*"), F.sum("n_bytes")).first()
        places = max(1, rows // (2 * block), (size or 0) // (2 * BLOCK_BYTES))
        placed = units.drop("n_bytes").withColumn("place", F.pmod(F.xxhash64("unit", "i", "j"), F.lit(places)).cast("int"))
        signs = placed.join(reps.select("id", "n_shingles", "bands", "sig"), "id").select(*[x.split()[0] for x in UNITS_DDL.split(", ")])

        def prune(table: pa.Table) -> pa.Table:
            rows, live = columns(table), np.zeros(len(table), dtype=bool)
            for unit, at in units_of(table):
                left, right, _ = surviving({k: v[at] for k, v in rows.items()}, unit, percent, bounds)
                live[at[left]] = live[at[right]] = True
            return table.filter(pa.array(live))

        def verify(table: pa.Table) -> pa.Table:
            rows, bodies, found = columns(table), table["body"].combine_chunks(), []
            for unit, at in units_of(table):
                found += verified({k: v[at] for k, v in rows.items()}, bodies.take(pa.array(at)).to_pylist(), unit, words, percent, bounds)
            return pa.table({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=LINKS)

        alive = signs.groupBy("place").applyInArrow(prune, UNITS_DDL)
        return alive.join(texts, "id").groupBy("place").applyInArrow(verify, "a long, b long")

    star = members.select(F.col("first").alias("unit"), "id", "n_bytes").distinct()
    salts = star.groupBy("unit").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size")).select("unit", blocks("n", "size").alias("salts"))
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    flag, zero = lambda hub: F.lit(hub).alias("hub"), F.lit(0)
    spokes = star.join(salts, "unit").select("unit", salt.alias("i"), flag(False), "id", "n_bytes")
    hubs = salts.select("unit", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("i"), flag(True), F.col("unit").alias("id"), F.lit(0).cast("long").alias("n_bytes"))
    links = cut_lineage(compared(spokes.unionAll(hubs).select("unit", "i", F.col("i").alias("j"), zero.alias("side"), "hub", F.col("id").alias("label"), "id", "n_bytes")))
    known = components(links)

    labelled = members.join(known, "id", "left").select("band", "id", "n_bytes", F.coalesce("component", "id").alias("label"))
    per = labelled.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    top = F.max(F.struct("n", "size", "label"))
    open_bands = per.groupBy("band").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("size").alias("size"), top.alias("top")).where("labels > 1")
    open_bands = open_bands.select("band", F.col("top.label").alias("main"), F.col("top.n").alias("n_main"), F.col("top.size").alias("s_main"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("size") - F.col("top.size")).alias("s_rest"))
    dealt = labelled.join(open_bands.select("band", "main", blocks("n_rest", "s_rest").alias("rest"), blocks("n_main", "s_main").alias("mains")), "band")
    is_main, spread = F.col("label") == F.col("main"), F.xxhash64("id")
    own = F.when(is_main, F.col("rest") + F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("rest"))).cast("int")
    others = F.explode(F.sequence(zero, F.when(is_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)))
    pairs = dealt.select("band", own.alias("side"), others.alias("other"), "label", "id", "n_bytes")
    more = compared(cut_lineage(pairs.select(F.col("band").alias("unit"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", flag(False), "label", "id", "n_bytes")))
    edges = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labels = components(edges.unionAll(more).unionAll(copies))
    return signed.select("id", "n_shingles").join(labels, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("id")), F.lit(True)).alias("kept")
    )


#: The contract of the registered query, for DuckDB.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
 sets as (select doc_id, case when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as s from w where len(ws) > 0),
 items as (select doc_id, len(s) as n, unnest(s) as x from sets),
 pairs as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from items a join items b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
 links as materialized (select a, b from pairs where 100 * c >= 85 * (na + nb - c)),
 edges as materialized (select a, b from links union all select b, a from links),
 reach(id, r) as (select doc_id, doc_id from documents union select e.b, reach.r from reach join edges e on e.a = reach.id)
select d.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, m.component as component_id, m.component = d.doc_id as kept
from documents d left join sets s using (doc_id) join (select id, min(r) as component from reach group by id) m on m.id = d.doc_id
"""

"""The prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Turns are digests from the first scan on; no text is shuffled. A conversation's turns are numbered
by a range sort over all turns, and the digest of each prefix is chained in blocks of BLOCK turns, so
that no conversation, however long, stands in one task. Equal prefix digests are one node.

Nodes of one member hang below the shared ones as chains that add one leaf and save nothing;
what is rolled up is the forest of shared nodes below the root. Its weights are known without a
rollup: a node's subtree holds as many rows of the table of prefixes as its members have turns from
there on. In each round every component is split at its centroid: the deepest node with at least the
largest power of two in the component's weight. What is below it and what is left above
have less than that power, so there are at most log2(turns) rounds. A centroid's total is aggregated
over the part of its component below it, and added along the path from the centroid to the
component's top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.graph import cut_lineage

BLOCK = 256
#: Ids of members that end at one node are packed into strings of so many before they meet.
PACKED = 4096
DIGEST = 16


def _short(x: Column) -> Column:
    """The first 128 bits of the SHA-256 of some bytes."""
    return F.unhex(F.substring(F.sha2(x, 256), 1, 2 * DIGEST))


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _chained(turns: pa.Array) -> pa.Array:
    """For each array of digests the digests of its prefixes."""
    out = []
    for row in turns.to_pylist():
        state, found = b"", []
        for turn in row:
            state = _hash(state + turn)
            found.append(state)
        out.append(found)
    return pa.array(out, pa.list_(pa.binary()))


def _before_blocks(last: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, before: the digest of all blocks in front, from rows sorted by both."""
    conv, state = None, b""
    for batch in last:
        rows = []
        for c, b, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                conv, state = c, None
            rows.append((c, b, state))
            state = d if state is None else _hash(state + d)
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "block", "before"])


def numbered_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 0), dig, len and the conversation's n for each turn.

    The range sort's keys hold turn and digest, so a conversation of any length is spread; rows are
    counted by conversation and partition, and counts of the partitions in front are added.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    dig = _short(F.concat(F.octet_length(words[0]).cast("string"), F.lit(":"), words[0], words[1]).cast("binary"))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), dig.alias("dig"), F.length(words[1]).cast("long").alias("len"))
    order = ["conv", F.col("turn").asc_nulls_first(), "dig"]
    rows = cut_lineage(rows.orderBy(*order).select("conv", "dig", "len")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return rows.join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "dig", "len", "n")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """conv, depth, dig, len, total of rebuilt turns; and conv, total of each conversation.

    The first h turns are those of the group's first conversation, h = crc32(conv) % most; own
    turns follow after as many own ones.
    """
    ids = turns.where("pos = 0").select("conv", "n")
    named = ids.withColumn("head", F.col("conv") - F.col("conv") % group).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    heads = ids.where(F.col("conv") % group == 0).select(F.col("conv").alias("head"), F.col("n").alias("have"))
    named = named.join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("have", F.lit(0))))
    named = cut_lineage(named.select("conv", "head", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")))

    # One row of a conversation's numbers for each block of its turns: a long one is many keys.
    spread = named.join(ids, "conv").select("conv", "h", "k", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("own"))
    own = turns.withColumn("own", F.floor(F.col("pos") / BLOCK)).join(spread, ["conv", "own"]).where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "dig", "len", "total")
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most)).select(F.col("conv").alias("head"), "pos", "dig", "len")
    given = named.where("k > 0").join(first, "head").where("pos < k").select("conv", (F.col("pos") + 1).alias("depth"), "dig", "len", "total")
    return own.unionAll(given), named.select("conv", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, len, total, node and parent: digests of the prefix and of the one before (null at depth 1)."""
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    in_order = F.array_sort(F.collect_list(F.struct("depth", "dig", "len")))
    blocks = rows.groupBy("conv", "block").agg(in_order.alias("t"), F.max("total").alias("total"))
    blocks = cut_lineage(blocks.withColumn("inner", _chained(F.col("t.dig"))).select("conv", "block", "total", F.col("t.len").alias("lens"), "inner"))
    many = F.col("total") > BLOCK
    ends = blocks.where(many).select("conv", "block", F.element_at("inner", -1).alias("d")).repartition("conv").sortWithinPartitions("conv", "block")
    before = ends.mapInArrow(_before_blocks, "conv long, block long, before binary")
    one, more = blocks.where(~many).withColumn("before", F.lit(None).cast("binary")), blocks.where(many).join(before, ["conv", "block"])
    both = one.unionByName(more)
    node = F.transform("inner", lambda x: F.when(F.col("before").isNull(), x).otherwise(_short(F.concat(F.col("before"), x))))
    both = both.select("conv", "block", "total", "lens", "before", node.alias("nodes"))
    each = both.select("conv", "block", "total", "before", "nodes", F.posexplode("lens").alias("i", "len"))
    parent = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("nodes", F.col("i") - 1))
    return each.select("conv", (F.col("block") * BLOCK + F.col("i") + 1).alias("depth"), "len", "total", F.get("nodes", F.col("i")).alias("node"), parent.alias("parent"))


def rolled_up(shared: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """node and the sums of ``values`` over its subtree, by centroid decomposition.

    shared: node, top (its ancestor at depth 1), conv and depth (a member and its turns: a place on
    the node's path), weight (of the subtree) and the values. paths: conv, depth, node, parent of
    each prefix of those members. A component is named by its topmost node. Each round joins
    each node with its component's centroid and one row of paths, which tells where it stands:

    * deeper than the centroid, the row is its ancestor just below the centroid's depth: if that
      one's parent is the centroid, the node is below it, in the component of that ancestor;
    * otherwise the row is the centroid's ancestor at the node's depth: if that is the node itself,
      it is on the path to the top, and loses the centroid's weight.
    """
    at = paths.select(F.col("conv").alias("pc"), F.col("depth").alias("pd"), F.col("node").alias("pn"), F.col("parent").alias("pp"))
    open_, totals, added = cut_lineage(shared.withColumnRenamed("top", "part")), [], []
    while not open_.isEmpty():
        order = F.struct(F.length(F.bin("weight")).alias("e"), "depth", "node", "conv", "weight")
        centres = open_.groupBy("part").agg(F.max(order).alias("c"))
        here = open_.join(centres, "part")
        deeper = F.col("depth") > F.col("c.depth")
        here = here.withColumn("pc", F.when(deeper, F.col("conv")).otherwise(F.col("c.conv"))).withColumn("pd", F.when(deeper, F.col("c.depth") + 1).otherwise(F.col("depth")))
        here = here.join(at, ["pc", "pd"])
        is_it = F.col("node") == F.col("c.node")
        where = F.when(is_it, "it").when(deeper & F.col("pp").eqNullSafe(F.col("c.node")), "below").when(~deeper & (F.col("pn") == F.col("node")), "above").otherwise("beside")
        here = here.select("node", "part", "conv", "depth", "weight", *values, F.col("c.node").alias("centre"), F.col("c.weight").alias("less"), F.when(deeper, F.col("pn")).alias("under"), where.alias("place"))
        here = cut_lineage(here)
        totals.append(here.where("place in ('it', 'below')").groupBy("centre").agg(*[F.sum(v).alias(v) for v in values]))
        added.append(here.where("place in ('it', 'above')").select("node", "centre"))
        part = F.when(F.col("place") == "below", F.col("under")).otherwise(F.col("part"))
        weight = F.when(F.col("place") == "above", F.col("weight") - F.col("less")).otherwise(F.col("weight"))
        open_ = here.where("place <> 'it'").select("node", part.alias("part"), "conv", "depth", weight.alias("weight"), *values)
    if not totals:
        return shared.select("node", *values)
    joined = reduce(DataFrame.unionAll, added).join(reduce(DataFrame.unionAll, totals), "centre")
    return joined.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, first, ids: runs of sorted ids of a node as strings of at most PACKED."""
    node, run = None, []
    out: list[tuple] = []

    def closed() -> Iterator[pa.RecordBatch]:
        if run:
            out.append((node, run[0], ",".join(map(str, run))))
            run.clear()
        if len(out) >= 1024:
            yield from flushed()

    def flushed() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])
            out.clear()

    for batch in rows:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node or len(run) >= PACKED:
                yield from closed()
                node = n
            run.append(c)
    yield from closed()
    yield from flushed()


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends: the SHA-256 over a node's strings, which come in order and are read one after the other."""
    node, state = None, None
    for batch in rows:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends: SHA-256 over the sorted ids (conv) of those that end at each node, joined by commas.

    A range sort spreads the ids of a hot node; what then meets in one task is a string for every
    PACKED of them, hashed as it streams by, since SHA-256 has to see them in order.
    """
    packed = ends.select("node", "conv").orderBy("node", "conv").mapInArrow(_packed, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node.

    Turns are ordered by ``turn``, null first; those that tie by the digest of role and text. A null
    role or text is an empty one. Rows of a null conversation belong to none and are left out.
    Repeated rows are turns of their own. Conversations are rebuilt as in ``rebuilt``. Other columns
    are not looked at, whatever their names. A table without conversations has no node.
    """
    turns = cut_lineage(numbered_turns(conversations, conv_id, turn, role, text))
    rows, convs = rebuilt(turns, group, most)
    paths = cut_lineage(prefixes(rows))
    later = F.sum(F.col("total") - F.col("depth") + 1)
    nodes = paths.groupBy("node").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.count("*").alias("n"), F.first("len").alias("len"), F.first("parent").alias("parent"), later.alias("weight"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.count_if(F.col("n") == 1).alias("tails"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["children", "tails"])
    nodes = cut_lineage(nodes.withColumn("leaves", F.col("tails") + (F.col("children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("len")))

    shared = nodes.where("n > 1")
    known = shared.select(F.col("node").alias("__n"))
    members = shared.select(F.col("conv").alias("__c")).distinct()
    slim = paths.select("conv", "depth", "node", "parent")
    slim = cut_lineage(slim.join(known, slim["node"] == known["__n"], "left_semi").join(members, slim["conv"] == members["__c"], "left_semi"))
    tops = slim.where("depth = 1").select("conv", F.col("node").alias("top"))
    forest = shared.join(tops, "conv").select("node", "top", "conv", "depth", "weight", "leaves", "saved")
    sums = rolled_up(forest, slim, ["leaves", "saved"]).withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"})

    last = paths.where("depth = total").select("node", "conv").unionAll(convs.where("total = 0").select(F.lit(b"").alias("node"), "conv"))
    ends = ends_digests(last)
    above = nodes.where("children > 0").select(F.col("node").alias("key"), F.col("conv").alias("parent_conv"))
    keyed = nodes.withColumn("key", F.coalesce("parent", "node"))  # null keys would meet in one task; what they find is not used
    each = keyed.join(sums, "node", "left").join(ends, "node", "left").join(above, "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    each = each.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv", "parent", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.coalesce("all_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("all_saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("children") == 0).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    empty = ends.where(F.octet_length("node") == 0).agg(F.max("ends").alias("ends"))
    lone = root.join(F.broadcast(below)).join(F.broadcast(empty))  # one row each
    lone = lone.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
    top = root.select(F.col("conv_id").alias("__root"))
    each = each.join(F.broadcast(top)).withColumn("parent_conv_id", F.when(F.col("parent").isNull(), F.col("__root")).otherwise(F.col("parent_conv")))
    return lone.unionByName(each.select(*lone.columns))


_BITS = "flatten(list_transform(string_split(conv_id::varchar, ''), lambda ch: list_transform(range(0, 8), lambda b: (ascii(ch) >> b::int) & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform({_BITS}, lambda b: b::bigint)), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
ORACLE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
own as (select conv_id, pos, md5(length(role) || ':' || role || text) as d, length(text)::bigint as len from turns),
ids as (select conv_id, {_CRC} % 6 as h from (select distinct conv_id from turns)),
mixed as (
  select i.conv_id, pos, d, len from ids i join own o on o.conv_id = i.conv_id - i.conv_id % 100 where pos < h
  union all select i.conv_id, pos, d, len from ids i join own o on o.conv_id = i.conv_id where pos >= h),
paths as (select conv_id, string_agg(d, '' order by pos) as k, list(len order by pos) as lens from mixed group by conv_id),
whole as (select ids.conv_id, coalesce(k, '') as k, coalesce(lens, []) as lens from ids left join paths on ids.conv_id = paths.conv_id),
steps as (select conv_id, k, lens, unnest(range(0, len(lens) + 1)) as d from whole),
nodes as (
  select substr(k, 1, 32 * d) as node, d as depth, min(conv_id) as conv_id, count(*) as n, any_value(coalesce(lens[d], 0)) as len,
    string_agg(case when length(k) = 32 * d then conv_id::varchar end, ',' order by conv_id) as ends from steps group by 1, 2),
kids as (select substr(node, 1, 32 * (depth - 1)) as node, count(*) as c from nodes where depth > 0 group by 1),
full_ as (select n.*, coalesce(c, 0) as c from nodes n left join kids k on n.node = k.node),
under as (
  select v.node, sum(case when u.c = 0 then 1 else 0 end) as leaves, sum((u.n - 1) * u.len) as saved from full_ v join full_ u on starts_with(u.node, v.node) group by v.node)
select f.conv_id, f.depth::bigint as depth, case when f.depth > 0 then p.conv_id end as parent_conv_id, f.n as n_convs, f.c as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
  sha256(coalesce(f.ends, '')) as ends_sha256
from full_ f join under u on f.node = u.node left join full_ p on p.node = substr(f.node, 1, 32 * (f.depth - 1)) and p.depth = f.depth - 1
"""

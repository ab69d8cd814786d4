"""Mixing sources to target weights, in DataFrame functions only.

Words are counted once for each document; a table of sources (one row each) then gets targets, and
each document is emitted floor(rate) times, plus once more if its hash falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Numbered hashes of which each source takes the one whose copies come nearest its target.
SEEDS = 32
#: Up to so many bytes of source names the table of sources is broadcast; beyond, it is joined by shuffles.
BROADCAST_BYTES = 4 << 20
SALTS = 64


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, 0, 1, ... in the order of the key by code points, null last.

    Rows are range-sorted and counted by partition; only the counts, a row for each partition, are
    summed in one place.
    """
    rows = cut_lineage(sources.orderBy(F.col(key).asc_nulls_last())).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = rows.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    steps = F.array_sort(F.collect_list(F.struct("__part", "__n", "__first")))
    before = parts.agg(steps.alias("s")).select(F.posexplode("s").alias("i", "p"), "s")
    before = before.select("p.__part", "p.__first", F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["__n"]).alias("__before"))
    return rows.join(before, "__part").withColumn("place", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def shared_out(sources: DataFrame, cap: float) -> DataFrame:
    """Adds ``target`` to rows of source_size and weight: all sizes shared out by weight, ``cap`` times a size at most.

    The excess of sources at their cap goes to the others by weight, until none is above. Each
    round looks at the sources by one aggregate and caps at least one more; rounds follow the
    spread of size to weight, not the number of sources.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most, level = F.col("source_size") * F.lit(float(cap)), 0.0
    while True:
        free = most > F.col("weight") * F.lit(level)
        used, weight = sources.agg(F.sum(F.when(~free, F.col("source_size"))), F.sum(F.when(free, F.col("weight")))).first()
        rest = total - cap * (used or 0)
        higher = rest / weight if weight else level
        if not weight or higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _draws(key: Column) -> list[Column]:
    """SEEDS numbers from 0 to below 1: groups of eight hex digits of SHA-256 hashes of the key."""
    digests = F.array(*[F.sha2(F.concat(F.lit(f"{i}:"), key), 256) for i in range(SEEDS // 8)])
    return [F.conv(F.substring(F.get(digests, F.lit(k // 8)), 8 * (k % 8) + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) for k in range(SEEDS)]


def _beside(rows: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """Rows with their source's columns: the sources broadcast while small, else salted, so that a hot source is many keys."""
    if size <= BROADCAST_BYTES:
        named = F.broadcast(sources.withColumnRenamed("source", "__source"))
        return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    salted = sources.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__mine", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__mine") == F.col("__salt"))).drop("__source", "__salt", "__mine")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """id, source, size, source_size, target, rate, copies for each row.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the text, 0 if null. Sources in the order
    of code points, a null source last as one of its own, take the weights in turn. ``target`` is
    what the source shall give of the sum of all sizes, ``rate`` is target over source size (0 for
    a source without words), and ``copies`` is floor(rate) or one more, so cap at most. The extra
    copy falls to a row if a number drawn from its id is below the fraction; of SEEDS draws
    that all ids share, each source uses the one whose words come nearest its target, the first
    of equals. Rows that share an id and source are copied alike; a null id draws as an empty
    string. Other columns are not looked at, whatever their names. An empty table gives an empty result.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut_lineage(docs.select(F.col(doc_id).alias("id"), key.alias("key"), F.col(source).alias("source"), words.alias("size")))
    sums = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = cut_lineage(sums.select("source", "source_size", weight.alias("weight")))
    bytes_ = sources.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = shared_out(sources, cap).withColumn("rate", F.least(rate, F.lit(float(cap)))).drop("weight")

    drawn = _beside(rows, sources, bytes_).withColumn("draws", F.array(*_draws(F.col("key"))))
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    once = drawn.withColumn("extra", F.transform("draws", lambda u: F.when(u < part, F.col("size")).otherwise(F.lit(0).cast("long"))))
    sums = [F.coalesce(F.sum(F.get("extra", F.lit(k))), F.lit(0)) for k in range(SEEDS)]
    missed = once.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("n"), F.first("rate").alias("rate"), F.array(*sums).alias("taken"))
    off = F.transform("taken", lambda x, k: F.struct(F.abs(F.col("target") - whole * F.col("n") - x).alias("off"), k.alias("k")))
    chosen = cut_lineage(missed.select("source", F.array_min(off)["k"].alias("seed")))
    chosen = chosen.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    out = _beside(rows, chosen, bytes_).withColumn("draws", F.array(*_draws(F.col("key"))))
    copies = (whole + F.when(F.get("draws", "seed") < part, 1).otherwise(0)).cast("long")
    return out.select("id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def emit(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mixture takes them, with ``copy_no`` from 1; those taken never are left out.

    Rows that share id and source have one number of copies.
    """
    plan = mixed.select(F.col("id").alias("__id"), F.col("source").alias("__source"), "copies").where("copies > 0").distinct()
    found = docs.join(plan, F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")))
    return found.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__id", "__source", "copies")


_ORACLE_DRAWS = ", ".join(f"('0x' || substr(sha256('{k // 8}:' || doc_id), {8 * (k % 8) + 1}, 8))::bigint / 4294967296.0::double" for k in range(SEEDS))
ORACLE = f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
named as (
  select source, sum(size)::bigint as n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w from sized group by source),
fed as (
  select *, coalesce(sum(n) over before, 0)::bigint as used, (sum(w) over ())::bigint - coalesce(sum(w) over before, 0)::bigint as free, (sum(n) over ())::bigint as total
  from named window before as (order by n / w, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select max((total - 3 * used)::double / free) as level from fed),
rated as (
  select source, n, least(3.0::double * n, w * level) as target, case when n > 0 then least(3.0::double, least(3.0::double * n, w * level) / n) else 0.0 end::double as rate from named, levels),
drawn as (
  select s.*, n, target, floor(rate) as whole, rate - floor(rate) as part, [{_ORACLE_DRAWS}] as draws from sized s join rated r on s.source is not distinct from r.source),
each as (select doc_id, source, size, n, target, whole, part, unnest(range(0, {SEEDS})) as k, unnest(draws) as u from drawn),
missed as (select source, k, abs(any_value(target) - any_value(whole) * any_value(n) - sum(case when u < part then size else 0 end)) as off from each group by source, k),
chosen as (select source, k from missed qualify row_number() over (partition by source order by off, k) = 1)
select e.doc_id, e.size, e.n as source_size, e.target, (e.size * (e.whole + case when e.u < e.part then 1 else 0 end))::bigint as taken
from each e join chosen c on e.source is not distinct from c.source and e.k = c.k
"""

"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two lines ends a chunk wherever it is 0 modulo SPREAD, so
boundaries depend on nearby lines alone and survive insertions above; chunks have SPREAD lines on
average. Chunks of several lines
are compared by a 64-bit hash first, with small rows; only chunks whose hash repeats are taken
from the text and grouped by their bytes. All but the first of a group go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import cut_lineage

SPREAD = 3
LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


def _ends(hashes: Column) -> Column:
    """Index of the last line of each chunk: where 31 * previous + own hash is 0 modulo SPREAD, and the end."""
    last = F.size(hashes) - 1

    def ends(i: Column) -> Column:
        rolled = F.element_at(hashes, i + 1) + F.when(i > 0, F.element_at(hashes, F.greatest(i, F.lit(1))) * 31).otherwise(0)
        return (i == last) | (F.pmod(rolled, F.lit(SPREAD)) == 0)

    return F.filter(F.sequence(F.lit(0), last), ends)


def _chunks(lines: Column, ends: Column) -> Column:
    """Arrays of lines, one for each chunk."""
    return F.transform(
        ends,
        lambda end, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))) + 2), F.when(i == 0, end + 1).otherwise(end - F.element_at(ends, F.greatest(i, F.lit(1))))),
    )


def _with_chunks(docs: DataFrame) -> DataFrame:
    """Adds ``chunks`` to rows with ``body``; stepwise, so nothing is computed twice."""
    step = docs.withColumn("lines", _lines(F.col("body")))
    step = step.withColumn("hashes", _line_hashes(F.col("lines")))
    step = step.withColumn("ends", _ends(F.col("hashes")))
    return step.withColumn("chunks", _chunks(F.col("lines"), F.col("ends"))).drop("hashes", "ends")


def _real(chunk: Column) -> Column:
    """Several lines that are not blank."""
    return F.size(F.filter(chunk, lambda x: F.trim(x) != "")) >= 2


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the input row as a struct), n_lines, n_removed (lines), n_chunks (removed), kept text.

    A chunk of at least two lines that are not blank is removed if an equal one stands in a
    smaller document, or earlier in the same one. Lines are what ``\\n`` separates; the kept
    ones are joined by it. A null text counts as one empty line and is kept as null. A null id
    is larger than any id. Rows that share id and text are one document and keep the same
    lines; rows that share only the id count as documents in the order of their texts' hashes.
    Input columns may have any names: they travel inside ``row``. An empty table gives an
    empty result.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(F.col(text)).alias("m")
    base, bodies = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key), docs.select(*key, F.col(text).alias("body"))
    slim = _with_chunks(bodies)
    hashed = slim.select("k", "m", F.posexplode(F.transform("chunks", lambda c: F.when(_real(c), F.xxhash64(F.array_join(c, "\n"))))).alias("no", "h")).where("h is not null")
    hashed = cut_lineage(hashed)
    twice = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    asked = hashed.join(twice, "h").groupBy("k", "m").agg(F.collect_set("no").alias("asked"))

    found = bodies.join(asked, ["k", "m"])
    found = _with_chunks(found).select("k", "m", F.explode("asked").alias("no"), "chunks")
    place = F.struct("k", "m", "no")
    texts = found.select(place.alias("place"), F.array_join(F.element_at("chunks", F.col("no") + 1), "\n").alias("chunk"))
    first = texts.groupBy("chunk").agg(F.min("place").alias("first"))
    gone = texts.join(first, "chunk").where("place > first").select("place.*")
    gone = gone.groupBy("k", "m").agg(F.collect_set("no").alias("gone"))

    # The body is taken from the row behind the join, so that the text is shuffled once there.
    whole = _with_chunks(base.join(gone, ["k", "m"], "left").withColumn("body", F.col("row")[text]))
    none = F.array().cast("array<int>")
    whole = whole.withColumn("gone", F.coalesce("gone", none))
    kept = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone")
    whole = whole.withColumn("left", F.flatten(F.transform(kept, lambda i: F.get("chunks", i))))
    return whole.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        F.size("gone").cast("long").alias("n_chunks"),
        F.when(F.col("body").isNotNull(), F.array_join("left", "\n")).alias("kept"),
    )


ORACLE = """
with lines as (
  select doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::bigint as h
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
ended as (
  select *, ((h + 31 * coalesce(lag(h) over (partition by doc_id order by i), 0)) % 3 = 0)::int as e from lines),
numbered as (
  select *, coalesce(sum(e) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as no from ended),
chunks as (
  select doc_id, no, string_agg(line, chr(10) order by i) as chunk, count(*) as n,
         count(*) filter (where trim(line, ' ') <> '') as real from numbered group by doc_id, no),
ranked as (
  select *, case when real >= 2 then row_number() over (partition by chunk, real >= 2 order by doc_id, no) else 1 end as r from chunks)
select doc_id, sum(n)::bigint as n_lines, coalesce(sum(n) filter (where r > 1), 0)::bigint as n_removed,
       count(*) filter (where r > 1) as n_chunks,
       sha256(coalesce(string_agg(chunk, chr(10) order by no) filter (where r = 1), '')) as kept_sha256
from ranked group by doc_id
"""

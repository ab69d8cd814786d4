"""One row to many: blocks, spans, clauses, words, chunks, parts, segments, marked-up pieces."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import patterns as P
from quillspark.functions.batches import by_slices
from quillspark.functions.brackets import regions
from quillspark.functions.measures import is_critical_clause, may_hold


def squash(text: Column) -> Column:
    """White space runs as one space, trimmed. Runs that are one blank already are not matched."""
    return F.trim(F.regexp_replace(text, rf"[{P.SPACE_CLASS}&&[^ ]][{P.SPACE_CLASS}]*+| [{P.SPACE_CLASS}]++", " "))


def posexplode_once(df: DataFrame, rows: Column, pos: str, value: str) -> DataFrame:
    """``posexplode`` of an array that costs much to make, beside df's columns.

    From plain ``explode`` and ``inline`` Spark infers a filter on the array's size, which makes the array
    once more, and for a table of one file in one task, as the filter moves below ``repartition``.
    """
    return df.select("*", F.posexplode_outer(rows).alias(pos, value)).where(F.col(pos).isNotNull())


def explode_blocks(df: DataFrame, text: str, unit: str = "paragraph") -> DataFrame:
    """pos, raw, block. Paragraphs are parted by blank lines; unit ``line`` takes lines, ``auto``
    takes lines of texts that are one paragraph."""
    paragraphs, lines = F.split(F.col(text), r"\n\s*\n"), F.split(F.col(text), "\n")
    parts = {"paragraph": paragraphs, "line": lines, "auto": F.when(F.size(paragraphs) > 1, paragraphs).otherwise(lines)}[unit]
    found = posexplode_once(df, parts, "pos", "raw").withColumn("block", squash(F.col("raw")))
    return found.where("block <> ''").withColumn("raw", F.trim("raw"))


#: A character that texts hardly hold; those that do hold it are matched twice instead.
MARK = "\x01"


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<m, n>>: a text cut at its matches, with each piece's length; m is null where nothing matches.

    One pass sets marks around the matches, and cutting at a mark is cheap. The array is named once:
    a lambda that named a second one would make it anew for each element.
    """
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    once = F.transform(marked, lambda x, i: F.struct(F.when(i % 2 == 1, x).alias("m"), F.length(x).alias("n")))
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    piece = lambda m, of: F.struct(m.alias("m"), F.coalesce(F.length(of), F.lit(0)).alias("n"))
    twice = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(piece(F.lit(None).cast("string"), g), piece(m, m))))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def email_pieces(text: Column) -> Column:
    """``pieces`` of e-mail addresses. About a text's only @ they are read outwards from it, not tried at every place.

    In front, what may belong to an address is a run of characters, which is read backwards; an address
    begins at its first word character.
    """
    pattern, word = P.JAVA_SPANS["email"], r"\p{L}\p{N}_"
    front, rest = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    name = F.regexp_extract(F.reverse(front), rf"^[{word}.+-]*[{word}]", 0)
    host = F.regexp_extract(rest, "^" + pattern.split("@", 1)[1], 0)
    parts = F.struct(name.alias("name"), host.alias("host"), F.length(front).alias("front"), F.length(rest).alias("rest"), text.alias("text"))
    piece = lambda m, n: F.struct(m.alias("m"), n.alias("n"))
    none = F.lit(None).cast("string")

    def cut(x: Column) -> Column:
        a, b = F.length(x["name"]), F.length(x["host"])
        at = F.array(piece(none, x["front"] - a), piece(F.concat(F.reverse(x["name"]), F.lit("@"), x["host"]), a + b + 1), piece(none, x["rest"] - b))
        return F.when((a > 0) & (b > 0), at).otherwise(F.array(piece(none, F.length(x["text"]))))

    one = F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit(""))) == 1
    return F.when(one, F.get(F.transform(F.array(parts), cut), F.lit(0))).otherwise(pieces(text, pattern))


SPANS_TYPE = "array<struct<start:int,end:int,kind:string,text:string>>"


def _found(text: Column, kinds: list[str]) -> Column:
    return F.array(*[F.when(may_hold(text, k), email_pieces(text) if k == "email" else pieces(text, P.JAVA_SPANS[k])) for k in kinds])


def _placer(kinds: list[str], settle: bool):
    """Arrow function from ``_found`` to spans in order of start, longest and then first kind first.

    Matching stays in the JVM; the running sums of offsets and the choice among overlaps, where each
    step depends on the last one kept, are linear here and quadratic in a fold over arrays.
    """

    @F.arrow_udf(SPANS_TYPE)
    def place(found: pa.Array) -> pa.Array:
        lists = found.flatten()
        parts, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        texts, length = parts.field("m"), parts.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(lists)), sizes)
        sums = np.cumsum(length)
        before = np.concatenate([[0], sums])[np.cumsum(sizes) - sizes]  # what lists in front add up to
        hit = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        texts, of, size, ends = texts.take(pa.array(hit)), of[hit], length[hit], (sums - before[of])[hit]
        row, kind = of // len(kinds), of % len(kinds)
        order = np.lexsort((kind, -size, ends - size, row))
        if settle:
            kept, last, free = [], -1, 0
            for at, r, start, end in zip(order.tolist(), row[order].tolist(), (ends - size)[order].tolist(), ends[order].tolist(), strict=True):
                if r != last or start >= free:
                    kept.append(at)
                    last, free = r, end
            order = np.array(kept, dtype=np.int64)
        cuts = np.searchsorted(row[order], np.arange(len(found) + 1)).astype(np.int32)
        names = pa.array(kinds).take(pa.array(kind[order]))
        columns = [pa.array((ends - size)[order].astype(np.int32)), pa.array(ends[order].astype(np.int32)), names, texts.take(pa.array(order))]
        return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(columns, ["start", "end", "kind", "text"]))

    return place


def span_array(text: Column, kinds: tuple[str, ...]) -> Column:
    """Every match of the kinds, overlapping or not; a null text has none."""
    return _placer(list(kinds), False)(_found(text, list(kinds)))


def spans(text: Column, kinds: tuple[str, ...] = tuple(P.SPANS)) -> Column:
    """Protected literals of a text: earliest first, longest at equal starts, without overlaps."""
    order = sorted(kinds, key=list(P.SPANS).index)
    return _placer(order, True)(_found(text, order))


def inline_once(df: DataFrame, rows: Column) -> DataFrame:
    """One row for each struct of ``rows``, an array that a Python function gives, beside df's columns.

    Inlining outer and dropping the empty rows after keeps the function to one evaluation: from
    plain ``explode`` Spark infers a filter on the array's size, which works the function out once more.
    """
    found = df.withColumn("__rows", rows).select("*", F.explode_outer("__rows").alias("__row")).where("__row is not null")
    return found.drop("__rows")


def explode_spans(df: DataFrame, text: str, kinds: tuple[str, ...] = tuple(P.SPANS)) -> DataFrame:
    """start, end, kind, span for each protected literal."""
    rows = inline_once(df, spans(F.col(text), kinds)).withColumnRenamed("__row", "__s")
    return rows.select("*", "__s.start", "__s.end", "__s.kind", F.col("__s.text").alias("span")).drop("__s")


def explode_clauses(df: DataFrame, text: str) -> DataFrame:
    """pos, clause, critical: pieces that end with . ! ? or a line."""
    parts = F.split(F.col(text), r"(?<=[.!?])|\n")
    found = posexplode_once(df, parts, "pos", "clause").withColumn("clause", F.trim("clause"))
    return found.where(F.col("clause").rlike(r"[^\s.!?]")).withColumn("critical", is_critical_clause(F.col("clause")))


def explode_words(df: DataFrame, text: str) -> DataFrame:
    """pos, word: lower-cased."""
    return posexplode_once(df, F.regexp_extract_all(F.lower(F.col(text)), F.lit(P.WORD), F.lit(0)), "pos", "word")


def chunk_text(df: DataFrame, text: str, max_chars: int = P.CHUNK_CHARS) -> DataFrame:
    """pos, chunk: pieces of at most ``max_chars`` characters, cut after the last line feed or
    space inside the limit where there is one. Joined in order, the chunks are the text; an empty text has none."""
    piece = rf"(?s).{{1,{max_chars - 1}}}[\n ]|.{{1,{max_chars}}}"
    whole = F.length(F.col(text)).between(1, max_chars)
    return posexplode_once(df, F.when(whole, F.array(F.col(text))).otherwise(F.regexp_extract_all(F.col(text), F.lit(piece), F.lit(0))), "pos", "chunk")


def explode_parts(df: DataFrame, parts: str) -> DataFrame:
    """part index and part of each message; a message without parts keeps one null row."""
    return df.select("*", F.posexplode_outer(F.col(parts)).alias("part", "value"))


SEGMENT = r"(?s)<nocompress>.*?</nocompress>|(?:```|~~~)[^\n]*\n.*?(?:\n(?:```|~~~)|$)|<(?:table|pre|code|script|style|svg)\b.*?</(?:table|pre|code|script|style|svg)>"


def explode_segments(df: DataFrame, text: str) -> DataFrame:
    """pos, segment, kind, compressible: regions that must stay as they are, and prose between."""
    t = F.col(text)
    regions, gaps = F.regexp_extract_all(t, F.lit(SEGMENT), F.lit(0)), F.split(t, SEGMENT, -1)
    woven = F.flatten(F.zip_with(gaps, regions, lambda g, r: F.array(g, F.coalesce(r, F.lit("")))))
    found = posexplode_once(df, woven, "pos", "segment").where("segment <> ''")
    kind = F.when(F.col("pos") % 2 == 0, "prose").when(F.col("segment").startswith("<nocompress>"), "nocompress").when(F.col("segment").rlike("^(?:```|~~~)"), "code").otherwise("html")
    return found.withColumn("kind", kind).withColumn("compressible", F.col("kind") == "prose")


HTML_PIECES = {"link": (r'<a\s[^>]*href="([^"]*)"', 1), "comment": (r"(?s)<!--(.*?)-->", 1), "heading": (r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "cell": (r"(?s)<t[dh][^>]*>(.*?)</t[dh]>", 1), "block": (r"(?s)<(script|style)\b", 1), "item": (r"(?s)<li[^>]*>(.*?)</li>", 1)}


def explode_html(pages: DataFrame, html: str) -> DataFrame:
    """kind, pos, piece: links, comments, headings, table cells, list items, script and style blocks."""

    def each(kind: str, pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("piece")))

    return inline_once(pages, F.concat(*[each(k, p, g) for k, (p, g) in HTML_PIECES.items()])).select("*", "__row.*").drop("__row")


TOKENS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("label", T.IntegerType())]))


def _labeller(terms: list[str], ignore_case: bool):
    """Arrow function from texts to their tokens. Occurrences of terms may overlap and reach over tokens."""
    flags = re.IGNORECASE if ignore_case else 0
    wanted = re.compile("(?=(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + "))", flags) if terms else None
    word = re.compile(P.WORD)

    kind = to_arrow_type(TOKENS)

    def some(text: pa.Array) -> pa.Array:
        cuts, columns = [0], ([], [], [], [], [])
        for t in text.to_pylist():
            # Longest first at each place, so these are enough to tell what any occurrence covers.
            hits = [(m.start(), m.end(1)) for m in wanted.finditer(t or "")] if wanted else []
            at, reach = 0, 0
            for pos, m in enumerate(word.finditer(t or "")):
                while at < len(hits) and hits[at][0] < m.end():
                    reach = max(reach, hits[at][1])
                    at += 1
                for column, x in zip(columns, (pos, m.start(), m.end(), m[0], int(reach > m.start())), strict=True):
                    column.append(x)
            cuts.append(len(columns[0]))
        made = [pa.array(x, f.type) for x, f in zip(columns, kind.value_type, strict=True)]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kind.value_type)))

    @F.arrow_udf(TOKENS)
    def label(text: pa.Array) -> pa.Array:
        return by_slices(some, text)

    return label


def explode_label_tokens(df: DataFrame, text: str, terms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """pos, start, end, token of each word, and label 1 where it overlaps an occurrence of a keep term, else 0.

    A term may lie inside a word or reach over several. ``terms`` has one string column, a
    vocabulary of marker terms: more than 10,000 are refused.
    """
    wanted = [r[0] for r in terms.where(F.length(F.col(terms.columns[0])) > 0).distinct().limit(10_001).collect()]
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 keep terms are no vocabulary of marker terms")
    tokens = _labeller(sorted(wanted), ignore_case)(F.col(text))
    return inline_once(df, tokens).drop(text).select("*", "__row.*").drop("__row")


REGIONS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("syntax", T.StringType()),
    T.StructField("duplicate_keys", T.ArrayType(T.StringType())), T.StructField("ambiguous", T.BooleanType()), T.StructField("flags", T.ArrayType(T.StringType())),
]))
SOUND = ("strict_json_object", "strict_json_array", "ndjson", "concatenated_json")


@F.arrow_udf(REGIONS)
def _regions(text: pa.Array) -> pa.Array:
    return by_slices(lambda part: pa.array([regions(t) if t else [] for t in part.to_pylist()], to_arrow_type(REGIONS)), text)


def explode_json_regions(df: DataFrame, text: str, loose: bool = False) -> DataFrame:
    """start, end, syntax, duplicate_keys, ambiguous, flags, region: JSON objects and arrays inside prose.

    Sound regions are strict_json_object or strict_json_array; neighbours with only white space
    between are ndjson or concatenated_json. ``ambiguous`` ones stand inside brackets that hold no JSON;
    ``flags`` name what the section in front of a region speaks of. With ``loose`` there is a row
    for every bracket that opens no sound JSON too: jsonc_like (comments, trailing commas),
    javascript_object_like (bare or single-quoted keys), template_or_bracket_syntax, invalid_balanced
    and invalid_unbalanced. Such regions may nest and reach to the text's end, so their text is null.
    """
    found = inline_once(df, _regions(F.col(text))).select("*", "__row.*").drop("__row")
    region = F.when(F.col("syntax").isin(*SOUND), F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))
    return (found if loose else found.where(F.col("syntax").isin(*SOUND))).withColumn("region", region)

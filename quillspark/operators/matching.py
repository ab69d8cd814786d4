"""Many terms at once: one walk over each text, whatever the number of terms.

Terms go into an Aho-Corasick automaton, which each Python worker builds once. A vocabulary of
at most MOST_TERMS terms and MOST_BYTES bytes travels with the function; the callers of
``vocabulary`` have a join for larger ones. Texts stay in their rows and are never shuffled.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.brackets import STRICT, regions
from quillspark.operators.generators import by_slices

MOST_TERMS, MOST_BYTES = 100_000, 16 << 20
SEQUENCES = (*STRICT, "ndjson", "concatenated_json")


def vocabulary(rows: DataFrame) -> list[tuple] | None:
    """Rows of a few strings, collected if they are within the bounds; None if they are not."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in rows.columns), F.lit(0))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return [tuple(r) for r in rows.collect()] if n <= MOST_TERMS and total <= MOST_BYTES else None


def automaton(terms) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for t in terms:
        if t:
            found.add_word(t, t)
    if not len(found):
        return None
    found.make_automaton()
    return found


def walk(text: str, terms: ahocorasick.Automaton | None) -> Iterator[tuple[int, int, str]]:
    """start, end, term of occurrences from left to right, the longest at each place, without overlaps."""
    for last, term in terms.iter_long(text) if terms is not None else ():
        yield last + 1 - len(term), last + 1, term


def spliced(text: str, pairs: dict[str, str], terms: ahocorasick.Automaton | None = None) -> str:
    """The text with each key's occurrences replaced, in one walk over sorted offsets."""
    out, at = [], 0
    for a, b, term in walk(text, terms if terms is not None else automaton(pairs)):
        out += [text[at:a], pairs[term]]
        at = b
    return "".join([*out, text[at:]])


SPLICED = T.StructType([T.StructField("body", T.StringType()), T.StructField("back", T.StringType())])


def _spliced(text: pa.Array, literals: pa.Array, aliases: pa.Array) -> pa.Array:
    bodies, backs = [], []
    for t, ls, ns in zip(text.to_pylist(), literals.to_pylist(), aliases.to_pylist(), strict=True):
        if t is None or not ls:
            bodies.append(t)
            backs.append(t)
            continue
        body = spliced(t, dict(zip(ls, ns, strict=True)))
        bodies.append(body)
        backs.append(spliced(body, dict(zip(ns, ls, strict=True))))
    return pa.StructArray.from_arrays([pa.array(bodies, pa.string()), pa.array(backs, pa.string())], ["body", "back"])


@F.arrow_udf(SPLICED)
def _splice(text: pa.Array, literals: pa.Array, aliases: pa.Array) -> pa.Array:
    return by_slices(_spliced, text, literals, aliases)


def splice(text: Column, literals: Column, aliases: Column) -> Column:
    """struct<body, back>: literals replaced by the aliases of the same place, and these again by the literals.

    Both ways take the longest literal at the leftmost place and go on behind it. A null text stays
    null; null or empty arrays change nothing.
    """
    return _splice(text, literals, aliases)


def json_keys(text: str) -> set[str]:
    """Keys of all objects in the sound JSON regions of a text."""
    keys: set[str] = set()
    for r in regions(text):
        if r["syntax"] in SEQUENCES:
            json.loads(text[r["start"] : r["end"]], object_pairs_hook=lambda pairs: keys.update(k for k, _ in pairs))
    return keys


_SPACE = re.compile(r"\s+")


def constraint_scan(docs: DataFrame, rules: DataFrame, doc_id: str, group: str, text: str) -> DataFrame | None:
    """doc_id, rules, failed, misses (``kind:term``, sorted) for each row whose group has rules.

    ``rules`` has the group's column, ``kind`` and ``term``. Kinds: ``required`` and ``forbidden`` literally,
    ``spaceless`` with all white space taken out of both, ``json_key`` as a key in the text's sound
    JSON. A null text holds nothing; repeated rules count once, those with a null are left out.
    None if the rules are beyond the bounds of ``vocabulary``.
    """
    rows = rules.select(F.col(group).cast("string").alias("g"), "kind", "term").dropna().distinct()
    found = vocabulary(rows)
    if found is None:
        return None
    if unknown := {k for _, k, _ in found} - {"required", "forbidden", "spaceless", "json_key"}:
        raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
    # A text costs what it holds and what it lacks, not a step for each rule that it keeps.
    by_group: dict[str, dict[str, dict[str, str]]] = {}
    for g, kind, term in found:
        mine = by_group.setdefault(g, {k: {} for k in ("forbidden", "required", "spaceless", "json_key")})
        mine[kind][term] = _SPACE.sub("", term) if kind == "spaceless" else term
    literal = {t for _, k, t in found if k in ("required", "forbidden")}
    bare = {short for mine in by_group.values() for short in mine["spaceless"].values()}
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("rules", T.LongType()), T.StructField("failed", T.LongType()), T.StructField("misses", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, tight = automaton(literal), automaton(bare)
        for batch in batches:
            kept, n, failed, misses = [], [], [], []
            for i, (g, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                mine = by_group.get(g)
                if not mine:
                    continue
                t = t or ""
                # Every occurrence, overlapping or not; an empty term is in every text.
                seen = {x for _, x in plain.iter(t)} if plain is not None else set()
                missed = [("forbidden", x) for x in (*seen, "") if x in mine["forbidden"]]
                missed += [("required", x) for x in mine["required"] if x and x not in seen]
                if mine["spaceless"]:
                    squeezed = {x for _, x in tight.iter(_SPACE.sub("", t))} if tight is not None else set()
                    missed += [("spaceless", x) for x, short in mine["spaceless"].items() if short and short not in squeezed]
                if mine["json_key"]:
                    keys = json_keys(t)
                    missed += [("json_key", x) for x in mine["json_key"] if x not in keys]
                kept.append(i)
                n.append(sum(map(len, mine.values())))
                failed.append(len(missed))
                misses.append([f"{kind}:{term}" for kind, term in sorted(missed)])
            columns = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(failed, pa.int64()), pa.array(misses, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(F.col(doc_id), F.col(group).cast("string").alias("__g"), F.col(text).alias("__t")).mapInArrow(run, schema)


def without_phrases(key: Column, text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The text without its key's phrases, which are (key, phrase) within the bounds of ``vocabulary``."""
    by_key: dict[str, set[str]] = defaultdict(set)
    for k, p in phrases:
        by_key[k].add(p)
    made: dict[str, ahocorasick.Automaton] = {}

    def some(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
            if t is None or k not in by_key:
                out.append(t)
                continue
            if k not in made:
                made[k] = automaton(by_key[k])
            out.append(spliced(t, dict.fromkeys(by_key[k], ""), made[k]))
        return pa.array(out, pa.string())

    @F.arrow_udf(T.StringType())
    def drop(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return by_slices(some, texts, keys)

    return drop(text, key)

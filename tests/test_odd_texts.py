"""Queries of texts equal their SQL on texts that the small tables lack: empty, null, blank at the ends, with marks of every kind."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.operators import generators as G
from quillspark.plans import registry
from quillspark.sources import corpus

TEXTS = [
    "", None, " ", "   ", "\n", "\t", " lead", "trail ", "\tx\t", "one line\n", "a b\n\n", "x\n \t\n", "x\n  \n  y  ", "  a  b\n  c   d",
    "a\r\nb\r\n", "\r", "a\rb", "x\r\n\r\ny", "\x85a b", "a # b - c", "#\n# x\n#\x0bz\n#\ty", "- a\n* b\n-\nc\n+\td", "{\n [\n \"x\"", '"', '""', '"q', 'a"b"', "a,b", "a\\", '\\"', "n/a",
    "\x00z", "a\x01b", "\U0001F600 a", "\U0001F600" * 4100, "x" * 4000 + " y", "x" * 3999 + " y", " " * 4100, ("w" * 3998 + "\n") * 3, "the de ! ? .", "mail a@b.example by 2024-01-02",
    "<!--a!b--><!-- c\n--><!-- d <!-- e --><p>\n</p >", "a\n\x85\n\u2028\n - b\u2029# c \r", "a  \nb\t\n\n \n",
]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Every text under ids that differ in what the queries take from an id."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i * 1000 + k * 7, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(TEXTS) for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    shutil.copyfile(f"{sf}/orders.parquet", f"{folder}/orders.parquet")
    return folder


def norm(v):
    return "nan" if v != v else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    c.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    df, sql = registry.QUERIES[name](spark, folder), c.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    got = sorted([norm(r[x]) for x in names] for r in df.collect())
    want = sorted([norm(r[sql.columns.index(x)]) for x in names] for r in sql.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["a3_read_measurements", "b8_structural_features", "f9_opportunity_totals", "d5_chunk_text", "j1_route_texts", "j1_route", "j2_expected_reduction", "j3_projected_cost"])
def test_query_equals_sql(spark, odd, name):
    same_as_sql(spark, odd, name)


def test_csv_keeps_texts_and_missing_fields_apart(spark, tmp_path):
    rows = [("a", "", "5"), ("b", None, None), ("c", " x\n", "n/a"), ("d", "\n", " 7 ")]
    corpus.write_results(spark.createDataFrame(rows, "id string, text string, n string"), f"{tmp_path}/csv", "csv")
    found = {r.id: (r.text, r.n) for r in corpus.read_measurements(spark, f"{tmp_path}/csv", ["n"]).collect()}
    assert found == {"a": ("", 5.0), "b": (None, 0.0), "c": (" x\n", 0.0), "d": ("\n", 7.0)}
    assert {r.id: r.n for r in corpus.read_measurements(spark, f"{tmp_path}/csv", ["n"], missing=None).collect()}["b"] is None


def test_lines_are_parted_by_line_feeds_only(spark):
    """An empty text is one blank line, as is what follows a last line feed; a first line's indent is no run of blanks."""
    texts = ["", "\n", "a\n", "a\n\n \r\n", "  a  b\r# c", "#\n# d \n - e", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    names = ("blank_lines", "trailing_space_lines", "multi_space_runs", "headings", "bullets")
    found = M.structural_features(F.col("text"))
    got = [tuple(r)[1:] for r in docs.select("i", *[found[n].alias(n) for n in names]).orderBy("i").collect()]
    assert got == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (1, 0, 0, 0, 0), (3, 0, 0, 0, 0), (0, 0, 1, 0, 0), (0, 1, 0, 1, 1), (None,) * 5]


def test_empty_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "ab cd\nef")], "doc_id long, text string")
    found = sorted((r.doc_id, r.pos, r.chunk) for r in G.chunk_text(docs, "text", 4).collect())
    assert found == [(3, 0, " "), (4, 0, "ab "), (4, 1, "cd\n"), (4, 2, "ef")]


def test_plain_features_are_as_divided(spark):
    """Shares of nothing are no numbers, and nothing is known of a null text; without ``plain`` both are 0."""
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "\n"), (3, "the cat")], "i long, text string")
    names = ("tokens", "deterministic", "protected", "structured", "placeholders", "segments")

    def features(**how):
        made = docs.withColumns(M.route_features(F.col("text"), F.regexp_replace("text", "the ", ""), **how))
        return [[norm(r[n]) for n in names] for r in made.orderBy("i").collect()]

    assert features(plain=True) == [["0", "nan", "nan", "0.0", "0", "1"], ["None"] * 6, ["0", "nan", "0.0", "0.0", "0", "1"], ["1", "0.5", "0.0", "0.0", "0", "1"]]
    assert features() == [["0", "0.0", "0.0", "0.0", "0", "1"], ["0", "0.0", "0.0", "0.0", "0", "0"], ["0", "0.0", "0.0", "0.0", "0", "1"], ["1", "0.5", "0.0", "0.0", "0", "1"]]


def test_expected_reduction_without_tokens(spark):
    row = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.0)], "tokens long, segments long, deterministic double, protected double, identifier double, structured double")
    asked = [F.col(c) for c in row.columns]
    assert [round(x, 6) for x in row.select(M.expected_reduction(*asked), M.expected_reduction(*asked, idle=None)).first()] == [0.0, 0.06]


def test_cost_without_chunks(spark):
    """0, or what is paid without any chunk; null where a baseline is missing."""
    rows = spark.createDataFrame([(0, 900.0), (1, 900.0), (24_001, 900.0), (0, None), (5, None), (None, 900.0)], "chars long, per_chunk double")
    cost = lambda **how: M.projected_cost(F.col("chars"), F.lit(50.0), F.col("per_chunk"), F.lit(20.0), **how)
    found = rows.select(cost().alias("a"), cost(idle=None).alias("b")).collect()
    assert [r.a for r in found] == [0.0, 970.0, 1870.0, 0.0, None, None]
    assert [r.b for r in found] == [70.0, 970.0, 1870.0, None, None, None]

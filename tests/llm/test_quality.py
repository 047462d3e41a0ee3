"""Quality rules against their SQL statement and by hand."""

import duckdb

from rotaloom.llm import quality as Q
from rotaloom.llm import statements

GOOD = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, GOOD, "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, "a b c " * 30, "en", "s"), (5, GOOD + "\n" + GOOD, None, "s"),
    (6, "\n".join(["same line here"] * 30), "de", None), (7, GOOD.replace(" ", " *** "), "en", "s"), (7, GOOD.replace(" ", " *** "), "en", "s"),
    (8, "é\x0bü\r\n\n  x\t" * 40, "fr", "t"), (9, "x" * 100_000, "en", "s"), (10, " ".join(str(i) for i in range(20_000)), "en", "s"),
] + [(100 + i, " ".join(f"w{i}x{j % 57}" for j in range(55 + i)), "en", "s") for i in range(130)]


def test_rows_match_the_statement(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words")
    got = Q.judge(docs)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.register("documents", docs.drop("n_words").toPandas().astype(object).where(lambda f: f.notna(), None))
    found = con.execute(statements.OP4)
    columns = [d[0] for d in found.description]
    want = [tuple(r[columns.index(n)] for n in names) for r in found.fetchall()]
    assert sorted(columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[1] and kept[100] and not any(kept[i] for i in (2, 3, 4, 6, 7, 9))


def test_buckets_are_tight(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 200_000, 37).select("id", Q.bucket(F.col("id")).alias("b"))
    rows = rows.select("id", "b", Q.bucket_value(F.col("b")).alias("top"))
    assert rows.filter("top < id or (id >= 64 and top > id * 33.0 / 32) or (id < 64 and top <> id)").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judge(docs).count() == 0

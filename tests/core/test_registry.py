"""Every query of the text engine against its SQL on the small tables, and the Khmer cases."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import normalize
from textloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    mine = Counter(tuple(r) for r in found.select(columns).collect())
    theirs = Counter(duck.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]}) as q").fetchall())
    assert mine == theirs


@pytest.mark.parametrize(
    ("text", "normal"),
    [("កំុ", "កុំ"), ("ស្រ្តី", "ស្ត្រី"), ("កេី", "កើ"), ("កេា", "កោ"), ("ក", "ក"), ("abc", "abc"), ("ឣា", "អា"), ("", "")],
)
def test_word_key(spark, text, normal):
    assert spark.createDataFrame([(text,)], "t string").select(normalize.word_key(F.col("t"))).first()[0] == normal


def test_fold_key(spark):
    a, b = spark.createDataFrame([("ស្តី", "ស្ដី")], "a string, b string").select(normalize.fold_key(F.col("a")), normalize.fold_key(F.col("b"))).first()
    assert a == b


def test_all_queries_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
    assert registry.flagship(spark, SF).count() > 0


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Documents of which only the text after the 40th character has anything to find."""
    folder = tmp_path_factory.mktemp("late")
    rows = [(i, "x" * 50 + " a  b the 7 ខ្ញុំ កេី!! ៗ«") for i in range(14)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return rows, str(folder)


def test_whole_texts_are_read(spark, late):
    rows, folder = late
    overlaid = [name for name, sql in registry.oracle_sql().items() if registry.OVERLAY_SQL in sql]
    assert len(overlaid) == 23 and all(registry.OVERLAY_SQL not in registry.oracle_sql()[f"{name}_whole"] for name in overlaid)
    queries = registry.queries()
    assert {(r["doc_id"], r["start"]) for r in queries["multiple_spaces_whole"](spark, folder).collect()} >= {(i, len(registry.LINES[i % 7]) + 1 + 52) for i, _ in rows}
    assert {(r["doc_id"], r["variant"]) for r in queries["user_term_rule_whole"](spark, folder).collect()} >= {(i, "the") for i, _ in rows}
    assert {r["doc_id"] for r in queries["span_repeated_mark_whole"](spark, folder).collect()} == {i for i, _ in rows}
    chunks = _texts(queries["token_chunks_whole"](spark, folder).collect())
    assert chunks == {i: registry.LINES[i % 7] + "\n" + t for i, t in rows}


def _texts(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_at"])):
        found[r["doc_id"]] = found.get(r["doc_id"], "") + r["chunk"]
    return found


def test_queries_without_sql_read_whole_texts(spark, late):
    rows, folder = late
    queries = registry.queries()
    for name in ("word_key", "fold_key"):
        assert all(r[name].endswith(" a  b the 7 ខ្ញុំ កើ!! ៗ«") for r in queries[name](spark, folder).collect())
    assert all(r["normal"].endswith("ខ្ញុំកើ") for r in queries["cluster_normalize"](spark, folder).collect())
    starts = {(r["doc_id"], r["start"], r["word"]) for r in queries["word_segments"](spark, folder).collect()}
    assert starts >= {(i, len(registry.LINES[i % 7]) + 1 + 62, "ខ្ញុំ") for i, _ in rows}
    assert queries["meaning_signature"](spark, folder).count() == len(rows)

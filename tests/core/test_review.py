"""Review records, reports, proposals, consistency, evaluation and the lexicon build, on small tables."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from textloom.operators import build, consistency, evaluation, review, words
from textloom.operators import lexicon as lex


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


FOUND = "doc_id long, rule_id string, start long, stop long, original string, suggestions array<string>, severity string, confidence double"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (0, "grammar.ning-neung", 4, 7, "និង", ["នឹង", "នឹង", None], "error", 0.85),
        (0, "spelling.dictionary", 4, 6, "ab", ["b"], None, 1.2),
        (0, "style.phrase", 0, 2, "x<", [], "suggestion", 0.4),
        (1, "spelling.unknown", 6, 8, "ខគ", [], "info", 0.3),
    ]
    return review.record(spark.createDataFrame(rows, FOUND))


def test_records(records):
    got = {r["rule_id"]: r for r in records.collect()}
    assert got["grammar.ning-neung"]["suggestions"] == ["នឹង"] and got["grammar.ning-neung"]["safe"]
    assert (got["spelling.dictionary"]["confidence"], got["spelling.dictionary"]["confidence_level"], got["spelling.dictionary"]["severity"]) == (0.99, "high", "warning")
    assert (got["style.phrase"]["category"], got["style.phrase"]["confidence_level"], got["style.phrase"]["safe"]) == ("unnecessary", "low", False)
    assert got["spelling.unknown"]["category"] == "unverified"


def test_legal_guard(records):
    got = {r["rule_id"]: (r["safe"], r["human_review"], r["legal_note"]) for r in review.legal_guard(records).collect()}
    assert got["grammar.ning-neung"] == (False, True, "meaning") and got["style.phrase"] == (False, True, "wording") and got["spelling.dictionary"] == (True, False, None)


@pytest.fixture(scope="module")
def rows(spark, records):
    docs = docs_of(spark, ["x<a និង &ខ។", "ក\n\n  \nខ\nខគ។"])
    sentences = spark.createDataFrame([(0, 0, 12, "x<a និង &ខ។")], "doc_id long, start long, stop long, text string")
    placed = review.ordered(records, docs, sentences)
    decisions = spark.createDataFrame([(0, "F001", "accepted", "y", 1), (0, "F002", "rejected", None, 1), (0, "F002", "undo", None, 2)], "doc_id long, finding_id string, status string, chosen string, at int")
    return review.fields(review.decided(placed, decisions)).cache()


def test_order_places_and_decisions(rows):
    got = {(r["doc_id"], r["finding_id"]): r for r in rows.collect()}
    assert [(k[1], got[k]["rule_id"]) for k in sorted(got) if k[0] == 0] == [("F001", "style.phrase"), ("F002", "grammar.ning-neung"), ("F003", "spelling.dictionary")]
    assert [got[0, f"F00{i}"]["status"] for i in (1, 2, 3)] == ["accepted", "open", "open"] and got[0, "F001"]["shown"] == "y"
    last = got[1, "F001"]
    assert (last["line"], last["column"], last["paragraph"], last["context_offset"]) == (4, 1, 2, 6)
    assert got[0, "F002"]["context"] == "x<a និង &ខ។" and got[0, "F002"]["place_en"] == "para 1, line 1, col 5"


def test_totals_and_reports(rows):
    total = {r["doc_id"]: r for r in review.totals(rows).collect()}
    assert (total[0]["all"], total[0]["open"], total[0]["accepted"]) == (3, 2, 1) and total[0]["by_category"] == {"unnecessary": 1, "grammar": 1, "spelling": 1}
    text = {r["doc_id"]: r["csv"] for r in review.csv_text(review.csv_lines(rows)).collect()}[0]
    assert text.startswith("﻿") and text.endswith("\r\n")
    table = list(csv.reader(io.StringIO(text[1:])))
    assert [len(x) for x in table] == [21] * 4 and table[0] == list(review.HEADERS) and table[2][8] == "និង" and table[2][14] == "85%"
    html = {r["doc_id"]: r["html"] for r in review.html_report(rows).collect()}[0]
    assert "<mark>x&lt;</mark>a" in html and "<script" not in html and html.count('<tr class="st-') == 3


def test_applied_refuses_a_changed_span(spark):
    got = spark.range(1).select(review.applied(F.lit("abc"), F.lit(1), F.lit(2), F.lit("b"), F.lit("xx")), review.applied(F.lit("abc"), F.lit(1), F.lit(2), F.lit("c"), F.lit("xx"))).first()
    assert tuple(got) == ("axxc", None)


def test_proposals(spark):
    docs = docs_of(spark, ["aba ក ៣០ aba"])
    items = [(0, 0, "aba", "grammar", "x", 0.99), (0, 1, "aba", "wording", "aba", None), (0, 2, "aba", "wording", "y", 0.1), (0, 3, "zz", "grammar", "x", 0.5), (0, 4, "ក", "invented", "x", 0.5), (0, 5, "៣០", "clarity", "bad", 0.5)]
    proposals = spark.createDataFrame(items, "doc_id long, place int, original string, category string, suggestion string, confidence double")
    got = review.accepted_proposals(docs, proposals, spark.createDataFrame([("bad",)], "suggestion string"), legal=True).orderBy("start").collect()
    assert [(r["start"], r["stop"], r["suggestions"], r["confidence"], r["human_review"]) for r in got] == [(0, 3, ["x"], 0.6, True), (6, 8, [], 0.5, True), (9, 12, [], 0.4, True)]


def test_rewrites(spark):
    passage = "ភាគីត្រូវបង់ក្នុង ៣០ ថ្ងៃ។"
    texts = ["ភាគីត្រូវទូទាត់ក្នុង ៣០ ថ្ងៃ។", "ភាគីត្រូវបង់ក្នុង ៤០ ថ្ងៃ។", "ភាគីអាចបង់ក្នុង ៣០ ថ្ងៃ។", "ភាគីត្រូវបង់ ៣០ ថ្ងៃ។"]
    rows = spark.createDataFrame([(1, k, passage, t, 0, 0) for k, t in enumerate(texts)], "passage_id int, place int, passage string, text string, errors int, errors_before int")
    assert [r["place"] for r in review.accepted_rewrites(rows, legal=True).collect()] == [0]
    assert sorted((r["place"], r["meaning_changed"]) for r in review.accepted_rewrites(rows).collect()) == [(0, False), (2, True)]


def test_consistency(spark):
    lexicon = spark.createDataFrame([("សេចក្ដី", 1, 3, 1), ("សេចក្តី", 2, 3, 1), ("ល្អ", 1, 3, 4)], lex.LEXICON)
    docs = docs_of(spark, ["សេចក្ដីល្អ សេចក្ដី សេចក្តី។", "សេចក្តីល្អ", None])
    mixed = consistency.variant_mix(words.analysed(docs, lexicon), lex.variant_groups(lexicon)).collect()
    assert [(r["doc_id"], r["start"], r["original"], r["suggestions"]) for r in mixed] == [(0, 19, "សេចក្តី", ["សេចក្ដី"])]
    docs = docs_of(spark, ["ហៅថា «ភាគីមួយ» និង «ភាគីមួយ» «ភាគិមួយ» «អ្នកលក់»", "«ភាគីមួយ» «ភាគិមួយ»"])
    defined = consistency.defined_terms(docs).collect()
    assert [(r["doc_id"], r["original"], r["suggestions"]) for r in defined] == [(0, "ភាគិមួយ", ["ភាគីមួយ"])]
    pairs = [("ab", "cd"), ("ef", "gh")]
    assert [tuple(r) for r in consistency.synonym_mix(docs_of(spark, ["x cd ab cd", "ab", "ef gh ab cd"]), pairs).orderBy("doc_id", "start").collect()] == [
        (0, "terminology.synonym-mix", 5, 7, "ab", ["cd"]), (2, "terminology.synonym-mix", 3, 5, "gh", ["ef"]), (2, "terminology.synonym-mix", 9, 11, "cd", ["ab"]),
    ]
    assert [tuple(r) for r in consistency.user_rules(docs_of(spark, ["a.b axb a.b"]), [("z", "a.b"), ("y", "")]).orderBy("start").collect()] == [(0, "terminology.user-rule", 0, 3, "a.b", ["z"]), (0, "terminology.user-rule", 8, 11, "a.b", ["z"])]


def test_greedy_matching_and_scores(spark):
    expected = spark.createDataFrame([(0, 0, 0, 4, ["spelling"]), (0, 1, 2, 6, ["spelling", "unicode"]), (1, 0, 0, 2, ["grammar"])], "doc_id long, n long, start long, stop long, categories array<string>")
    found = spark.createDataFrame([(0, 0, 1, 5, "spelling", "error"), (0, 1, 3, 4, "grammar", "error"), (0, 2, 9, 10, "grammar", "error"), (2, 0, 0, 1, "clarity", "info"), (2, 1, 4, 5, "clarity", "warning")], "doc_id long, m long, start long, stop long, category string, severity string")
    assert sorted(map(tuple, evaluation.matched(expected, found).collect())) == [(0, 0, 0), (0, 1, None), (1, 0, None)]
    items = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "doc_id long, group string")
    got = {r["group"]: r for r in evaluation.scores(items, expected, found).collect()}
    assert (got["a"]["expected"], got["a"]["hits"], got["a"]["false_alarms"], got["a"]["notes"]) == (3, 1, 1, 0)
    assert (got["b"]["false_alarms"], got["b"]["notes"], got["b"]["recall"]) == (1, 1, None) and (got[None]["items"], got[None]["precision"], got[None]["recall"]) == (3, 1 / 3, 1 / 3)
    rates = evaluation.flag_rates(found.withColumn("rule_id", F.lit("x")), spark.createDataFrame([(0, 500)], "doc_id long, n_words long")).first()
    assert (rates["flags"], rates["notes"], rates["flags_per_1000"]) == (4, 1, 8.0)


def test_errors_put_in_are_reproducible_and_scored(spark):
    words_ = spark.createDataFrame([(1, 0, "ខ្ញុំ"), (1, 9, "ពិនិត្យ"), (2, 0, "abc")], "doc_id long, start long, word string")
    a, b = (sorted(map(tuple, evaluation.with_errors(words_).collect())) for _ in range(2))
    assert a == b and {r[2] for r in a} >= {"confusable", "missing-subscript", "disordered"} and all(r[3] != r[4] for r in a) and not any(r[0] == 2 for r in a)
    assert (1, 0, "disordered", "ខ្ញុំ", "ខ្ញំុ") in a
    swaps = {r["kind"]: r["text"] for r in evaluation.swapped(docs_of(spark, ["គាត់និងខ្ញុំ", "x"])).collect()}
    assert swaps == {"និង>នឹង": "គាត់នឹងខ្ញុំ"}
    trials = spark.createDataFrame([(0, "k", 0, 3, "abc"), (1, "k", 0, 3, "abc"), (2, "k", 0, 3, "abc")], "doc_id long, kind string, start long, stop long, word string")
    found = spark.createDataFrame([(0, 0, 3, "spelling", ["abc"]), (1, 2, 5, "spelling", ["x"]), (2, 0, 3, "grammar", ["abc"])], "doc_id long, start long, stop long, category string, suggestions array<string>")
    assert tuple(evaluation.detection(trials, found).first()) == ("k", 3, 2, 1)


def test_lexicon_build(spark):
    heads = build.headwords(spark.createDataFrame([('"កាខ, "',), ("ម",), ("ឬ",), ("abc",), ("ខុស ",)], "value string"))
    assert {r["key"] for r in heads.collect()} == {"កាខ", "ឬ", "ខុស"}
    definition = "(ន.) កាខ គឃ គឃ​គឃ គឃ គឃ ល. គឃ /a: កាខគឃកាខគឃកាខ ។"
    definitions = spark.createDataFrame([(1, "កាខ", definition), (20, "ខុស", "(កិ.) : កាខគឃ គឃ កាខគឃ ។ x")], "id int, word string, definition string")
    assert {r["key"]: r["p"] for r in build.definition_pos(definitions).collect()} == {"កាខ": 1, "ខុស": 2}
    examples, rest = build.held_out(definitions)
    assert [r["text"] for r in examples.collect()] == ["កាខគឃ គឃ កាខគឃ"] and [r["id"] for r in rest.collect()] == [1]
    counts = {r["key"]: (r["n"], r["abbreviations"]) for r in build.frequencies(build.corpus_tokens(rest)).collect()}
    assert counts["គឃ"] == (6, 0) and counts["ល"] == (0, 1)
    assert {(r["a"], r["b"]): r["n"] for r in build.pairs(rest).collect()} == {("គឃ", "គឃ"): 4}
    wrong = spark.createDataFrame([("ខុស", "កាខ"), ("x", "គឃ"), ("y", "ងង")], "wrong string, correct string")
    made = build.build(heads, definitions, [build.listed_words(spark.createDataFrame([("ចាន, ឆាន",)], "value string"))], wrong)
    assert {r["key"]: (r["f"], r["n"], r["p"]) for r in made.collect()} == {"កាខ": (1, 1, 1), "ឬ": (1, 0, 0), "គឃ": (2, 6, 0), "ចាន": (4, 0, 0), "ឆាន": (4, 0, 0)}
    assert sorted(map(tuple, build.problems(made, wrong, spark.createDataFrame([("ការចាន",), ("ការងារ",)], "correct string")).collect())) == [("គឃ", build.MISSING_ROWS[1]), ("ងង", build.MISSING_ROWS[0]), ("ងារ", build.MISSING_ROWS[2])]
    rules = spark.createDataFrame([("p", "3", "w", "yes"), (None, "3", "w", "yes"), ("p", "3", "w", "no")], "verified_by string, pdf_page string, wrong string, machine_checkable string")
    assert build.usable_rules(rules).count() == 1

"""Segmentation, corrections, readers and streams against brute force and small fixtures."""

import io
import itertools
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import meaning, normalize, tokens
from textloom.operators import findings, surface
from textloom.sources import readers
from textloom.streaming import checks


def test_segments_are_cheapest():
    costs = {"ab": 1.0, "a": 1.5, "b": 1.2, "abc": 2.4, "cd": 0.9, "d": 1.0}
    for n in range(1, 7):
        for parts in itertools.product("abcx", repeat=n):
            words = tokens.segment_run(list(parts), list(parts), costs)
            assert "".join(w for w, _ in words) == "".join(parts)
            assert all(known == (w in costs) for w, known in words if known or len(w) == 1)
            best = min(sum(costs.get(x, 2.0 if len(x) == 1 else math.inf) for x in cut) for cut in _cuts("".join(parts)))
            assert sum(costs[w] if known else 2.0 * len(w) for w, known in words) == pytest.approx(best)


def _cuts(s):
    if not s:
        yield ()
    for k in range(1, len(s) + 1):
        for rest in _cuts(s[k:]):
            yield (s[:k], *rest)


def test_chunks_cover_the_text(spark):
    text = "ខ្ញុំ ៗ​​ 1,2.5 abc\r\n។?! ែក"
    rows = tokens.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("chunk_at").collect()
    assert "".join(r["chunk"] for r in rows) == text and all(text[r["start"] :].startswith(r["chunk"]) for r in rows)
    assert {"khmer", "space", "repeat", "zwsp", "number", "latin", "newline", "punct", "orphan"} == {r["kind"] for r in rows}


def test_lexicon_bound(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_LEXICON", 1)
    words = spark.createDataFrame([("ក", True, False, 1), ("ខ", True, False, 1)], "key string, authoritative boolean, misspelling boolean, n int")
    with pytest.raises(ValueError):
        tokens.segments(spark.createDataFrame([(1, "ក")], "doc_id long, text string"), words)


def test_meaning_signature(spark):
    rows = [("គាត់មិនអាចមក ៥", "5 មិនអាច"), ("គាត់មក", "គាត់មិនមក"), ("«ក» និង", "«ខ» និង")]
    got = spark.createDataFrame(rows, "a string, b string").select(meaning.meaning_signature(F.col("a")) == meaning.meaning_signature(F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_corrections_from_the_left(spark):
    docs = spark.createDataFrame([(1, "aXXbYY"), (2, "none"), (3, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, "r", 1, 3, "XX", "-"), (1, "r", 2, 4, "Xb", "!"), (1, "r", 4, 6, "YY", "")], "doc_id long, rule_id string, start long, stop long, original string, suggestion string")
    assert dict(map(tuple, findings.corrected(docs, found).collect())) == {1: "a-b", 2: "none", 3: None}


def test_visible_drops_rejected(spark):
    docs = spark.createDataFrame([(1, "a!! b ,c")], "doc_id long, text string")
    found = surface.surface_findings(docs)
    rejected = found.filter("rule_id = 'punct.repeated-mark'")
    assert [r["rule_id"] for r in findings.visible(found, rejected).collect()] == ["punct.space-before-comma"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\rthree".encode())
    assert readers.read_text(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo\nthree"
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "good.docx").write_bytes(packed.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_docx(spark, str(tmp_path)).collect()}
    assert got["good.docx"]["text"] == "one\ttwo\nthree" and got["good.docx"]["error"] is None
    assert got["bad.docx"]["text"] is None and got["bad.docx"]["error"]
    (tmp_path / "list.tsv").write_text("# note\nក\tខ\n")
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "list.tsv"), ["wrong", "correct"]).collect()] == [("ក", "ខ")]
    (tmp_path / "words.csv").write_text("ក,x\nabc,y\nក,z\n")
    assert [r["word"] for r in readers.read_glossary(spark, str(tmp_path / "words.csv")).collect()] == ["ក"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a!! b ,c"), (2, "x??")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    checks.run_available(checks.finding_stream(checks.document_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, surface.surface_findings(docs).collect()))


def test_normalisation_matches_brute_force(spark):
    """Both forms of the normaliser against the definition, on random strings of bases and marks."""
    import random

    robat, shifters, signs = "៌", "៉៊", "ំះៈ់៍៎៏័៑៓៝"
    vowels = "".join(map(chr, range(0x17B6, 0x17C6)))

    def brute(cluster):
        for old, new in normalize.DEPRECATED.items():
            cluster = cluster.replace(old, new)
        base = cluster[:1] if "ក" <= cluster[:1] <= "ឳ" else ""
        rest, groups = cluster[len(base) :], {k: [] for k in ("robat", "sub", "ro", "shift", "vowel", "sign", "other")}
        while rest:
            c, rest = rest[0], rest[1:]
            if c == "្" and rest and "ក" <= rest[0] <= "ឳ":
                groups["ro" if rest[0] == "រ" else "sub"].append(c + rest[0])
                rest = rest[1:]
            elif c not in "឴឵‌‍":
                groups["robat" if c == robat else "shift" if c in shifters else "vowel" if c in vowels else "sign" if c in signs else "other"].append(c)
        join = {k: "".join(v if k in ("robat", "other") else dict.fromkeys(v)) for k, v in groups.items()}
        join["vowel"] = join["vowel"].replace("េី", "ើ").replace("េា", "ោ")
        return base + "".join(join.values())

    rng = random.Random(3)
    marks = robat + shifters + signs + vowels + "្" * 9 + "ករប឴‌"
    words = ["ក៉៉", "ឨា", *("".join(rng.choice("កសឨឣឲ") + "".join(rng.choice(marks) for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(300))]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", normalize.word_key(F.col("w")).alias("k"), F.transform(normalize.clusters(F.col("w")), normalize.normalize_cluster).alias("c"), normalize.fold_key(F.col("w")).alias("f")).collect()
    for r in rows:
        parts = normalize.CLUSTERS.findall(r["w"])
        assert r["c"] == [brute(x) for x in parts] == [normalize.normalized(x) for x in parts]
        bare = r["w"].replace("‌", "")
        assert r["k"] == "".join(map(brute, normalize.CLUSTERS.findall(bare))) == normalize.key_of(r["w"])
        assert r["f"] == normalize.fold_of(r["w"]) and "ឲ" not in r["f"]
    assert [brute(w) for w in words[:2]] == ["ក៉", "ឧាក"]


def test_misspelled_units_are_not_known(spark):
    words = spark.createDataFrame([("ក", False, True, 0), ("ខ", True, False, 1)], "key string, authoritative boolean, misspelling boolean, n int")
    got = tokens.segments(spark.createDataFrame([(1, "កខគ x")], "doc_id long, text string"), words).collect()
    assert [(r["start"], r["word"], r["known"]) for r in got] == [(0, "ក", False), (1, "ខ", True), (2, "គ", False)]


def test_occurrences_may_overlap(spark):
    docs = spark.createDataFrame([(1, "ananan"), (2, "an an"), (3, "a.c"), (4, None)], "doc_id long, text string")
    at = lambda part, n: [(r["doc_id"], r["start"], r["stop"]) for r in findings.nth_occurrence(docs, part, n).collect()]
    assert at("anan", 2) == [(1, 2, 6)] and at("an", 2) == [(1, 2, 4), (2, 3, 5)] and at("a.", 1) == [(3, 0, 2)]

"""Analysed sentences, dictionary-based rules, spelling and context punctuation, on small Khmer texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import distance, normalize
from textloom.operators import lexicon as lex
from textloom.operators import punctuation, rules, spelling, words

N, V, ADJ, PRON, PART, PREP, CONJ = 1, 2, 4, 16, 32, 256, 512
#: key, flags, frequency, parts of speech
ENTRIES = [
    ("ខ្ញុំ", 1, 50, PRON), ("គាត់", 1, 40, PRON), ("អ្នក", 1, 40, PRON), ("គេ", 1, 30, PRON), ("ទៅ", 1, 60, V), ("មក", 1, 60, V), ("សាលារៀន", 1, 9, N), ("ផ្សារ", 1, 9, N), ("សៀវភៅ", 1, 9, N),
    ("ទិញ", 1, 20, V), ("និង", 1, 90, CONJ), ("នឹង", 1, 90, PART), ("ដែល", 1, 90, PART), ("ដែរ", 1, 90, PART), ("មិន", 1, 90, PART), ("តើ", 1, 30, PART), ("ទេ", 1, 90, PART), ("ហើយ", 1, 90, CONJ),
    ("ឆ្ងាញ់", 1, 5, ADJ), ("ធំ", 1, 20, ADJ), ("តូច", 1, 20, ADJ), ("ម្សិលមិញ", 1, 5, 8), ("ស្អែក", 1, 5, 8), ("ព្រឹក", 1, 5, N), ("ល្ងាច", 1, 5, N), ("សិស្ស", 1, 9, N), ("មាន", 1, 90, V), ("នាក់", 1, 9, 128),
    ("ពិនិត្យ", 1, 9, V), ("ឯកសារ", 1, 9, N), ("កុំព្យូទ័រ", 8, 3, N), ("សមត្ថភាព", 1, 9, N), ("សមត្ត", 4, 0, 0), ("ភាព", 4, 1, N), ("ការិយាល័យ", 1, 9, N), ("លោក", 1, 30, PRON), ("ចង់", 1, 30, V), ("បាន", 1, 60, PART),
    ("ឱ្យ", 1, 30, V), ("មិនត្រឹមតែ", 1, 3, PART), ("រៀន", 1, 9, V), ("ពូកែ", 1, 9, ADJ), ("អត់", 1024, 3, PART), ("ដឹង", 1, 9, V), ("សេចក្ដី", 1, 9, N), ("សេចក្តី", 2, 9, N), ("របស់", 1, 50, PREP), ("ល្អ", 1, 9, ADJ),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(normalize.key_of(k), f, n, p) for k, f, n, p in ENTRIES]
    return spark.createDataFrame(rows, lex.LEXICON).cache()


def analysed(spark, lexicon, texts, phrases=()):
    return words.analysed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, list(phrases))


def test_sentences_hold_every_token_once(spark, lexicon):
    texts = [None, "", "ខ្ញុំទៅសាលារៀន។ គាត់មក?\nabc 12 ក្រញ៉ាំ៖x", "។។", "ខ្ញុំ​ទៅ"]
    got = analysed(spark, lexicon, texts).orderBy("doc_id", "sent").collect()
    assert [(r["doc_id"], r["sent"], r["terminator"], [w["text"] for w in r["words"]]) for r in got] == [
        (2, 0, "។", ["ខ្ញុំ", "ទៅ", "សាលារៀន"]), (2, 1, "?", ["គាត់", "មក"]), (2, 2, "៖", ["ក្រញ៉ាំ"]), (4, 0, None, ["ខ្ញុំ", "ទៅ"]),
    ]
    for r in got:
        text = texts[r["doc_id"]]
        assert text[r["start"] : r["stop"]] == r["text"] and all(text[w["start"] : w["stop"]] == w["text"] for w in r["words"])
    assert [w["known"] for w in got[2]["words"]] == [False] and got[2]["numbers"][0]["text"] == "12"
    assert [w["joined"] for w in got[0]["words"]] == [False, True, True] and [w["joined"] for w in got[3]["words"]] == [False, False]


def test_phrases_stand_at_word_borders(spark, lexicon):
    got = analysed(spark, lexicon, ["ខ្ញុំទៅ សាលារៀន", "ទៅសាលារៀន"], ["ទៅសាលារៀន", "ញុំទៅ"]).orderBy("doc_id").collect()
    assert [[(p["id"], p["i"], p["j"]) for p in r["phrases"]] for r in got] == [[(0, 1, 2)], [(0, 0, 1)]]


@pytest.mark.parametrize(
    ("text", "rule", "original", "suggestion"),
    [
        ("ខ្ញុំនិងទៅផ្សារ។", "grammar.ning-neung", "និង", "នឹង"),
        ("ខ្ញុំនឹងគាត់។", "grammar.neung-ning", "នឹង", "និង"),
        ("ខ្ញុំទៅដែល។", "grammar.dael-dae", "ដែល", "ដែរ"),
        ("សៀវភៅដែរខ្ញុំទិញ។", "grammar.dae-dael", "ដែរ", "ដែល"),
        ("ខ្ញុំទៅទៅផ្សារ។", "repetition.adjacent", "ទៅទៅ", "ទៅ"),
        ("ម្សិលមិញគាត់នឹងទៅផ្សារ។", "grammar.tense-conflict", "នឹង", "បាន"),
        ("តើអ្នកទៅផ្សារ។", "missing.question-word", "តើអ្នកទៅផ្សារ។", "តើអ្នកទៅផ្សារទេ?"),
        ("មានសិស្ស ២០ មក។", "missing.classifier", "២០", "២០ នាក់"),
        ("ខ្ញុំសាលារៀនទៅ។", "structure.motion-verb-order", "សាលារៀនទៅ", "ទៅសាលារៀន"),
        ("សៀវភៅដែលគាត់ដែលខ្ញុំដែលទិញទៅ។", "clarity.nested-relatives", "ដែល", None),
    ],
)
def test_grammar_rules(spark, lexicon, text, rule, original, suggestion):
    got = {r["rule_id"]: r for r in rules.grammar(analysed(spark, lexicon, [text])).collect()}
    assert rule in got and got[rule]["original"] == original == text[got[rule]["start"] : got[rule]["stop"]]
    assert (got[rule]["suggestions"] or [None])[0] == suggestion


def test_clean_text_has_no_findings(spark, lexicon):
    s = analysed(spark, lexicon, ["ខ្ញុំទៅសាលារៀន។", "តើអ្នកទៅទេ?", "ខ្ញុំនិងគាត់ទៅផ្សារ។", "គាត់ទៅមិនទៅ?", "តូចធំៗ", "", "Hello world."])
    assert rules.grammar(s).count() == 0 and rules.meaning(s, lexicon).count() == 0


def test_long_sentences_and_formal_mode(spark, lexicon):
    long = "ខ្ញុំទៅផ្សារ" * 7 + " ហើយគាត់" + "ទៅផ្សារ" * 11 + "។"
    got = {r["rule_id"]: r for r in rules.grammar(analysed(spark, lexicon, [long])).collect()}
    assert got["clarity.split-sentence"]["suggestions"] == ["ផ្សារ។ "] and got["clarity.split-sentence"]["original"] == "ផ្សារ ហើយ"
    plain = {r["rule_id"] for r in rules.grammar(analysed(spark, lexicon, ["សៀវភៅ" * 41])).collect()}
    assert "clarity.long-sentence" in plain
    s = analysed(spark, lexicon, ["សៀវភៅឯកសារផ្សារ។"])
    assert rules.grammar(s).count() == 0 and [r["rule_id"] for r in rules.grammar(s, "legal").collect()] == ["structure.no-predicate"]


@pytest.mark.parametrize(
    ("text", "rule", "original", "suggestions"),
    [
        ("ម្សិលមិញស្អែកខ្ញុំទៅ។", "meaning.time-conflict", "ម្សិលមិញស្អែក", ["ម្សិលមិញ", "ស្អែក"]),
        ("ព្រឹកល្ងាចខ្ញុំទៅ។", "meaning.time-of-day-conflict", "ព្រឹកល្ងាច", ["ព្រឹក", "ល្ងាច"]),
        ("គាត់មកមិនមក។", "meaning.x-not-x", "មកមិនមក", ["មក", "មិនមក"]),
        ("សាលារៀនធំតូច។", "meaning.opposites", "ធំតូច", ["ធំ", "តូច"]),
    ],
)
def test_meaning_rules(spark, lexicon, text, rule, original, suggestions):
    assert [(r["rule_id"], r["original"], r["suggestions"]) for r in rules.meaning(analysed(spark, lexicon, [text]), lexicon).collect()] == [(rule, original, suggestions)]


def test_openings_are_reported_once_at_the_end_of_a_run(spark, lexicon):
    text = "ខ្ញុំទៅផ្សារ។ ខ្ញុំទិញសៀវភៅ។ ខ្ញុំទៅសាលារៀន។ គាត់ទៅផ្សារ។"
    got = rules.openings(analysed(spark, lexicon, [text])).collect()
    assert [(r["sent"], text[r["start"] : r["stop"]], r["suggestions"]) for r in got] == [(2, "។ ខ្ញុំ", [" ហើយ"])]


def test_style_correlatives_and_register(spark, lexicon):
    s = analysed(spark, lexicon, ["គាត់មិនត្រឹមតែរៀនពូកែ។", "ខ្ញុំអត់ដឹងទេ។", "គេទៅ។"], ["មិនត្រឹមតែ", "អត់ដឹង"])
    rows = [{"rule_id": "style.phrase", "pattern": "អត់ដឹង", "suggestions": ["មិនដឹង"], "severity": "suggestion", "confidence": 0.4, "category": "wording"}]
    found = rules.found(s, rules.correlatives({"មិនត្រឹមតែ": 0}), rules.phrase_hits(1, rows, rules.cut_keeps_sentence), rules.register_hits([{"informal": "អត់", "suggestions": ["មិន"]}], True), rules.unclear_actor(), rules.first_person(), rules.question_marks())
    assert sorted((r["doc_id"], r["rule_id"], r["original"]) for r in found.collect()) == [(0, "missing.correlative", "មិនត្រឹមតែ"), (1, "style.phrase", "អត់ដឹង"), (1, "wording.academic-first-person", "ខ្ញុំ"), (1, "wording.register", "អត់"), (2, "legal.unclear-actor", "គេ")]


def spelled(spark, lexicon, text, wrong=(), strict=False):
    s = analysed(spark, lexicon, [text], [w["wrong"] for w in wrong])
    pairs = spark.createDataFrame([], "a string, b string, n long")
    return [(r["rule_id"], text[r["start"] : r["stop"]], r["suggestions"], r["severity"], r["confidence"]) for r in spelling.spelling(s, lexicon, pairs, wrong, strict).orderBy("start").collect()]


def test_spelling(spark, lexicon):
    rule, original, given, severity, sure = spelled(spark, lexicon, "ខ្ងុំទៅសាលារៀន។")[0]
    assert (rule, original, given[0], severity) == ("spelling.dictionary", "ខ្ងុំ", "ខ្ញុំ", "error") and sure >= 0.8
    for text, wrong, right in (("គាត់បានពិនិត្សឯកសារ។", "ពិនិត្ស", "ពិនិត្យ"), ("ខ្ញុំចង់ទិញកំព្យូទ័រ។", "កំព្យូទ័រ", "កុំព្យូទ័រ"), ("ការិយាល៏យ", "ការិយាល៏យ", "ការិយាល័យ")):
        assert [x[1:3] for x in spelled(spark, lexicon, text)] == [(wrong, [right])]
    assert spelled(spark, lexicon, "សមត្តភាពរបស់គាត់ល្អ។") == [("spelling.split-word", "សមត្តភាព", ["សមត្ថភាព"], "error", 0.55)]
    assert spelled(spark, lexicon, "លោក ឡុងវីន បានមក។") == []  # a name after a title
    assert [x[0] for x in spelled(spark, lexicon, "គាត់ទិញហ្វ្លូរីដា។")] == ["spelling.unknown"]
    assert spelled(spark, lexicon, "ខ្ញុំទៅសាលារៀន។") == []


def test_listed_misspellings_come_first_and_variants_last(spark, lexicon):
    wrong = [{"wrong": "អោយ", "correct": "ឱ្យ", "confidence": 0.85}]
    more = lex.marked_misspellings(lexicon, spark.createDataFrame([("អោយ",)], "wrong string"))
    assert [x[:3] for x in spelled(spark, more, "គាត់អោយខ្ញុំ។", wrong)] == [("spelling.curated", "អោយ", ["ឱ្យ"])]
    assert spelled(spark, lexicon, "សេចក្តីល្អ។") == []
    assert [x[:3] for x in spelled(spark, lexicon, "សេចក្តីល្អ។", strict=True)] == [("spelling.variant", "សេចក្តី", ["សេចក្ដី"])]


def test_candidates_match_all_pairs(spark, lexicon):
    rng = random.Random(7)
    keys = [normalize.key_of(k) for k, f, _, _ in ENTRIES]
    asked = {normalize.key_of("".join(c for c in k if rng.random() > 0.15) + rng.choice(["", "ា", "ក"])) for k in keys for _ in range(4)} - {""}
    rows = lex.candidates(spark.createDataFrame([(k,) for k in asked], "key string"), lexicon, limit=99).collect()
    got = {}
    for r in rows:
        got.setdefault(r["key"], {})[r["candidate"]] = r["distance"]
    for k in asked:
        u = distance.units_of(k)
        most = distance.most_for(len(u))
        near = {x: d for x in keys if 0 < (d := distance.weighted_distance(u, distance.units_of(x))) <= most}
        home = {x: d for x, d in near.items() if distance.sound_bucket(x) == distance.sound_bucket(k)}
        expected = home or (near if len(u) >= 4 else {})
        assert got.get(k, {}) == {x: round(d, 2) for x, d in expected.items()}


def test_distance_is_symmetric_and_bounded_by_signatures():
    rng = random.Random(8)
    letters = "កគខឃាីិុូ្តដ់័ំ"
    for _ in range(500):
        a, b = (distance.units_of("".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))) for _ in range(2))
        d = distance.weighted_distance(a, b)
        assert abs(d - distance.weighted_distance(b, a)) < 1e-9 and (d == 0) == (a == b)
        assert not distance.too_far(distance.signature(a), distance.signature(b), d)
        assert distance.weighted_distance(a, b, d) == d
    assert distance.weighted_distance(distance.units_of("ពិនិត្ស"), distance.units_of("ពិនិត្យ")) <= 1


def test_lexicon_operators(spark):
    rows = [("កាខ", 1, 2, 0), ("កា", 1, 5, 2), ("ខ", 4, 1, 1), ("គ", 4, 1, 0), ("ស្ដី", 1, 1, 1), ("ស្តី", 2, 4, 1), ("ឃ", 512, 0, 0)]
    table = spark.createDataFrame(rows, lex.LEXICON)
    assert {r["key"]: r["p"] for r in lex.with_inherited_pos(table).collect()}["កាខ"] == 2
    flags = table.select("key", lex.known(F.col("f")).alias("known"), lex.weak(F.col("f"), F.col("n")).alias("weak"), lex.primary_source(F.col("f")).alias("source")).collect()
    assert {r["key"]: (r["known"], r["weak"], r["source"]) for r in flags} == {"កាខ": (True, False, "headword"), "កា": (True, False, "headword"), "ខ": (True, True, "wordlist"), "គ": (True, True, "wordlist"), "ស្ដី": (True, False, "headword"), "ស្តី": (True, False, "attested"), "ឃ": (False, True, None)}
    assert [r["forms"] for r in lex.variant_groups(table).collect()] == [sorted(["ស្ដី", "ស្តី"])]
    assert {(r["key"], r["variant"]) for r in lex.variants(table).collect()} == {("ស្ដី", "ស្តី"), ("ស្តី", "ស្ដី")}
    assert lex.authoritative(table).count() == 3
    added = lex.with_words(table, spark.createDataFrame([("ចាន កូវ​ខ abc",)], "value string"))
    assert {r["key"] for r in added.filter(lex.bits(F.col("f"), 256)).collect()} == {"ចាន", "កូវ", "ខ"}


def test_context_punctuation_matches_brute_force(spark):
    rng = random.Random(11)
    texts = ["ខ្ញុំទៅ. គាត់", "៣.១៤ គ.ស.", "ឃើញ: ក", "ឃើញ :\n", "ក។ខ ។ល។ក", "ៗក «ៗ ក ៗ", "ខ្ញុំ " * 20 + "ទៅ", "- " + "ខ្ញុំ " * 20, None, "", "abc.", "កា់ិ ា"]
    texts += ["".join(rng.choice("កខលំា។.: ៗ\n«?ab") for _ in range(40)) for _ in range(150)]
    kh = "[ក-៝]"

    def brute(t):
        out = set()
        for i, c in enumerate(t):
            rest = t[i + 1 :].lstrip(" \t")
            if c == "." and re.fullmatch(kh + "{3}", t[max(0, i - 3) : i]) and (not rest or rest[0] == "\n" or "ក" <= rest[0] <= "៿"):
                out.add(("punct.latin-period", i))
            before = t[i - 1 : i] if t[i - 1 : i] not in (" ", "\t") else t[max(0, i - 2) : i - 1]
            if c == ":" and i and before and re.fullmatch(kh, before) and (not rest or rest[0] in "\n-•" or "ក" <= rest[0] <= "៿"):
                out.add(("punct.latin-colon", i))
            if c == "។" and re.match("[ក-ឳ]", t[i + 1 :]) and t[i + 1] != "ល" and t[max(0, i - 2) : i] != "។ល":
                out.add(("punct.space-after-khan", i))
        for m in re.finditer("(?:\\A|[\n។៕?!«(])[ \t]*ៗ", t):
            out.add(("punct.lek-too-without-word", m.end() - 1))
        at = 0
        for line in t.split("\n"):
            x = line.rstrip().rstrip("​")
            if len(x) >= 60 and len(re.findall("[ក-ឳ]+", x)) >= 4 and not re.match(r"\s*[-•*–]", x) and re.search("[ក-៓៝]$", x):
                out.add(("punct.missing-final-khan", at + re.search("[ក-៓៝]+$", x).start()))
            at += len(line) + 1
        for m in normalize.CLUSTERS.finditer(t):
            if not "ក" <= m[0][0] <= "ឳ":
                out.add(("unicode.orphan-mark", m.start()))
            elif normalize.normalized(m[0]) != m[0]:
                out.add(("unicode.cluster-order", m.start()))
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in punctuation.context_findings(docs).collect():
        assert texts[r["doc_id"]][r["start"] : r["stop"]] == r["original"]
        got[r["doc_id"]].add((r["rule_id"], r["start"]))
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}

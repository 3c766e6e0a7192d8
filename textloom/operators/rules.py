"""Rules over analysed sentences (words.analysed): meaning, grammar, structure, style and legal wording.

Each rule is an expression over a row's words that gives an array of hits; all rules of a call are read in one scan, without
a shuffle (only runs of equal openings need a window over a document's sentences).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.spans import let
from textloom.operators.lexicon import AUTHORITATIVE, POS, bits, known

HIT = "array<struct<rule_id:string,start:bigint,stop:bigint,suggestions:array<string>,severity:string,confidence:double>>"
FORMAL = ("academic", "government", "administrative", "legal")

# Word lists of the rules.
PAST = ("ម្សិលមិញ", "ម្សិលម្ងៃ", "ម្សិល", "កាលពី", "កន្លងទៅ", "កន្លងមក")
FUTURE = ("ស្អែក", "ថ្ងៃស្អែក", "ខានស្អែក")
TIME_UNITS = ("សប្ដាហ៍", "សប្តាហ៍", "ខែ", "ឆ្នាំ", "ថ្ងៃ")
TIMES_OF_DAY = ("ព្រឹក", "ថ្ងៃត្រង់", "រសៀល", "ល្ងាច", "យប់", "អាធ្រាត្រ")
OPPOSITES = (("ក្ដៅ", "ត្រជាក់"), ("ក្តៅ", "ត្រជាក់"), ("មូល", "ជ្រុង"), ("រត់", "អង្គុយ"), ("ធំ", "តូច"), ("វែង", "ខ្លី"), ("ខ្ពស់", "ទាប"), ("ជិត", "ឆ្ងាយ"), ("ចាស់", "ថ្មី"), ("ល្អ", "អាក្រក់"), ("ស្ងួត", "សើម"), ("ពិត", "មិនពិត"), ("រស់", "ស្លាប់"), ("ឆ្អែត", "ឃ្លាន"))
TAKES_NEUNG = ("ទាក់ទង", "ស្មើ", "ជាប់", "ដូច", "ដូចគ្នា", "ប្រឆាំង", "យល់ស្រប", "ស្រប", "ទល់", "ប្រៀបធៀប", "ត្រូវ", "ផ្ទុយ", "ជួប", "ប៉ះ", "ប្រទះ", "ភ្ជាប់", "សម", "សមស្រប", "ជាមួយ", "ព្រម", "រួម", "ទៅ", "តប", "ឆ្លើយតប", "ទប់ទល់", "ទាស់", "ស្និទ្ធ", "ស៊ាំ", "ប្រកួត", "ច្រឡំ", "ទម្លាប់", "ស្គាល់", "ជិត", "ក្បែរ", "អាស្រ័យ", "ជំពាក់", "ខឹង", "ពេញចិត្ត", "ភ្ញាក់ផ្អើល", "ចាប់អារម្មណ៍", "ប្រើ", "ឆ្លើយ", "ស្រដៀង", "ធៀប")
MODAL = ("មិន", "ពុំ", "អាច", "ត្រូវ", "បាន", "ចង់", "គួរ", "ធ្វើ", "ទៅ", "មក", "ក្លាយ", "ក្លាយជា", "ទទួល", "ចាប់ផ្ដើម", "បន្ត")
BEFORE_DAEL = ("មិន", "ពុំ", "មិនទាន់", "ពុំទាន់", "ធ្លាប់", "មិនដែល", "ពុំដែល", "មិនធ្លាប់")
QUESTION = ("អ្វី", "ណា", "ទេ", "ឬ", "ប៉ុន្មាន", "ម្ដេច", "ម្តេច", "ម៉េច", "ខ្លះ", "មែន", "នៅ", "ឬក៏", "ប៉ុណ្ណា", "ហេតុអី")
HUMAN = ("សិស្ស", "និស្សិត", "គ្រូ", "គ្រូបង្រៀន", "មនុស្ស", "កុមារ", "បុគ្គលិក", "មន្ត្រី", "កម្មករ", "កម្មការិនី", "អ្នកចូលរួម", "សមាជិក", "ពលរដ្ឋ", "ក្មេង", "អ្នកជំងឺ", "អតិថិជន", "វិនិយោគិន", "បុរស", "ស្ត្រី", "នារី", "យុវជន", "សាក្សី", "ចៅក្រម", "មេធាវី", "និយោជិត", "អ្នកស្រុក")
CLASSIFIERS = ("នាក់", "រូប", "អង្គ", "ព្រះអង្គ", "ក្រុម", "គ្រួសារ", "ជំនាន់", "ថ្នាក់", "ភាគរយ")
PAST_MARKERS = ("ម្សិលមិញ", "ម្សិលម្ងៃ", "ឆ្នាំមុន", "ខែមុន", "សប្ដាហ៍មុន", "សប្តាហ៍មុន", "កាលពី")
LATER = ("ក្រោយ", "ស្អែក", "អនាគត")
CLAUSE = ("ហើយ", "ប៉ុន្តែ", "ប៉ុន្ដែ", "តែ", "រួច")
CORRELATIVES = {"មិនត្រឹមតែ": ("ថែមទាំង", "ប៉ុណ្ណោះ", "ប៉ុន្តែ", "ប៉ុន្ដែ", "តែ", "ក៏", "ផងដែរ", "ទៀត"), "ទោះបី": ("ក៏", "ក្ដី", "ក្តី", "តែ", "ប៉ុន្តែ", "ប៉ុន្ដែ", "នៅតែ")}
SPLIT_AT = ("ហើយ", "ប៉ុន្តែ", "ប៉ុន្ដែ", "ដូច្នេះ", "ដោយហេតុនេះ", "លើសពីនេះ", "ម្យ៉ាងទៀត")
NO_SPLIT_AFTER = ("ដែល", "ថា", "និង", "ឬ", "នៃ", "របស់", "នូវ", "ដោយ", "ពី", "នៅ", "ក្នុង", "ដល់", "ចំពោះ", "សម្រាប់", "ជា", "គឺ")
VERB_MARKS = ("បាន", "នឹង", "កំពុង", "មិន", "ត្រូវ", "អាច", "ក៏")
COPULAS = ("ជា", "គឺ", "នៅ", "របស់", "មាន", "គ្មាន")
VAGUE = ("ជាដើម", "មួយចំនួន", "ប្រហែល", "សមរម្យ", "តាមការចាំបាច់")
VAGUE_REPEATED = r"ឆាប់ៗ|ផ្សេងៗ"
LONG = 40


def has(w: Column, *names: str) -> Column:
    return bits(F.coalesce(w["p"], F.lit(0)), sum(POS[n] for n in names))


def pronoun(w: Column) -> Column:
    return has(w, "PRON")


def verbish(w: Column) -> Column:
    return has(w, "V", "ADJ")


def verb_only(w: Column) -> Column:
    return has(w, "V") & ~has(w, "N", "PRON")


def noun_only(w: Column) -> Column:
    return has(w, "N") & ~has(w, "V", "ADJ", "PRON", "PREP")


def one_of(w: Column, words) -> Column:
    return F.coalesce(w["key"], F.lit("")).isin(*words)


def spaced(w: Column) -> Column:
    """Only blanks, one at least, between a word and the one before."""
    return w["gap"].rlike(r"\A[ \t\x{200B}]+\z")


def at(i) -> Column:
    return F.get("words", i)


def there(w: Column) -> Column:
    return w["key"].isNotNull()


def hit(rule: str, start: Column, stop: Column, suggestions=None, severity: str = "warning", confidence=0.6) -> Column:
    given = F.array().cast("array<string>") if suggestions is None else F.array(*(F.lit(x) if isinstance(x, str) else x for x in suggestions)) if isinstance(suggestions, (list, tuple)) else suggestions
    value = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(rule).alias("rule_id"), start.alias("start"), stop.alias("stop"), given.alias("suggestions"), F.lit(severity).alias("severity"), value.cast("double").alias("confidence"))


def each_word(test: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """Hits of the words (with their place) that a test holds for."""
    return F.filter(F.transform("words", lambda w, i: F.when(F.coalesce(test(w, i), F.lit(False)), make(w, i))), lambda x: x.isNotNull())


def joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["key"]), "")


def any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def within(a: Column, b: Column) -> Column:
    """The text from one word to another."""
    return F.substring(F.col("text"), (a["start"] - F.col("start") + 1).cast("int"), (b["stop"] - a["start"]).cast("int"))


# --- meaning


def _time_sense(i) -> Column:
    """1 for the past, 2 for the future, with ten more where two words say it; null for neither."""
    key, then = at(i)["key"], at(i + 1)["key"]
    unit = key.isin(*TIME_UNITS)
    return (
        F.when(key.isin(*PAST, *(u + "មុន" for u in TIME_UNITS)), 1)
        .when(key.isin(*FUTURE, *(u + "ក្រោយ" for u in TIME_UNITS)), 2)
        .when(unit & (then == "មុន"), 11)
        .when(unit & (then == "ក្រោយ"), 12)
    )


def _apart(hits: Column) -> Column:
    """Hits in order without those that begin before the one kept last ends."""
    none = F.array().cast(HIT)
    return F.aggregate(hits, none, lambda done, h: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] > h["start"]), done).otherwise(F.concat(done, F.array(h).cast(HIT))))


def time_conflicts() -> Column:
    """Past and future time expressions with at most one word between them."""

    def pair(w: Column, i: Column) -> Column:
        first = _time_sense(i)
        size = F.when(first > 10, 2).otherwise(1)

        def with_(step: int) -> Column:
            j = i + size + step
            second = _time_sense(j)
            end = at(j + F.when(second > 10, 1).otherwise(0))
            return F.when(second % 10 != first % 10, hit("meaning.time-conflict", w["start"], end["stop"], [within(w, at(i + size - 1)), within(at(j), end)], confidence=0.7))

        return F.when(first.isNotNull(), F.coalesce(with_(0), with_(1)))

    return _apart(F.filter(F.transform("words", pair), lambda x: x.isNotNull()))


def _day(w: Column) -> Column:
    return F.when(w["key"].isin(*TIMES_OF_DAY), w["key"]).when(w["key"].isin(*("ពេល" + t for t in TIMES_OF_DAY)), F.regexp_replace(w["key"], "^ពេល", ""))


def time_of_day_conflicts() -> Column:
    return _apart(each_word(lambda w, i: _day(w) != _day(at(i + 1)), lambda w, i: hit("meaning.time-of-day-conflict", w["start"], at(i + 1)["stop"], [w["text"], at(i + 1)["text"]], confidence=0.65)))


def x_not_x() -> Column:
    asks = F.coalesce(F.col("terminator") == "?", F.lit(False)) | F.exists("words", lambda w: w["key"].isin("តើ", "ឬ")) | F.exists("words", lambda w: w["key"].startswith("ទោះ"))
    found = each_word(lambda w, i: (at(i + 1)["key"] == "មិន") & (at(i + 2)["key"] == w["key"]), lambda w, i: hit("meaning.x-not-x", w["start"], at(i + 2)["stop"], [w["text"], F.concat(F.lit("មិន"), w["text"])], confidence=0.7))
    return F.when(asks, F.array().cast(HIT)).otherwise(_apart(found))


def opposites(pairs_known: list[str]) -> Column:
    """Opposite words side by side; pairs_known are joined pairs that the lexicon lists as one word."""
    pairs = [f"{x}|{y}" for a, b in OPPOSITES for x, y in ((a, b), (b, a)) if x + y not in pairs_known]

    def test(w: Column, i: Column) -> Column:
        return F.concat(w["key"], F.lit("|"), at(i + 1)["key"]).isin(*pairs) & at(i + 1)["gap"].rlike(r"\A[\s\x{200B}]*\z") & ~F.coalesce(at(i + 1)["next"] == "repeat", F.lit(False))

    return _apart(each_word(test, lambda w, i: hit("meaning.opposites", w["start"], at(i + 1)["stop"], [w["text"], at(i + 1)["text"]])))


# --- grammar


def ning_neung() -> Column:
    """The conjunction between a subject and a verb, where the future marker is meant."""

    def test(w: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        subject = pronoun(before) | (~w["gap"].rlike(r"\s") & noun_only(before))
        return (w["key"] == "និង") & (i > 0) & there(after) & subject & (one_of(after, MODAL) | verb_only(after)) & ~pronoun(after)

    return each_word(test, lambda w, i: hit("grammar.ning-neung", w["start"], w["stop"], ["នឹង"], "error", F.when(pronoun(at(i - 1)), 0.75).otherwise(0.55)))


def neung_ning() -> Column:
    """The future marker between two nominals, where the conjunction is meant."""
    nominal = lambda w: pronoun(w) | noun_only(w)
    test = lambda w, i: (w["key"] == "នឹង") & (i > 0) & nominal(at(i - 1)) & nominal(at(i + 1)) & ~one_of(at(i - 1), TAKES_NEUNG) & ~verbish(at(i + 1))
    return each_word(test, lambda w, i: hit("grammar.neung-ning", w["start"], w["stop"], ["និង"], "error", F.when(pronoun(at(i - 1)) & pronoun(at(i + 1)), 0.8).otherwise(0.6)))


def dael_dae() -> Column:
    """The relative word at the end of a sentence."""
    n = F.size("words")
    last = lambda i: (i == n - 1) | ((i == n - 2) & at(i + 1)["key"].isin("ឬ", "ទេ"))
    test = lambda w, i: (w["key"] == "ដែល") & (i > 0) & ~one_of(at(i - 1), BEFORE_DAEL) & last(i)
    sure = F.exists("words", lambda w: w["key"] == "ក៏")
    return each_word(test, lambda w, i: hit("grammar.dael-dae", w["start"], w["stop"], ["ដែរ"], "error", F.when(sure, 0.85).otherwise(0.7)))


def dae_dael() -> Column:
    """«Also» between a noun and its clause."""

    def test(w: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        touching = F.regexp_replace(after["gap"], r"\x{200B}", "") == ""
        clause = pronoun(after) | (noun_only(after) & there(at(i + 2)) & verbish(at(i + 2)))
        return (w["key"] == "ដែរ") & (i > 0) & touching & has(before, "N") & ~verbish(before) & clause

    return each_word(test, lambda w, i: hit("grammar.dae-dael", w["start"], w["stop"], ["ដែល"], "error", F.when(pronoun(at(i + 1)), 0.7).otherwise(0.55)))


def repeated_words() -> Column:
    """A word twice in a row; across a blank only function words and pronouns."""
    function = lambda w: has(w, "CONJ", "PART", "PREP")

    def test(w: Column, i: Column) -> Column:
        plain = w["gap"].rlike(r"\A[\s\x{200B}]*\z")
        return (i > 0) & (at(i - 1)["key"] == w["key"]) & ~w["key"].isin("គ្នា", "ទេ") & plain & (~w["gap"].rlike(r"\s") | function(w) | pronoun(w))

    return each_word(test, lambda w, i: hit("repetition.adjacent", at(i - 1)["start"], w["stop"], [at(i - 1)["text"], F.concat(at(i - 1)["text"], F.lit("ៗ"))], "warning", F.when(function(w), 0.85).otherwise(0.7)))


def thrice() -> Column:
    """The third use of a known content word of two clusters or more in a sentence of ten words without commas."""
    counted = lambda w: w["known"] & (w["clusters"] >= 2) & ~has(w, "CONJ", "PART", "PREP", "PRON")
    keys = F.transform("words", lambda w: F.when(counted(w), w["key"]).otherwise(""))
    before = lambda k, i: F.size(F.filter(F.slice(keys, 1, i), lambda x: x == k))
    found = each_word(lambda w, i: counted(w) & (before(w["key"], i) == 2), lambda w, i: hit("repetition.sentence", w["start"], w["stop"], None, "suggestion", 0.45))
    return F.when((F.size("words") >= 10) & ~F.col("text").rlike("[,،、]"), found).otherwise(F.array().cast(HIT))


def tense_conflicts() -> Column:
    key = joined(F.col("words"))
    marker = lambda w: any_of(w["key"], PAST_MARKERS)
    places = F.filter(F.transform("words", lambda w, i: F.when(marker(w), i)), lambda i: i.isNotNull())
    past = F.coalesce(F.get(places, F.lit(0)), F.lit(-1))

    def test(w: Column, i: Column) -> Column:
        between = F.slice("words", past + 2, F.greatest(i - past - 1, F.lit(0)))
        return (w["key"] == "នឹង") & ~one_of(at(i - 1), TAKES_NEUNG) & verbish(at(i + 1)) & ~((i > past) & F.exists(between, lambda x: x["key"].isin(*CLAUSE)))

    applies = any_of(key, PAST_MARKERS) & ~key.contains("ថា") & ~any_of(key, LATER)
    return F.when(applies, each_word(test, lambda w, i: hit("grammar.tense-conflict", w["start"], w["stop"], ["បាន"], "warning", 0.5))).otherwise(F.array().cast(HIT))


def question_words() -> Column:
    """A sentence that opens as a question without a question word."""
    first, second, last = at(F.lit(0)), at(F.lit(1)), F.element_at("words", -1)
    rest = joined(F.slice("words", 2, F.size("words")))
    x_not_x_ = F.exists(F.slice("words", 2, F.size("words")), lambda w: rest.contains(F.concat(w["key"], F.lit("មិន"), w["key"])))
    stop = F.when(F.col("terminator").isNotNull(), F.col("stop")).otherwise(last["stop"])
    given = F.when(there(second), F.array(F.concat(within(first, last), F.lit("ទេ?")), F.concat(within(second, last), F.lit("។")))).otherwise(F.array().cast("array<string>"))
    return F.when((first["key"] == "តើ") & ~x_not_x_ & ~any_of(rest, QUESTION), F.array(hit("missing.question-word", first["start"], stop, given, "suggestion", 0.45)).cast(HIT)).otherwise(F.array().cast(HIT))


def question_marks() -> Column:
    first = at(F.lit(0))
    return F.when((first["key"] == "តើ") & (F.col("terminator") == "។"), F.array(hit("punct.question-mark", F.col("stop") - 1, F.col("stop"), ["?"], "suggestion", 0.6)).cast(HIT)).otherwise(F.array().cast(HIT))


def missing_classifiers() -> Column:
    """A number of people without a classifier."""
    bare = lambda x: x["before"].isin(*HUMAN) & ~(x["after"].isin(*CLASSIFIERS, "%") | (x["after_kind"] == "latin"))
    return F.transform(F.filter("numbers", bare), lambda x: hit("missing.classifier", x["start"], x["stop"], [F.concat(x["text"], F.lit(" នាក់"))], "suggestion", 0.5))


def motion_order() -> Column:
    """Pronoun, place, motion verb and the end of the sentence."""
    a, b, c = (at(F.lit(i)) for i in range(3))
    fits = (F.size("words") == 3) & pronoun(a) & noun_only(b) & c["key"].isin("ទៅ", "មក") & F.col("terminator").isNotNull()
    return F.when(fits, F.array(hit("structure.motion-verb-order", b["start"], c["stop"], [F.concat(c["text"], b["text"])])).cast(HIT)).otherwise(F.array().cast(HIT))


def long_sentences() -> Column:
    """Over LONG words: a place to split at (a connector with a subject after it, else a subject and its verb after a blank),
    eight words from both ends and the nearest to the middle; without one only the length is said."""
    n = F.size("words")
    inner = lambda i: (i >= 8) & (i < n - 8)
    subject = lambda w: pronoun(w) | (has(w, "N") & ~verb_only(w))
    connector = lambda w, i: inner(i) & w["key"].isin(*SPLIT_AT) & spaced(w) & (pronoun(at(i + 1)) | (subject(at(i + 1)) & ~one_of(at(i + 1), MODAL)))

    def open_clause(w: Column, i: Column) -> Column:
        prev, after = at(i - 1), at(i + 1)
        before = F.substring(F.col("text"), F.lit(1), (w["start"] - F.col("start")).cast("int"))
        inside = F.regexp_count(before, F.lit("[(«]")) > F.regexp_count(before, F.lit("[)»]"))
        return inner(i) & spaced(w) & ~one_of(prev, NO_SPLIT_AFTER) & ~has(prev, "PREP", "CONJ") & ~inside & subject(w) & (verb_only(after) | one_of(after, VERB_MARKS))

    def nearest(test) -> Column:
        places = F.filter(F.transform("words", lambda w, i: F.when(F.coalesce(test(w, i), F.lit(False)), F.struct(F.abs(i - n / 2).alias("d"), i.alias("i")))), lambda x: x.isNotNull())
        return F.array_min(places)["i"]

    def split(i: Column, j: Column) -> Column:
        w, prev = at(i), at(i - 1)
        drop = w["key"] == "ហើយ"
        with_word = hit("clarity.split-sentence", prev["start"], F.when(drop, at(i + 1)["start"]).otherwise(w["stop"]), [F.concat(prev["text"], F.lit("។ "), F.when(drop, "").otherwise(w["text"]))], "suggestion", 0.45)
        before_subject = hit("clarity.split-sentence", at(j - 1)["start"], at(j)["start"], [F.concat(at(j - 1)["text"], F.lit("។ "))], "suggestion", 0.4)
        said = hit("clarity.long-sentence", at(F.lit(0))["start"], at(F.least(n - 1, F.lit(5)))["stop"], None, "suggestion", 0.5)
        return F.array(F.when(i.isNotNull(), with_word).when(j.isNotNull(), before_subject).otherwise(said)).cast(HIT)

    found = let(nearest(connector), lambda i: let(nearest(open_clause), lambda j: split(i, j)))
    return F.when(n > LONG, found).otherwise(F.array().cast(HIT))


def nested_relatives() -> Column:
    found = F.filter("words", lambda w: w["key"] == "ដែល")
    third = F.get(found, F.lit(2))
    return F.when(F.size(found) >= 3, F.array(hit("clarity.nested-relatives", third["start"], third["stop"], None, "suggestion", 0.45)).cast(HIT)).otherwise(F.array().cast(HIT))


def no_predicate() -> Column:
    """A finished sentence of known words without verb, adjective or copula."""
    fits = (F.col("terminator") == "។") & (F.size("words") >= 3) & F.forall("words", lambda w: w["known"] | w["wrong"]) & ~F.exists("words", lambda w: verbish(w) | w["key"].isin(*COPULAS))
    return F.when(fits, F.array(hit("structure.no-predicate", at(F.lit(0))["start"], F.element_at("words", -1)["stop"], None, "info", 0.35)).cast(HIT)).otherwise(F.array().cast(HIT))


def correlatives(ids: dict[str, int]) -> Column:
    """An opener of a pair without its second half in the rest of the sentence; ids are its numbers among the phrases."""
    key = joined(F.col("words"))

    def one(opener: str) -> Column:
        closed = lambda p: any_of(joined(F.slice("words", p["j"] + 2, F.size("words"))), CORRELATIVES[opener])
        hits = F.filter("phrases", lambda p: (p["id"] == ids[opener]) & ~closed(p) & (F.lit(opener != "ទោះបី") | ~key.contains("ក៏ដោយ")))
        return F.transform(hits, lambda p: hit("missing.correlative", at(p["i"])["start"], at(p["j"])["stop"], [""] if opener == "មិនត្រឹមតែ" else None, "suggestion", 0.45))

    return F.concat(*(one(o).cast(HIT) for o in ids))


# --- style


def phrase_hits(first: int, rows: list[dict], keep: Callable[[Column, dict], Column] | None = None) -> Column:
    """Hits of listed phrases; rows have rule_id, suggestions, severity, confidence; their numbers start at ``first``."""
    out = []
    for n, r in enumerate(rows):
        found = F.filter("phrases", lambda p: (p["id"] == first + n) & (keep(p, r) if keep else F.lit(True)))  # noqa: B023
        out.append(F.transform(found, lambda p: hit(r["rule_id"], at(p["i"])["start"], at(p["j"])["stop"], r["suggestions"], r["severity"], float(r["confidence"]))).cast(HIT))  # noqa: B023
    return F.concat(*out) if out else F.array().cast(HIT)


# Words after or before a phrase that forbid cutting it.
NOUN_MODIFIERS = ("នៃ", "ជា", "ណាមួយ", "ណា", "ដែល", "ដ៏", "នេះ", "នោះ", "មួយ", "ទាំងនេះ", "ទាំងនោះ", "ខ្លះ", "ច្រើន", "តិចតួច")
NEGATORS = ("មិន", "ពុំ", "គ្មាន", "អត់")


def cut_keeps_sentence(p: Column, row: dict) -> Column:
    """Whether a wordy phrase can be cut: no modifier follows, and a clause that opens with it has a subject."""
    ok = ~one_of(at(p["j"] + 1), NOUN_MODIFIERS)
    if row["pattern"].startswith("មានការ"):
        ok = ok & (p["i"] > 0) & ~one_of(at(p["i"] - 1), NEGATORS)
    return ok if row.get("category") == "wording" else F.lit(True)


def register_hits(words: list[dict], formal: bool) -> Column:
    """Colloquial words in a mode where they are flagged: rows (informal, suggestions)."""
    out = F.array().cast(HIT)
    for r in words:
        found = each_word(lambda w, i: w["known"] & (w["key"] == r["informal"]), lambda w, i: hit("wording.register", w["start"], w["stop"], r["suggestions"], "warning" if formal else "suggestion", 0.7 if formal else 0.55))  # noqa: B023
        out = F.concat(out, found.cast(HIT))
    return out


def unclear_actor() -> Column:
    first = at(F.lit(0))
    return F.when(first["key"] == "គេ", F.array(hit("legal.unclear-actor", first["start"], first["stop"], None, "info", 0.45)).cast(HIT)).otherwise(F.array().cast(HIT))


def first_person() -> Column:
    first = at(F.lit(0))
    return F.when(first["key"] == "ខ្ញុំ", F.array(hit("wording.academic-first-person", first["start"], first["stop"], None, "info", 0.35)).cast(HIT)).otherwise(F.array().cast(HIT))


GRAMMAR = (ning_neung, neung_ning, dael_dae, dae_dael, repeated_words, thrice, tense_conflicts, question_words, missing_classifiers, motion_order, long_sentences, nested_relatives)
MEANING = (time_conflicts, time_of_day_conflicts, x_not_x)


def found(sentences: DataFrame, *rules: Column) -> DataFrame:
    """(doc_id, sent, rule_id, start, stop, original, suggestions, severity, confidence) of all hits of the rules."""
    hits = sentences.select("doc_id", "sent", F.col("start").alias("begin"), "text", F.explode(F.concat(*(r.cast(HIT) for r in rules))).alias("h"))
    original = F.substring("text", (F.col("h.start") - F.col("begin") + 1).cast("int"), (F.col("h.stop") - F.col("h.start")).cast("int"))
    return hits.select("doc_id", "sent", "h.rule_id", "h.start", "h.stop", original.alias("original"), "h.suggestions", "h.severity", "h.confidence")


def meaning(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    pairs = [x + y for a, b in OPPOSITES for x, y in ((a, b), (b, a))]
    listed = [r["key"] for r in lexicon.filter(F.col("key").isin(*pairs) & known(F.col("f"))).select("key").collect()]
    return found(sentences, *(r() for r in MEANING), opposites(listed))


def grammar(sentences: DataFrame, mode: str = "general") -> DataFrame:
    rules = [r() for r in GRAMMAR] + ([no_predicate()] if mode in FORMAL else [])
    return found(sentences, *rules)


def openings(sentences: DataFrame) -> DataFrame:
    """The last of three or more finished sentences in a row (of three words or more) that open with one word.

    Where the word is a subject with a verb after it and the last two have 30 words at most, they can be joined.
    """
    s = sentences.filter("terminator is not null and size(words) >= 3")
    by = Window.partitionBy("doc_id").orderBy("sent")
    w, after = at(F.lit(0)), at(F.lit(1))
    join = (pronoun(w) | noun_only(w)) & (verbish(after) | one_of(after, MODAL) | one_of(after, ("បាន", "នឹង", "កំពុង", "ក៏")))
    # only what the rule needs goes through the exchange
    s = s.select("doc_id", "sent", w["key"].alias("key"), w["start"].alias("start"), w["stop"].alias("stop"), w["text"].alias("original"), (F.col("stop") - 1).alias("mark"), "terminator", F.size("words").alias("n"), F.coalesce(join, F.lit(False)).alias("join"))
    run = (F.lag("key").over(by) == F.col("key")) & (F.lag("key", 2).over(by) == F.col("key")) & ~F.coalesce(F.lead("key").over(by) == F.col("key"), F.lit(False))
    can = F.col("join") & (F.lag("terminator").over(by) == "។") & (F.lag("n").over(by) + F.col("n") <= 30)
    s = s.withColumns({"run": run, "can": F.coalesce(can, F.lit(False)), "mark_before": F.lag("mark").over(by)}).filter("run")
    return s.select("doc_id", "sent", F.lit("repetition.sentence-openings").alias("rule_id"), F.when(F.col("can"), F.col("mark_before")).otherwise(F.col("start")).alias("start"), "stop", F.col("original").alias("word"), F.when(F.col("can"), F.array(F.lit(" ហើយ"))).otherwise(F.array().cast("array<string>")).alias("suggestions"))

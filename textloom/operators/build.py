"""Building a lexicon from word lists, a dictionary's definitions and curated lists: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import normalize
from textloom.operators import lexicon as lex

WORD = r"\A[\x{1780}-\x{17D3}\x{17DD}]+\z"
# Letters that are words by themselves, and abbreviations of the parts of speech in definitions.
LETTER_WORDS = ("ក", "គ", "ឬ", "ឮ", "ឯ", "ឱ", "ឲ", "ឪ", "ឳ", "ឥ", "ឦ", "ឧ", "ឩ", "ឫ", "ឭ", "ឰ")
POS_TAGS = {"ន": "N", "កិ": "V", "គុ": "ADJ", "កិ.វិ": "ADV", "គុ.កិ": "ADV", "បុ": "PRON", "សព្វ": "PRON"}
HOLD_OUT = 20
LEAST_ATTESTED = 5
MISSING_ROWS = ("correction not in lexicon", "correction without authority", "stem not in lexicon")


def words_of(rows: DataFrame, source: str, word: str = "word", pos: Column | None = None) -> DataFrame:
    """Lexicon rows of the Khmer words of a list; single letters only where they are words, or of the function words."""
    found = lex.entries(rows, source, word, pos=pos).filter(F.col("key").rlike(WORD))
    return found if source == "function" else found.filter((F.length("key") > 1) | F.col("key").isin(*LETTER_WORDS))


def headwords(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a list of headwords, one a line: quotes, and blanks, commas and marks at the end go."""
    word = F.regexp_replace(F.regexp_replace(F.trim(column), r'\A"|"\z', ""), r"[\s,!?]+\z", "")
    return words_of(lines.select(word.alias("word")), "headword")


def listed_words(lines: DataFrame, source: str = "wordlist", column: str = "value") -> DataFrame:
    """Rows of all words of a list with several words a line."""
    return words_of(lines.select(F.explode(F.split(F.regexp_replace(column, r"\A\x{FEFF}", ""), r"[\s,!?]+")).alias("word")), source)


def definition_text(column: str = "definition") -> Column:
    """A definition without its numbering and escapes."""
    return F.replace(F.replace(F.regexp_replace(column, r'<"*\d+"*>', ""), F.lit("/a"), F.lit("")), F.lit("\\n"), F.lit("\n"))


def definition_pos(definitions: DataFrame) -> DataFrame:
    """(key, p): parts of speech that the definitions (word, definition) of a word name in brackets."""
    tags = F.flatten(F.transform(F.regexp_extract_all(definition_text(), F.lit(r"\(([\x{1780}-\x{17FF}.\s]{1,12})\)"), F.lit(1)), lambda t: F.transform(F.split(t, r"\s+"), lambda x: F.regexp_replace(x, r"\.\z", ""))))
    bit = F.lit(0)
    for tag, name in POS_TAGS.items():
        bit = bit.bitwiseOR(F.when(F.array_contains(tags, tag), lex.POS[name]).otherwise(0))
    key = normalize.word_key(F.regexp_replace(F.trim("word"), r"[\s,!?]+\z", ""))
    return definitions.select(key.alias("key"), bit.alias("p")).filter("p <> 0").groupBy("key").agg(F.bit_or("p").alias("p"))


def held_out(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples in the definitions of every HOLD_OUT-th id, the other definitions)."""
    out = F.col("id") % HOLD_OUT == 0
    examples = F.regexp_extract_all(definition_text(), F.lit(r":\s*([^:;()\n]{12,200}?)\s*(?:\x{17D4}|;|\n|\z)"), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("example", r"\x{200B}", ""), r"\s+", " "))
    rows = definitions.filter(out).select("id", F.explode(examples).alias("example")).select("id", text.alias("text"))
    rows = rows.filter(F.col("text").rlike(r"\A[\x{1780}-\x{17FF}\s,]+\z") & F.col("text").rlike(r"[\x{1780}-\x{17FF}]{4}"))
    return rows, definitions.filter(~F.coalesce(out, F.lit(False)))


def corpus_tokens(definitions: DataFrame) -> DataFrame:
    """(id, part, place, key, abbreviation): words of the definitions, in unbroken parts; a break or a word that is none starts a new part."""
    parts = F.split(definition_text(), r"[^\x{1780}-\x{17D3}\x{17DD}\x{200B} .]+")
    one = definitions.select("id", F.posexplode(parts).alias("part", "text")).select("id", "part", F.posexplode(F.filter(F.split("text", r"[\s\x{200B}]+"), lambda t: t != "")).alias("place", "token"))
    key = normalize.word_key(F.regexp_replace("token", r"\.+\z", ""))
    return one.select("id", "part", "place", key.alias("key"), F.col("token").endswith(".").alias("abbreviation"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """(key, n, abbreviations): how often each Khmer word occurs, and how often as an abbreviation."""
    words = tokens.filter(F.col("key").rlike(WORD))
    return words.groupBy("key").agg(F.count_if(~F.col("abbreviation")).alias("n"), F.count_if("abbreviation").alias("abbreviations"))


def pairs(definitions: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n): neighbouring words of the definitions, ``least`` times or more. No pair goes over a break, an abbreviation or
    a token that is no Khmer word; pairs are made in the row, so the one shuffle is that of the counts."""
    split = F.split(definition_text(), r"[^\x{1780}-\x{17D3}\x{17DD}\x{200B} .]+")
    bare = lambda t: F.when(~t.endswith("."), normalize.word_key(t))
    keys = lambda part: F.transform(F.filter(F.split(part, r"[\s\x{200B}]+"), lambda t: t != ""), lambda t: F.when(bare(t).rlike(WORD), bare(t)))
    rows = definitions.select(F.explode(F.transform(split, keys)).alias("k"))
    two = F.filter(F.transform("k", lambda b, i: F.struct(F.get("k", i - 1).alias("a"), b.alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return rows.select(F.explode(two).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def attested(counts: DataFrame) -> DataFrame:
    """Lexicon rows of words that definitions use often enough and not mainly as abbreviations."""
    often = counts.filter((F.col("n") >= LEAST_ATTESTED) & (F.col("abbreviations") < F.col("n")) & (F.length("key") >= 2))
    return often.select("key", F.lit(lex.SOURCES["attested"]).alias("f"), F.col("n").cast("int").alias("n"), F.lit(0).alias("p"))


def usable_rules(rows: DataFrame) -> DataFrame:
    """Rules of a textbook that a named person checked against a page, with a pattern a machine can match."""
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return rows.filter(given("verified_by") & given("pdf_page") & given("wrong") & (F.col("machine_checkable") == "yes"))


def problems(lexicon: DataFrame, corrections: DataFrame, nominalizers: DataFrame | None = None) -> DataFrame:
    """(key, problem): corrections that the lexicon does not have on authority, nominalised stems that it does not have at all."""
    sure = sum(lex.SOURCES[s] for s in ("headword", "modern", "legal", "name", "function", "approved"))
    rows = corrections.select(normalize.word_key(F.col("correct")).alias("key")).distinct().join(lexicon.select("key", "f"), "key", "left")
    found = rows.select("key", F.when(F.col("f").isNull(), MISSING_ROWS[0]).when(~lex.bits(F.col("f"), sure), MISSING_ROWS[1]).alias("problem")).filter("problem is not null")
    if nominalizers is not None:
        stem = F.regexp_replace(normalize.word_key(F.col("correct")), r"\A(?:\x{1780}\x{17B6}\x{179A}|\x{179F}\x{17C1}\x{1785}\x{1780}\x{17D2}\x{178A}\x{17B8})", "")
        stems = nominalizers.select(stem.alias("key")).distinct().join(lexicon.select("key"), "key", "left_anti")
        found = found.unionByName(stems.select("key", F.lit(MISSING_ROWS[2]).alias("problem")))
    return found


def without(lexicon: DataFrame, wrong: DataFrame, column: str = "wrong") -> DataFrame:
    """The lexicon without the wrong forms of a list."""
    return lexicon.join(wrong.select(normalize.word_key(F.col(column)).alias("key")).distinct(), "key", "left_anti")


def build(heads: DataFrame, definitions: DataFrame, lists: list[DataFrame], wrong: DataFrame) -> DataFrame:
    """The lexicon: headwords, words attested in the definitions with their frequencies, further lists, without wrong forms."""
    _, rest = held_out(definitions)
    counts = frequencies(corpus_tokens(rest))
    rows = heads.unionByName(attested(counts))
    for more in lists:
        rows = rows.unionByName(more)
    named = definition_pos(definitions).select("key", F.col("p").alias("named"))
    n = counts.select("key", F.col("n").cast("int").alias("seen"))
    out = lex.merged(rows).join(named, "key", "left").join(n, "key", "left")
    out = out.select("key", "f", F.greatest("n", F.coalesce("seen", F.lit(0))).alias("n"), F.col("p").bitwiseOR(F.coalesce("named", F.lit(0))).alias("p"))
    return without(out, wrong)

"""Sentences, words and the window rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What ends a sentence.
SENTENCE_END = r"[\x{17D4}\x{17D5}\x{17D6}?!\n]"


def sentences(docs: DataFrame, end: str = SENTENCE_END) -> DataFrame:
    """(doc_id, sent, sentence, n_words, words): pieces between terminators that have a word, numbered from 0 within the row."""
    split = lambda x: F.filter(F.split(x, "[ \\t]+"), lambda w: w != "")
    parts = F.transform(F.split("text", end, -1), lambda x: F.struct(F.trim(x).alias("sentence"), split(x).alias("words")))
    parts = docs.select("doc_id", F.posexplode(F.filter(parts, lambda p: F.size(p["words"]) > 0)).alias("sent", "p"))
    return parts.select("doc_id", F.col("sent").cast("long").alias("sent"), "p.sentence", F.size("p.words").cast("long").alias("n_words"), "p.words")


def adjacent_repeats(docs: DataFrame) -> DataFrame:
    """Neighbouring equal words of a sentence: (doc_id, sent, word_at, word)."""
    pairs = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("word_at"), w.alias("word"))), lambda x: x["word_at"] > 0)
    hits = sentences(docs).select("doc_id", "sent", "words", F.explode(pairs).alias("p"))
    return hits.filter(F.get("words", (F.col("p.word_at") - 1).cast("int")) == F.col("p.word")).select("doc_id", "sent", "p.word_at", "p.word")


def third_uses(docs: DataFrame, least_words: int = 10, least_chars: int = 4) -> DataFrame:
    """The third use of a word of some length in a sentence of ten words or more."""
    one = sentences(docs).filter(F.col("n_words") >= least_words).select("doc_id", "sent", F.posexplode("words").alias("word_at", "word")).filter(F.length("word") >= least_chars)
    n = F.row_number().over(Window.partitionBy("doc_id", "sent", "word").orderBy("word_at"))
    return one.withColumn("n", n).filter("n = 3").select("doc_id", "sent", F.col("word_at").cast("long").alias("word_at"), "word")


def long_sentences(docs: DataFrame, most: int = 40) -> DataFrame:
    return sentences(docs).filter(F.col("n_words") > most).select("doc_id", "sent", "n_words")


def same_openings(docs: DataFrame, run: int = 3, least_words: int = 3) -> DataFrame:
    """Runs of ``run`` or more sentences in a row with one first word: (doc_id, first_sent, word, n), gaps and islands."""
    s = sentences(docs).filter(F.col("n_words") >= least_words).select("doc_id", "sent", F.lower(F.get("words", F.lit(0))).alias("word"))
    by_doc = Window.partitionBy("doc_id").orderBy("sent")
    s = s.withColumn("new", F.when(F.lag("word").over(by_doc).eqNullSafe(F.col("word")), 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc))
    return s.groupBy("doc_id", "island").agg(F.min("sent").alias("first_sent"), F.min("word").alias("word"), F.count("*").alias("n")).filter(F.col("n") >= run).drop("island")


def document_stats(docs: DataFrame) -> DataFrame:
    s = sentences(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_sentences"))
    lengths = docs.select("doc_id", F.length("text").cast("long").alias("n_characters"))
    return lengths.join(s, "doc_id", "left").select("doc_id", "n_characters", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"))

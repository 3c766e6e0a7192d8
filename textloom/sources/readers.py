"""Readers and writers of the text engine: plain text, Word documents, lists, lexicon, gold items, reports."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PACKED, MAX_INFLATED, MAX_ENTRIES = 25_000_000, 80_000_000, 3000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row a file: without byte order mark, lines ended by a line feed."""
    text = F.regexp_replace(F.regexp_replace("value", r"\A\x{FEFF}", ""), r"\r\n?", "\n")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word document, one a line; ValueError beyond the limits or without a body."""
    if len(data) > MAX_PACKED:
        raise ValueError("file too large")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if len(z.infolist()) > MAX_ENTRIES or sum(i.file_size for i in z.infolist()) > MAX_INFLATED:
            raise ValueError("archive too large")
        if "word/document.xml" not in z.namelist():
            raise ValueError("no document body")
        with z.open("word/document.xml") as f:
            body = f.read(MAX_INFLATED + 1)
    if len(body) > MAX_INFLATED or b"<!DOCTYPE" in body:
        raise ValueError("unsafe document body")
    lines = []
    for p in ElementTree.fromstring(body).iter(f"{_W}p"):
        parts = {f"{_W}tab": "\t", f"{_W}br": "\n"}
        lines.append("".join(x.text or "" if x.tag == f"{_W}t" else parts.get(x.tag, "") for x in p.iter()))
    return "\n".join(lines)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error), a row a file; a file that can't be read has a null text and the reason."""

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for data in batch.column(1):
                try:
                    texts.append(docx_text(data.as_py()))
                    errors.append(None)
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string, error string")


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated list without a header; lines from '#' on go."""
    return spark.read.csv(path, sep="\t", comment="#", quote="", schema=", ".join(f"{c} string" for c in columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct Khmer words of the first column of a comma- or tab-separated file."""
    word = F.trim(F.get(F.split("value", "[,\\t]"), F.lit(0)))
    return spark.read.text(path).select(word.alias("word")).filter(F.col("word").rlike(r"\A[\x{1780}-\x{17DD}\x{200B}]+\z")).distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="id string, group string, text string, mode string, expect array<struct<original:string,category:string,suggestion:string,occurrence:int>>")


def write_csv_report(found: DataFrame, path: str) -> None:
    found.write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def write_text(docs: DataFrame, path: str) -> None:
    docs.select("text").write.text(path)

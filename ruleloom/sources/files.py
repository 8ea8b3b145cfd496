"""Scanning source files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.text import CORE, LANGUAGES, MOST_BYTES, base_name, extension, language, role


def scan(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """The source files below ``folder``: path, name, language, size, lines, hash, role, text, status.

    ``status`` is ``ok``, ``unsupported`` or ``too large``; only ``ok`` files have a text. With ``strict`` any other
    file fails the job. Bytes that are no UTF-8 become replacement characters; a last line feed counts as a line.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    known = sorted(set(LANGUAGES) | {e for es in CORE.values() for e in es})
    status = F.when(~extension(F.col("path")).isin(known), "unsupported").when(F.col("length") > MOST_BYTES, "too large").otherwise("ok")
    text = F.when(F.col("status") == "ok", F.regexp_replace(decoded(F.col("content")), "^﻿", ""))
    out = raw.withColumn("status", status).withColumn("text", text)
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "status"))))
    return out.select(
        "path", base_name(F.col("path")).alias("name"), language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"),
        F.size(F.split("text", "\n", -1)).alias("line_count"), F.sha2("text", 256).alias("content_hash"), role(F.col("path"), F.col("length")).alias("role"), "text", "status",
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what is not valid becomes U+FFFD."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def document_text(content: bytes, name: str) -> str:
    """Text of a .docx (trimmed paragraphs that are not empty), a .doc (printable ASCII and line ends) or plain text."""
    low = name.lower()
    if low.endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
        return "\n".join(p for p in paragraphs if p)
    if low.endswith(".doc"):
        return re.sub(r"[^\n\r\x20-\x7e]", "", content.decode("latin-1"))
    return content.decode("utf-8", errors="replace")


def document_texts(files: DataFrame) -> DataFrame:
    """path and text of .txt, .doc and .docx files (path, content); an unreadable one has a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts.append(document_text(bytes(content), path))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.where(extension(F.col("path")).isin("txt", "doc", "docx")).select("path", "content").mapInPandas(run, "path string, text string")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of the .txt, .doc and .docx files below ``folder``; an unreadable one has a null text."""
    return document_texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))

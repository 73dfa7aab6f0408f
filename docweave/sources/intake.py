"""Uploads and extracted texts: admission, decoding, pages and lines, and how long ago something was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of an upload; extensions admitted, and how files of a kind begin.
MOST = 50 << 20
EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "txt", "png", "jpg", "jpeg")
BEGINNINGS = {"pdf": "25504446", "docx": "504B0304", "pptx": "504B0304", "xlsx": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF"}


def admission(name: Column, content: Column, most: int = MOST) -> Column:
    """admitted, or why an upload isn't: empty, too large, extension, content."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    begins = F.hex(F.substring(content, 1, 8))
    wrong = F.lit(False)
    for kind, start in BEGINNINGS.items():
        wrong = wrong | ((ending == kind) & ~begins.startswith(start))
    size = F.octet_length(content)
    return F.when(size == 0, "empty").when(size > most, "too large").when(~ending.isin(*EXTENSIONS), "extension").when(wrong, "content").otherwise("admitted")


def decoded(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, char_count of files (key, content): UTF-8, else Latin-1, trimmed; empty ones are left out."""
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    rows = files.select(key, F.btrim(text, F.lit(" \t\n\x0b\x0c\r")).alias("text")).where("text <> ''")
    return rows.withColumn("char_count", F.length("text"))


def ocr_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, confidence of lines of words (keys, i, word, confidence): words in order, and the mean of the confidences that aren't negative."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"])
    return words.groupBy(*keys).agg(F.array_join(listed, " ").alias("text"), F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 6).alias("confidence"))


def marked_pages(texts: DataFrame, key: str = "doc_id", mark: str = r"--- Page ([0-9]+) ---") -> DataFrame:
    """key, page, text: what follows each page mark, trimmed; a text without marks is page 1."""
    parts = F.split("text", mark, -1)
    numbers = F.transform(F.regexp_extract_all("text", F.lit(mark), F.lit(1)), lambda n: n.cast("int"))
    pages = F.when(F.size(numbers) > 0, F.zip_with(numbers, F.slice(parts, 2, F.size(numbers)), lambda n, t: F.struct(n.alias("page"), t.alias("text"))))
    pages = F.coalesce(pages, F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"))))
    return texts.select(key, F.explode(pages).alias("p")).select(key, "p.page", F.btrim("p.text", F.lit(" \t\n\x0b\x0c\r")).alias("text"))


def ago(when: Column, now: Column) -> Column:
    """Minutes, hours or days since."""
    s = F.unix_timestamp(now) - F.unix_timestamp(when)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))

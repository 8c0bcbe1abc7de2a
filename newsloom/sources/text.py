"""Documents from text columns, and what is read off a text: title, date, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip

#: Labels of dates and of lines that are no titles.
DATE_LABEL = r"(?i)(?:发布时间|发布日期|日期|publish(?:ed)?(?: time| date)?)\s*[：:]\s*(\d{4}[-年/.]\d{1,2}[-月/.]\d{1,2}日?)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def doc_id(content: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of bytes or text."""
    return F.substring(F.sha2(content, 256), 1, 24)


def sanitize(text: Column) -> Column:
    """Without NUL. A Spark string holds no lone surrogates; the file parsers replace them before."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def publish_time(pages: Column) -> Column:
    """The first labelled date in the first three pages, as written; null if there is none."""
    return F.nullif(F.regexp_extract(F.array_join(F.slice(pages, 1, 3), "\n"), DATE_LABEL, 1), F.lit(""))


def title(text: Column, stem: Column) -> Column:
    """The first line of 4 to 100 characters that isn't a source or date line; else ``stem``."""
    lines = F.transform(F.split(text, LINE_BREAK), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    good = F.filter(lines, lambda x: F.length(x).between(4, 100) & ~x.startswith("来源：") & ~x.startswith("日期："))
    return F.coalesce(F.get(good, F.lit(0)), stem)


def from_text(rows: DataFrame, name: str = "name", text: str = "text", published: Column | None = None) -> DataFrame:
    """``doc_id, title, source, publish_time, page_number, text, metadata`` of texts: one page, number 1, nothing inferred."""
    kept = rows.where(F.col(text).isNotNull())
    return kept.select(
        doc_id(F.col(text)).alias("doc_id"),
        F.col(name).alias("title"),
        F.col(name).alias("source"),
        (published if published is not None else F.lit(None)).cast("string").alias("publish_time"),
        F.lit(1).alias("page_number"),
        F.col(text).alias("text"),
        F.create_map(F.lit("file_type"), F.lit("text")).alias("metadata"),
    )

"""Overlapping token windows of pages, numbered through a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import TOKEN_SPACED, WS, token_count
from newsloom.runtime import materialize


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size must hold")


def spaced_tokens(text: Column) -> Column:
    """Tokens with the white space after them, so that slices join to the source span."""
    return F.regexp_extract_all(text, F.lit(TOKEN_SPACED), F.lit(0))


def window_count(n: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)


def chunk_id(doc_id: Column, page: Column, index: Column, content: Column) -> Column:
    """A missing page number is hashed as the word None."""
    parts = F.concat_ws(":", doc_id, F.coalesce(page.cast("string"), F.lit("None")), index.cast("string"), content)
    return F.substring(F.sha2(parts, 256), 1, 24)


def chunk_pages(pages: DataFrame, size: int = 1024, overlap: int = 256, position: str = "page_pos") -> DataFrame:
    """Chunks of pages (doc_id, page_number, text, ``position``, and any more columns).

    Chunk numbers run through a document in the order of ``position``, which tells its pages apart. Pages
    without tokens give nothing. Only the pages' chunk counts are shuffled for the running number; what
    is joined back to the texts is a number for each page that isn't the first of its document.
    """
    check_window(size, overlap)
    step = size - overlap
    counts = pages.select("doc_id", position, window_count(token_count(F.col("text")), size, overlap).alias("_k")).where("_k > 0")
    before = Window.partitionBy("doc_id").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    later = materialize(counts.select("doc_id", position, F.sum("_k").over(before).alias("_first")).where("_first > 0"), "page-numbers")
    numbered = pages.join(later, (pages["doc_id"] == later["doc_id"]) & pages[position].eqNullSafe(later[position]), "left").select(*(pages[c] for c in pages.columns), F.coalesce("_first", F.lit(0)).alias("_first"))
    counted = numbered.withColumn("_tokens", spaced_tokens(F.col("text"))).where(F.size("_tokens") > 0).withColumn("_k", window_count(F.size("_tokens"), size, overlap))
    rows = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    content = F.regexp_replace(F.array_join(F.slice("_tokens", F.col("_i") * step + 1, F.lit(size)), ""), f"[{WS}]+$", "")
    out = rows.withColumn("content", content).withColumn("chunk_index", (F.col("_first") + F.col("_i")).cast("int"))
    out = out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("page_number"), F.col("chunk_index"), F.col("content")))
    return out.drop("_tokens", "_k", "_first", "_i", "text", position)


def chunk_single(documents: DataFrame, size: int = 1024, overlap: int = 256) -> DataFrame:
    """As chunk_pages for documents of one page each (doc_id, page_number, text): no shuffle."""
    check_window(size, overlap)
    step = size - overlap
    counted = documents.withColumn("_tokens", spaced_tokens(F.col("text"))).where(F.size("_tokens") > 0)
    rows = counted.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), window_count(F.size("_tokens"), size, overlap) - 1), lambda i: F.array_join(F.slice("_tokens", i * step + 1, F.lit(size)), ""))).alias("chunk_index", "content"))
    out = rows.withColumn("content", F.regexp_replace("content", f"[{WS}]+$", ""))
    out = out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("page_number"), F.col("chunk_index"), F.col("content")))
    return out.drop("_tokens", "text")


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have no searchable text."""
    return documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")

"""The catalogue of indexed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import count_rows
from newsloom.operators.vectors import latest

COLUMNS = ["doc_id", "title", "source", "publish_time", "stored_path", "chunk_count", "indexed_at"]


def upsert(rows: DataFrame) -> DataFrame:
    """One row a document: the latest indexing; equal times go to the larger path and count."""
    order = [F.desc_nulls_last("indexed_at"), F.desc_nulls_last("stored_path"), F.desc_nulls_last("chunk_count"), F.desc_nulls_last("title"), F.desc_nulls_last("source"), F.desc_nulls_last("publish_time")]
    return latest(rows.where("doc_id is not null").select(COLUMNS), ["doc_id"], order)


def listing(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("indexed_at"), "doc_id")


def get(catalog: DataFrame, doc_id: str) -> DataFrame:
    return catalog.where(F.col("doc_id") == doc_id)


def stats(catalog: DataFrame, vectors: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``documents, chunks, entities, relations``: one row."""
    return count_rows({"documents": catalog, "chunks": vectors, "entities": entities, "relations": relations})


def rows_for_display(catalog: DataFrame) -> DataFrame:
    """Document rows with blanks for missing dates, and a choice label."""
    return catalog.select("doc_id", "title", "source", F.coalesce("publish_time", F.lit("")).alias("publish_time"), "chunk_count", F.concat(F.coalesce("title", F.lit("")), F.lit(" · "), F.substring("doc_id", 1, 8)).alias("choice"))

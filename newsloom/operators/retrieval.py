"""Evidence for batches of questions: vector channel, graph channel and weighted rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("vector", "graph", "hybrid")
#: Fusion and recency.
RRF_K, VECTOR_WEIGHT, GRAPH_WEIGHT = 60, 1.0, 0.9
BONUS, BONUS_DAYS = 0.03, 365
DEFAULT_TOP_K = 5


def check_mode(mode: str) -> str:
    found = mode.lower()
    if found not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return found


def limit_of(top_k: int | None, default: int = DEFAULT_TOP_K) -> int:
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative")
    return top_k or default


def vector_fetch(limit: int, mode: str) -> int:
    return 2 * limit if mode == "hybrid" else limit


def graph_fetch(limit: int) -> int:
    return max(30, 4 * limit)


def recency_bonus(published: Column, as_of: Column) -> Column:
    """0.03 for today, less with age; 0 for what is no date of year, month and day."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(published), "[年月/.]", "-"), "日", "")
    day = F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(plain, "yyyy-M-d"))
    age = F.greatest(F.datediff(as_of, day), F.lit(0))
    return F.when(day.isNotNull(), F.lit(BONUS) / (1 + age / F.lit(float(BONUS_DAYS)))).otherwise(0.0)


def with_bonus(found: DataFrame, as_of: Column) -> DataFrame:
    """Scores of a ranked vector list (rank, score, publish_time) with the bonus; ranks stay."""
    return found.withColumn("score", F.col("score") + recency_bonus(F.col("publish_time"), as_of))


def graph_channel(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score, first, rank``: chunks of the relations found (query_id, pos, chunk_id, confidence).

    In order of first appearance over chunks that exist; the score is the largest confidence.
    """
    per_chunk = hits.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("first"), F.max("confidence").alias("score"))
    there = per_chunk.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return there.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))


def graph_only(channel: DataFrame, limit: int) -> DataFrame:
    """By confidence, ties in order of appearance, cut at ``limit``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return channel.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "score", F.lit("graph").alias("channel"), "rank")


def fuse(vector: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """``query_id, chunk_id, score, channel, rank`` by weighted reciprocal ranks of both (query_id, chunk_id, rank).

    Equal sums keep the order of the vector list, then of the graph list.
    """
    ranked = vector.select("query_id", "chunk_id", "rank", F.lit("vector").alias("channel"), F.lit(0).alias("turn"), F.lit(VECTOR_WEIGHT).alias("weight")).unionByName(
        graph.select("query_id", "chunk_id", "rank", F.lit("graph").alias("channel"), F.lit(1).alias("turn"), F.lit(GRAPH_WEIGHT).alias("weight"))
    )
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("score"),
        F.min(F.struct("turn", "rank")).alias("at"),
        F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channel"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 15)), "at")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "channel", "rank")


def with_chunks(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    return evidence.join(chunks, "chunk_id")

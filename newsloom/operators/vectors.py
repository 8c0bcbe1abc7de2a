"""Exact vector search and the vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

BLOCK = 4096
SENT = 64_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null for vectors of unequal length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def scoped(vectors: DataFrame, doc_ids: list[str] | None) -> DataFrame:
    """Rows of the documents asked for; no or an empty list means all."""
    return vectors.where(F.col("doc_id").isin(doc_ids)) if doc_ids else vectors


def topk_one(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """``key, score, rank`` of one query: a map-side top-k, then one merge."""
    target = F.array(*map(F.lit, map(float, query)))
    best = vectors.select(key, cosine(F.col("embedding"), target).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", vector: str = "embedding", block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """``query_key, key, score, rank``: the k nearest vectors of every query.

    The queries are a stated set. They are taken in turns of at most ``sent`` bytes, which is what a scan of the
    vectors sends to the executors; within a scan, blocks of ``block`` vectors meet blocks of ``block``
    queries as one matrix product, so a task holds block * block scores. Single precision picks
    candidates with a margin, double precision decides. k keys a query and block of vectors leave a
    task. Vectors of another length than the queries and nulls are left out. A key that is
    repeated counts once, with its best score; copies are put together before a list is cut.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    kind, query_kind = vectors.schema[key].dataType, queries.schema[query_key].dataType
    schema = f"`{query_key}` {query_kind.simpleString()}, `{key}` {kind.simpleString()}, score double"
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    arrow, query_arrow = to_arrow_type(kind), to_arrow_type(query_kind)
    found = None
    for ids, matrix in _turns(asked, sent):
        question = spark.sparkContext.broadcast((pa.array(ids, query_arrow), _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], question=question) -> Iterator[pa.RecordBatch]:
            ids, unit = question.value
            for names, x in _vector_blocks(batches, unit.shape[1], block):
                for a in range(0, len(unit), block):
                    q, at, scores = _nearest(unit[a : a + block], x, names, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + a)), pa.array(names[at].tolist(), arrow), pa.array(scores)], names=[query_key, key, "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.groupBy(query_key, key).agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _vector_blocks(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of ``block`` rows, in order of keys, so that ties go to the smaller key."""
    names: list = []
    parts: list[np.ndarray] = []

    def ready() -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(names, dtype=object)
        order = np.argsort(keys, kind="stable")
        return keys[order], _unit(np.concatenate(parts)[order])

    for batch in batches:
        listed = batch.column(1)
        fit = np.flatnonzero(np.asarray(pc.list_value_length(listed)) == size)
        for a in range(0, len(fit), block):
            rows = pa.array(fit[a : a + block])
            if len(names) + len(rows) > block:
                yield ready()
                names, parts = [], []
            names += batch.column(0).take(rows).to_pylist()
            parts.append(listed.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size))
    if names:
        yield ready()


def _nearest(unit: np.ndarray, x: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score) of at least the k best keys of each query; ``names`` are sorted."""
    rough = np.nan_to_num(unit.astype(np.float32) @ x.astype(np.float32).T, nan=-np.inf)
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    best = rough if len(first) == len(names) else np.fmax.reduceat(rough, first, axis=1)  # one column a key
    if best.shape[1] > k:
        bar = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k, None] - np.float32(1e-5)
        q, at = np.nonzero((rough >= bar) & (rough > -np.inf))
    else:
        q, at = np.nonzero(np.isfinite(rough))
    return q, at, np.round(np.einsum("ij,ij->i", unit[q], x[at]), 12)


def _turns(asked: DataFrame, sent: int) -> Iterator[tuple[list, np.ndarray]]:
    """Queries of at most ``sent`` bytes together, fetched one after the other."""
    ids: list = []
    vectors: list = []
    size = None
    for row in asked.toLocalIterator(prefetchPartitions=True):
        size = size or len(row.v)
        if len(row.v) != size:
            raise ValueError("queries must have one length")
        ids.append(row.q)
        vectors.append(np.array(row.v))
        if len(ids) * size * 8 >= sent:
            yield ids, np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors)


def lookup(chunks: DataFrame, wanted: DataFrame, key: str = "chunk_id", order: str = "pos") -> DataFrame:
    """The chunks of ``wanted`` (``key``, ``order``), with that order; unknown ids are dropped."""
    return wanted.select(key, order).join(chunks, key)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order``. A partial limit runs before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of both; where a key is in both, the new row."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return latest(both, [key], [F.desc("_turn")]).drop("_turn")

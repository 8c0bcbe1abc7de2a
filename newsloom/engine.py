"""One object for indexing files or texts and asking questions in batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.config import EngineConfig
from newsloom.lexicon import Lexicon
from newsloom.operators import answering, catalog, chunking, embedding, extraction, graph, retrieval, vectors
from newsloom.runtime import materialize
from newsloom.sources import connectors, files
from newsloom.sources.store import Store

CHUNK_COLUMNS = ["chunk_id", "doc_id", "content", "title", "source", "page_number", "publish_time", "chunk_index", "metadata"]


@dataclass
class Answers:
    """All by query_id: answer rows, cited evidence, relations found."""

    answers: DataFrame
    citations: DataFrame
    relations: DataFrame


class EvidenceEngine:
    """``extractor`` takes chunks and gives relations like ``extraction.extract_relations``, which it replaces."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, lexicon: Lexicon | None = None, extractor: Callable[[DataFrame], DataFrame] | None = None):
        self.spark = spark
        self.config = config or EngineConfig()
        self.lexicon = lexicon or Lexicon.default()
        self.extractor = extractor or (lambda chunks: extraction.extract_relations(chunks, self.lexicon))
        self.store = Store(spark, self.config.warehouse)
        c = self.config
        self.vector_service = connectors.VectorService(c.vector_url, c.vector_collection) if c.vector_backend == "qdrant" else None
        self.graph_service = connectors.GraphService(c.graph_url, c.graph_user, c.graph_password) if c.graph_backend == "neo4j" else None

    def embed(self, texts: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
        """``key, embedding`` by the provider of the settings."""
        return embed_by(self.config, texts, key, text)

    # indexing

    def index_files(self, paths: list[str], replace: bool = False) -> DataFrame:
        """Index files; the whole batch is checked first and committed at once. Each file is copied to the store's uploads under its content address."""
        return self.index_pages(files.read_files(self.spark, paths, f"{self.config.warehouse.rstrip('/')}/uploads"), replace)

    def index_pages(self, pages: DataFrame, replace: bool = False) -> DataFrame:
        """Index pages (as of sources.files); returns ``doc_id, title, source, chunks, relations, stored_path``.

        Known documents are updated by key. Chunks and relations that a change of the chunk size
        leaves behind stay, unless ``replace`` hides the documents' old rows first. The cost doesn't depend on
        what the store holds.
        """
        c = self.config
        base, state = self.store.state()
        pages = materialize(pages, "pages")
        chunks = materialize(chunking.chunk_pages(pages, c.chunk_size, c.chunk_overlap).select(CHUNK_COLUMNS).dropDuplicates(["chunk_id"]), "chunks")
        empty = chunking.without_chunks(pages.select("doc_id", "source").distinct(), chunks).limit(1).collect()
        if empty:
            raise ValueError(f"No searchable text found in {empty[0].source}")
        new_vectors = chunks.select("chunk_id", "doc_id").join(self.embed(chunks), "chunk_id")
        numbered = materialize(self.extractor(chunks).join(chunks.select("chunk_id", "chunk_index"), "chunk_id"), "extracted")
        # a batch's order: document, chunk, sentence, place; numbered by ranges, not in one task
        new_relations = _numbered(numbered, ["doc_id", "chunk_index", "sent_no", "emit_no"], state["next_seq"])
        relations = graph.merge_relations(new_relations.select("seq", *graph.KEYS, "confidence", "source_type", "target_type"))
        report = (
            chunks.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("source").alias("source"), F.min("publish_time").alias("publish_time"), F.count("*").cast("int").alias("chunks"), F.min(F.coalesce(F.col("metadata")["stored_path"], F.col("metadata")["original_path"], F.lit(""))).alias("stored_path"))
            .join(numbered.groupBy("doc_id").agg(F.count("*").cast("int").alias("relations")), "doc_id", "left")
            .withColumn("relations", F.coalesce("relations", F.lit(0)))
        )
        report = materialize(report, "report")
        rows = report.select("doc_id", "title", "source", "publish_time", "stored_path", F.col("chunks").alias("chunk_count"), F.current_timestamp().alias("indexed_at"))
        fresh = {"chunks": chunks, "vectors": new_vectors, "relations": relations, "catalog": rows}
        # services are written by key before the commit, so that a failure in between is mended by indexing again
        if self.vector_service:
            self.vector_service.ensure(c.embedding_dimensions)
            self.vector_service.upsert(chunks.join(new_vectors.select("chunk_id", "embedding"), "chunk_id"))
        if self.graph_service:
            self.graph_service.upsert(relations)
        self.store.commit(base, state, fresh, chunks.select("doc_id").distinct() if replace else None, state["next_seq"] + numbered.count())
        return report.drop("publish_time")

    # questions

    def ask(self, questions: DataFrame, mode: str = "hybrid", top_k: int | None = None, doc_ids: list[str] | None = None, as_of: Column | None = None) -> Answers:
        """Answer questions (query_id, question) together; before anything is indexed, all are refused for want of evidence."""
        mode = retrieval.check_mode(mode)
        limit = retrieval.limit_of(top_k, self.config.top_k)
        answering.check_questions(questions)
        state = self.store.state()[1]
        chunks, stored, relations = (self.store.read(t, state) for t in ("chunks", "vectors", "relations"))
        evidence, found = evidence_for(questions, chunks, stored, relations, self.lexicon, mode, limit, self.config, doc_ids, as_of, services=(self.vector_service, self.graph_service))
        prompted = answering.prompts(questions, evidence, found if mode != "vector" else None)
        if self.config.answer_provider == "openai":
            c = self.config
            replies = answering.remote_answers(prompted, c.answer_base_url, c.answer_model, c.answer_api_key, c.answer_timeout_seconds)
        else:
            replies = answering.answers(prompted)
        return Answers(replies, answering.citations(evidence), found)

    def documents(self) -> DataFrame:
        return catalog.listing(self.store.read("catalog"))

    def stats(self) -> DataFrame:
        """One row: the numbers of documents, chunks, entities and relations, and the backends."""
        state = self.store.state()[1]
        relations = self.store.read("relations", state)
        counted = catalog.stats(self.store.read("catalog", state), self.store.read("vectors", state), graph.entity_table(relations), relations)
        return counted.withColumns({"vector_backend": F.lit(self.config.vector_backend), "graph_backend": F.lit(self.config.graph_backend)})


def embed_by(config: EngineConfig, texts: DataFrame, key: str, text: str, scheme: str = "blake2b") -> DataFrame:
    if config.embedding_provider == "openai":
        return connectors.remote_embed(texts, config.embedding_base_url, config.embedding_model, config.embedding_api_key, config.answer_timeout_seconds, key, text)
    return embedding.hash_embed(texts, config.embedding_dimensions, scheme, key, text)


def _numbered(rows: DataFrame, order: list[str], base: int) -> DataFrame:
    """``seq`` from ``base`` on in the given order: sorted ranges, their sizes summed up, then counted."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    return ranged.join(F.broadcast(starts.select("_part", "_low", F.coalesce("_start", F.lit(0)).alias("_start"))), "_part").withColumn("seq", F.lit(base) + F.col("_start") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_start")


def evidence_for(questions: DataFrame, chunks: DataFrame, stored: DataFrame, relations: DataFrame, lexicon: Lexicon, mode: str, limit: int, config: EngineConfig, doc_ids: list[str] | None = None, as_of: Column | None = None, scheme: str = "blake2b", near: DataFrame | None = None, services: tuple[connectors.VectorService | None, connectors.GraphService | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """Ranked evidence with its chunks, and the relations found (none in vector mode); ``near``: the relations' adjacency, if it is kept; ``services``: what answers the searches instead of the tables."""
    as_of = F.current_date() if as_of is None else as_of
    vector = graph_rows = None
    found = relations.select(F.lit(None).cast(questions.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("int").alias("pos"), "*").limit(0)
    if mode != "graph":
        asked = embed_by(config, questions, "query_id", "question", scheme)
        fetch = retrieval.vector_fetch(limit, mode)
        vector = materialize(services[0].search(asked, fetch, doc_ids) if services[0] else vectors.topk_batch(vectors.scoped(stored, doc_ids), asked, fetch), "vector-channel")
    if mode != "vector":
        if services[1]:
            hits = services[1].search(graph.question_terms(questions, lexicon.aliases), config.graph_hops, retrieval.graph_fetch(limit), doc_ids).join(relations, "id")
        else:
            hits = graph.search(questions, relations, config.graph_hops, retrieval.graph_fetch(limit), doc_ids, lexicon.aliases, near=near)
        found = materialize(hits, "graph-hits")
        graph_rows = retrieval.graph_channel(found, chunks)
    if mode == "vector":
        ranked = retrieval.with_bonus(vector.withColumn("channel", F.lit("vector")).join(chunks.select("chunk_id", "publish_time"), "chunk_id"), as_of).drop("publish_time")
    elif mode == "graph":
        ranked = retrieval.graph_only(graph_rows, limit)
    else:
        ranked = retrieval.fuse(vector, graph_rows, limit)
    # written, so that its size is known before contents are fetched for it
    ranked = materialize(ranked.select("query_id", "chunk_id", "score", "channel", "rank"), "ranked")
    return retrieval.with_chunks(ranked, chunks), found

"""All queries of the core and the SQL they are checked against.

Every query runs over its whole tables. Searches ask for every row whose id is divisible by 100,
against all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.config import EngineConfig
from newsloom.engine import evidence_for
from newsloom.functions.text import token_count
from newsloom.lexicon import Lexicon
from newsloom.operators import answering, catalog, chunking, embedding, extraction, graph, retrieval, timestamps, vectors
from newsloom.plans import sql
from newsloom.runtime import materialize
from newsloom.sources import files, text

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2026-06-01"
ASKED = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return Lexicon.from_table(_table(spark, sf_dir, "lexicon"))


def _questions(spark: SparkSession, sf_dir: str, every: int = ASKED) -> DataFrame:
    """Headlines as questions."""
    return _table(spark, sf_dir, "documents").where((F.col("doc_id") % every == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _indexed(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the index over ``sf_dir``: written by the first query of the application that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = materialize(make(), name)
    return spark.read.schema(_KEPT[key].schema).parquet(_KEPT[key]._newsloom_path)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks once each: the rows of one chunk_id are exact copies, and the first in its file stays.

    Only ids and places are shuffled; what is joined back to the rows are the ids that occur more than once.
    """
    placed = _table(spark, sf_dir, "chunks").where("chunk_id is not null").withColumn("_at", F.struct("_metadata.file_path", "_metadata.row_index"))
    again = _indexed(spark, sf_dir, "repeated-chunks", lambda: placed.groupBy("chunk_id").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("chunk_id", "_first"))
    once = placed.join(again, "chunk_id", "left").where("_first is null or _at = _first")
    return once.select("chunk_id", "doc_id", "content", "title", "source", "page_number", "publish_time", "chunk_index")


def _spread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _chunks, for work on the contents: a table of fewer pieces than there are cores is dealt out to all cores."""
    cores = spark.sparkContext.defaultParallelism
    few = _table(spark, sf_dir, "chunks").select("chunk_id").rdd.getNumPartitions() < cores
    return _chunks(spark, sf_dir).repartition(cores) if few else _chunks(spark, sf_dir)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_relations(_table(spark, sf_dir, "relations"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Merged relations and their adjacency."""
    merged = _indexed(spark, sf_dir, "relations", lambda: _merged(spark, sf_dir))
    return merged, _indexed(spark, sf_dir, "adjacency", lambda: graph.adjacency(merged))


# sources


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.from_text(_table(spark, sf_dir, "documents"), "title", "text", F.col("publish_time"))
    return docs.select("doc_id", "title", "source", "publish_time", "page_number", F.length("text").alias("chars"), F.col("metadata")["file_type"].alias("file_type"))


def labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.publish_time(F.array("text")).alias("labelled"))


def guessed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.title(text.sanitize(F.col("text")), F.col("doc_key")).alias("guess"))


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a text, web or CSV file."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").withColumn("t", F.translate("text", "<>&", ""))
    kind, quoted = F.col("doc_id") % 3, F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('", x'))
    raw = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("<div><p>"), "t", F.lit("</p> <b>end</b></div>"))).otherwise(quoted)
    suffix = F.when(kind == 0, ".txt").when(kind == 1, ".html").otherwise(".csv")
    pages = files.parse_files(rows.select(F.concat(F.lit("/in/d"), F.col("doc_id").cast("string"), suffix).alias("path"), raw.cast("binary").alias("content")))
    return pages.select("doc_id", "source", F.col("metadata")["file_type"].alias("file_type"), F.length("text").alias("chars"), F.md5("text").alias("page"))


# chunking


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", token_count(F.col("text")).alias("tokens"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_key").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    return chunking.chunk_single(docs, 128, 32).select("doc_id", "chunk_index", "chunk_id", F.length("content").alias("chars"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "parsed_pages").where("text is not null").distinct().select("doc_id", "page_number", "text", F.struct("page_number", "page_id").alias("page_pos"))
    return chunking.chunk_pages(pages, 256, 64).select("doc_id", F.col("page_number").cast("string").alias("page_number"), "chunk_index", "chunk_id")


def unsearchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_key").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    return chunking.without_chunks(docs.select("doc_id"), chunking.chunk_single(docs.where("text is not null"), 128, 32))


# embedding


def feature_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _table(spark, sf_dir, "documents").where("title is not null")
    return titles.select(F.explode(embedding.features(F.col("title"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _table(spark, sf_dir, "documents").where("title is not null")
    return embedding.hash_embed_sparse(titles, 384, "sha256", "doc_id", "title").select("doc_id", "place", F.round("value", 6).alias("value"))


def hash_embedding_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _table(spark, sf_dir, "documents").where("title is not null")
    return embedding.hash_embed_sparse(titles, 384, "blake2b", "doc_id", "title").select("doc_id", "place", F.round("value", 6).alias("value"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_chunks(spark, sf_dir).where("content is not null").select("chunk_id", "content")


def content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select(F.explode(embedding.features(F.col("content"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def content_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hash_embed_sparse(_contents(spark, sf_dir), 384, "sha256", "chunk_id", "content").select("chunk_id", "place", F.round("value", 6).alias("value"))


def content_embedding_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hash_embed_sparse(_contents(spark, sf_dir), 384, "blake2b", "chunk_id", "content").select("chunk_id", "place", F.round("value", 6).alias("value"))


# vectors


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    query = rows.where("chunk_id = 0").select("embedding").first()
    found = vectors.topk_one(rows, list(query[0]) if query else [0.0] * 64, 10)
    return found.select("chunk_id", "rank", F.round("score", 6).alias("score"))


def cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.topk_batch(rows, asked, 10, "vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def cosine_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("label").cast("string"))
    asked = rows.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.topk_batch(vectors.scoped(rows, ["1", "4"]), asked, 5, "vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = _table(spark, sf_dir, "relations").where(F.col("seq") % ASKED == 0).select("chunk_id", F.col("seq").alias("pos"))
    return vectors.lookup(_chunks(spark, sf_dir), relations).select("pos", "chunk_id", "doc_id", "chunk_index")


def chunk_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = _table(spark, sf_dir, "relations").select("chunk_id", F.col("seq").alias("pos"))
    return vectors.lookup(_chunks(spark, sf_dir), relations).select("pos", "chunk_id", "doc_id", "chunk_index")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows for a third of the ids, with their vectors turned round."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")
    new = rows.where("chunk_id % 3 = 0").select((F.col("chunk_id") + 100).alias("chunk_id"), F.lit(-1).alias("doc_id"), F.reverse("embedding").alias("embedding"))
    return vectors.upsert(rows, new).select("chunk_id", "doc_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").alias("n"))


# extraction


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.sentences(_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("content")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).alias("longest"))


def lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    terms = [(s, c) for s, c in lexicon.institutions] + [(t, t) for t in lexicon.industries]
    rows = extraction.sentences(_spread_chunks(spark, sf_dir).select("chunk_id", "content"))
    hits = rows.select("chunk_id", F.explode(extraction._terms(F.col("sentence"), terms, "x")).alias("e"))
    return hits.groupBy(F.col("e.name").alias("name")).agg(F.count("*").alias("n"), F.sum("e.pos").alias("places"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.sentences(_spread_chunks(spark, sf_dir).select("chunk_id", "content"))
    hits = rows.select(F.explode(extraction._matches(F.col("sentence"), extraction.COMPANY)).alias("m"))
    return hits.groupBy(F.col("m.name").alias("name")).agg(F.count("*").alias("n"))


def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.sentences(_spread_chunks(spark, sf_dir).select("chunk_id", "content"))
    hits = rows.select(F.explode(extraction._matches(F.col("sentence"), extraction.QUOTED)).alias("m"))
    return hits.groupBy(F.col("m.name").alias("name")).agg(F.count("*").alias("n"))


def quoted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted names and companies of fixed sentences, as the tables hold no quotation mark."""
    rows = spark.createDataFrame(sql.SENTENCE_ROWS, "id int, sentence string")
    parts = [rows.select("id", F.explode(extraction._matches(F.col("sentence"), pattern)).alias("m"), F.lit(kind).alias("kind")) for pattern, kind in ((extraction.QUOTED, "quoted"), (extraction.COMPANY, "company"))]
    return parts[0].unionByName(parts[1]).select("id", "m.name", "kind")


def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    rows = extraction.sentences(_spread_chunks(spark, sf_dir).select("chunk_id", "content"))
    labelled = rows.select(extraction.relation_of(F.col("sentence"), lexicon).alias("label"), extraction.event_of(F.col("sentence"), lexicon).alias("event"))
    return labelled.groupBy("label", "event").agg(F.count("*").alias("n"))


def extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_relations(_spread_chunks(spark, sf_dir), _lexicon(spark, sf_dir))


# graph


def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("id", "seq", "confidence", "source_type", "target_type")


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_table(_merged(spark, sf_dir))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(_merged(spark, sf_dir))


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = graph.question_terms(_questions(spark, sf_dir), _lexicon(spark, sf_dir).aliases)
    return asked.select("query_id", F.posexplode("terms").alias("at", "term"))


def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "relations").select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return graph.seeds(graph.question_terms(_questions(spark, sf_dir), _lexicon(spark, sf_dir).aliases), names)


def _scope(spark: SparkSession, sf_dir: str) -> list[str]:
    """A hundred documents to search in, the same at every size."""
    return [r.doc_id for r in _table(spark, sf_dir, "relations").where("doc_id is not null").select("doc_id").distinct().orderBy(F.md5("doc_id")).limit(100).collect()]


def _search(hops: int, limit: int = 30, dialect: str = "native", relation_names: bool = False, scope: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = _questions(spark, sf_dir)
        if relation_names:
            asked = _table(spark, sf_dir, "lexicon").where("kind = 'rule'").select(F.col("ord").cast("bigint").alias("query_id"), F.concat(F.lit("？"), "term", F.lit("？")).alias("question"))
        merged, near = _graph(spark, sf_dir)
        found = graph.search(asked, merged, hops, limit, _scope(spark, sf_dir) if scope else None, _lexicon(spark, sf_dir).aliases, dialect, near)
        return found.select("query_id", "pos", "hop", "id")

    return run


def simple_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_edges(_merged(spark, sf_dir))


def node_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_styles(_merged(spark, sf_dir))


# retrieval and answers


def date_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = retrieval.recency_bonus(F.col("publish_time"), F.lit(AS_OF).cast("date"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(bonus, 9).alias("bonus"))


def _lists(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per document, its chunks in order (the first ten, or all) and its relations' chunks, as the two lists of a question."""
    chunks = _chunks(spark, sf_dir)
    vector = chunks.select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")).alias("rank"))
    hits = _merged(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "chunk_id", "confidence", F.col("seq").alias("pos"))
    return vector if whole else vector.where(F.col("rank") <= 10), retrieval.graph_channel(hits, chunks)


def graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)[1].select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.graph_only(_lists(spark, sf_dir)[1], 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(*_lists(spark, sf_dir), 5).select("query_id", "chunk_id", "channel", "rank", F.round("score", 9).alias("score"))


def rank_fusion_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(*_lists(spark, sf_dir, True), 5).select("query_id", "chunk_id", "channel", "rank", F.round("score", 9).alias("score"))


def _evidence(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The first five chunks of each document, or all, as its evidence."""
    listed = _lists(spark, sf_dir, whole)[0]
    ranked = (listed if whole else listed.where(F.col("rank") <= 5)).withColumn("score", F.lit(1.0) / F.col("rank"))
    return retrieval.with_chunks(ranked, _chunks(spark, sf_dir))


def citations(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return answering.citations(_evidence(spark, sf_dir, whole)).withColumns({"score": F.round("score", 6), "page_number": F.col("page_number").cast("string")})


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", answering.first_sentence(F.col("text")).alias("sentence"))


def prompt_texts(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    evidence = _evidence(spark, sf_dir, whole)
    asked = evidence.select("query_id", F.col("query_id").alias("question")).distinct()
    relations = _merged(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("seq").alias("pos"), "source", "relation", "target")
    return answering.prompts(asked, evidence, relations).select("query_id", "n_evidence", F.md5("prompt").alias("prompt_md5"))


def extractive_answers(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    evidence = _evidence(spark, sf_dir, whole)
    asked = evidence.select("query_id", F.col("query_id").alias("question")).distinct()
    return answering.answers(answering.prompts(asked, evidence)).select("query_id", "answer")


def _found(spark: SparkSession, sf_dir: str, mode: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, sf_dir).where("content is not null")
    stored = _indexed(spark, sf_dir, "content-vectors", lambda: embedding.hash_embed(_spread_chunks(spark, sf_dir).where("content is not null"), carry=("doc_id",))) if mode != "graph" else None
    merged, near = _graph(spark, sf_dir)
    return evidence_for(asked, chunks, stored, merged, _lexicon(spark, sf_dir), mode, 5, EngineConfig(), as_of=F.lit(AS_OF).cast("date"), scheme="sha256", near=near)


def _answered(mode: str, every: int = ASKED) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = _questions(spark, sf_dir, every)
        evidence, found = _found(spark, sf_dir, mode, asked)
        return answering.answers(answering.prompts(asked, evidence, found))

    return run


def _evidence_of(mode: str) -> Query:
    """Evidence with its scores, as it is cited."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cited = answering.citations(_found(spark, sf_dir, mode, _questions(spark, sf_dir))[0])
        return cited.select("query_id", "number", "chunk_id", F.round("score", 6).alias("score"), "title")

    return run


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that nothing in the index answers."""
    asked = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("!"), (F.col("n_nationkey") % 10).cast("string")).alias("question"))
    evidence, found = _found(spark, sf_dir, "graph", asked)
    return answering.answers(answering.prompts(asked, evidence, found))


#: Over all headlines, so that a small table asks questions too.
flagship = _answered("hybrid", 1)


# catalogue


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert(_table(spark, sf_dir, "doc_catalog"))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.listing(catalog_rows(spark, sf_dir))
    return rows.select("doc_id", "indexed_at", "chunk_count")


def catalog_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rows_for_display(catalog_rows(spark, sf_dir))


def catalog_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "documents").agg(F.min("doc_key")).first()[0]
    return catalog.get(catalog_rows(spark, sf_dir), wanted).select("doc_id", "title", "chunk_count")


def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir)
    return catalog.stats(catalog_rows(spark, sf_dir), _chunks(spark, sf_dir), graph.entity_table(merged), merged)


def payload_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON payloads and back."""
    fields = ["chunk_id", "doc_id", "content", "title", "source", "page_number", "publish_time", "chunk_index"]
    rows = _chunks(spark, sf_dir).select(*fields)
    back = rows.select(F.from_json(F.to_json(F.struct(*fields)), rows.schema).alias("p")).select("p.*")
    return back.select("chunk_id", "doc_id", F.md5("content").alias("content"), "title", "source", F.col("page_number").cast("string").alias("page_number"), "publish_time", "chunk_index")


# times


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found_times(*(_table(spark, sf_dir, t) for t in ("documents", "chunks", "feeds")))


def queries() -> dict[str, Query]:
    plain = [
        text_documents, labelled_dates, guessed_titles, parsed_files, token_counts, chunk_texts, chunk_pages, unsearchable, feature_totals, hash_embedding, hash_embedding_blake, content_features, content_embedding, content_embedding_blake,
        cosine_topk, cosine_batch, cosine_scoped, chunk_lookup, chunk_lookup_all, vector_upsert, sentence_split, lexicon_mentions, company_names, quoted_names, quoted_examples, relation_labels, extracted_relations,
        merged_relations, graph_entities, graph_counts, question_terms, graph_seeds, simple_edges, node_styles, date_bonus, graph_channel, graph_evidence, rank_fusion, rank_fusion_all,
        citations, first_sentences, prompt_texts, extractive_answers, catalog_rows, catalog_listing, catalog_display, catalog_get, engine_stats, payload_codec, p5_found,
    ]
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {f"{f.__name__}_all": partial(f, whole=True) for f in (citations, prompt_texts, extractive_answers)}
    out |= {"graph_one_hop": _search(1), "graph_two_hops": _search(2), "graph_limit": _search(2, 3), "graph_fallback": _search(2, 30, "native", True), "graph_path_dialect": _search(2, 30, "path"), "graph_scoped": _search(2, 30, scope=True), "graph_path_scoped": _search(2, 30, "path", scope=True)}
    out |= {"answers_vector": _answered("vector"), "answers_graph": _answered("graph"), "answers_hybrid": _answered("hybrid")}
    out |= {"evidence_vector": _evidence_of("vector"), "evidence_hybrid": _evidence_of("hybrid"), "refused": refused}
    return out


def oracle_sql() -> dict[str, str]:
    return sql.statements()

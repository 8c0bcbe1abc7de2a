"""Vector search, fusion, answers, catalogue, engine and the registered queries."""

import datetime
import hashlib
import math
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.config import EngineConfig
from newsloom.engine import EvidenceEngine
from newsloom.lexicon import Lexicon
from newsloom.operators import answering, catalog, extraction, retrieval, vectors
from newsloom.sources import store
from newsloom.sources.versions import ConcurrentWrite
from newsloom.streaming.file_index import index_stream


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    x[9] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0])], "chunk_id bigint, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 50)] + [(3, x[3].tolist())], "query_id bigint, embedding array<double>")
    got = {}
    for r in vectors.topk_batch(rows, asked, 5, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for q, found in got.items():
        score = np.round(unit @ unit[q], 12)
        want = sorted(range(300), key=lambda i: (-score[i], i))[:5]
        assert [found[k][0] for k in range(1, 6)] == want
    assert got[3][1][0] == 3 and got[3][2][0] == 7
    assert vectors.topk_batch(rows, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_topk_of_repeated_keys(spark, batch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    copies = [0] * 30 + [1] * 15  # more than 2 * k times
    made = [(i, x[i].tolist()) for i in [*copies, *range(60)]] + [(5, x[0].tolist())]  # key 5 also has a nearer vector
    rows = spark.createDataFrame(made, "chunk_id bigint, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 1, 40)], "query_id bigint, embedding array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = vectors.topk_batch(rows, asked, 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 1, 40):
        score = np.round(unit @ unit[q], 12)
        score[5] = max(score[5], score[0])
        assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == sorted(range(60), key=lambda i: (-score[i], i))[:10]


def test_vector_table(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("o"), vectors.cosine(F.col("a"), F.col("s")).alias("n")).first()
    assert math.isclose(row.c, 0.5**0.5) and row.o == 0 and row.n is None
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    out = vectors.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int"))
    assert {(r.chunk_id, r.v) for r in out.collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_fusion_golden(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    out = retrieval.fuse(v, g, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.channel) for r in out] == [("b", "graph+vector"), ("a", "vector"), ("c", "graph")]
    assert [round(r.score, 12) for r in out] == [round(s, 12) for s in (1 / 62 + 0.9 / 61, 1 / 61, 0.9 / 62)]


def test_bonus_golden(spark):
    rows = spark.createDataFrame([("2026年1月15日",), ("2025-01-15",), ("2027.1.1",), ("2026-13-45",), (None,)], "p string")
    out = [round(r.b, 6) for r in rows.select(retrieval.recency_bonus(F.col("p"), F.lit("2026-01-15").cast("date")).alias("b")).collect()]
    assert out == [0.03, 0.015, 0.03, 0, 0]


def test_limits_and_modes():
    assert retrieval.limit_of(None) == 5 and retrieval.limit_of(0, 7) == 7 and retrieval.graph_fetch(10) == 40 and retrieval.vector_fetch(3, "hybrid") == 6
    for call in (lambda: retrieval.limit_of(-1), lambda: retrieval.check_mode("x")):
        with pytest.raises(ValueError, match="."):
            call()


def test_sentences_and_excerpts(spark):
    rows = spark.createDataFrame([("字" * 200,), ("一\u3000\n二。三",), ("。",), ("x" * 220,), ("y" * 221,)], "t string")
    out = rows.select(answering.first_sentence(F.col("t")).alias("s"), answering.excerpt(F.col("t")).alias("e")).collect()
    assert out[0].s == "字" * 180 + "…" and out[1].s == "一 二。" and out[2].s == "。"
    assert out[3].e == "x" * 220 and out[4].e == "y" * 220 + "…"


def test_catalog(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("d", "old", "s", None, "p", 1, t), ("d", "new", "s", None, "p", 2, t + datetime.timedelta(1)), (None, "x", "s", None, "p", 2, t), ("e", None, None, None, None, None, None)]
    out = catalog.upsert(spark.createDataFrame(rows, "doc_id string, title string, source string, publish_time string, stored_path string, chunk_count int, indexed_at timestamp"))
    assert {(r.doc_id, r.title) for r in out.collect()} == {("d", "new"), ("e", None)}
    assert [r.doc_id for r in catalog.listing(out).collect()] == ["d", "e"] and catalog.get(out, "no").count() == 0


TEXT = "资本市场监管工作\n发布时间：2026-01-15\n中国证监会发布监管通知，推动资本市场改革。星河科技股份有限公司合作研发人工智能。\n"


def test_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(TEXT, encoding="utf-8")
    (folder / "b.md").write_text("# 另一份文件标题\n央行宣布融资改革。", encoding="utf-8")
    engine = EvidenceEngine(spark, EngineConfig(warehouse=str(tmp_path / "w"), chunk_size=80, chunk_overlap=20, embedding_dimensions=192, top_k=3))
    report = engine.index_files([str(folder / "a.txt")]).collect()
    assert len(report) == 1 and report[0].chunks > 0 and report[0].relations > 0
    before = engine.stats().first().asDict()
    engine.index_files([str(folder / "a.txt")])
    assert engine.stats().first().asDict() == before and before["documents"] == 1
    engine.index_files([str(folder / "b.md")])
    assert engine.stats().first().documents == 2 and engine.documents().count() == 2
    asked = spark.createDataFrame([(1, "证监会推动什么改革？"), (2, "人工智能")], "query_id int, question string")
    found = engine.ask(asked, "hybrid")
    answer = {r.query_id: r.answer for r in found.answers.collect()}
    assert "证据" in answer[1] and found.citations.count() > 0 and found.relations.count() > 0
    scoped = engine.ask(asked, "vector", doc_ids=[report[0].doc_id], as_of=F.lit("2026-01-15").cast("date"))
    cited = scoped.citations.collect()
    assert cited and all(c.source == "a.txt" for c in cited) and scoped.relations.count() == 0
    assert engine.ask(asked, "graph").citations.count() > 0
    with pytest.raises(ValueError, match="问题不能为空"):
        engine.ask(spark.createDataFrame([(1, " ")], "query_id int, question string"))
    (folder / "c.txt").write_text("。", encoding="utf-8")
    engine.index_files([str(folder / "c.txt")])
    (folder / "c.txt").write_text("  \n", encoding="utf-8")
    with pytest.raises(ValueError, match="No searchable text found in c.txt"):
        engine.index_files([str(folder / "c.txt")])


def test_replaceable_parts(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT, encoding="utf-8")
    none = lambda chunks: extraction.extract_relations(chunks, Lexicon.default()).limit(0)
    engine = EvidenceEngine(spark, EngineConfig(warehouse=str(tmp_path / "w"), embedding_dimensions=32), extractor=none)
    assert engine.index_files([str(tmp_path / "a.txt")]).first().relations == 0
    remote = EvidenceEngine(spark, EngineConfig(warehouse=str(tmp_path / "w"), embedding_provider="openai"))
    with pytest.raises(ValueError, match="base_url"):
        remote.embed(spark.createDataFrame([("a", "b")], "chunk_id string, content string"))
    shown = answering.citations_for_display(engine.ask(spark.createDataFrame([(1, "资本市场")], "query_id int, question string"), "vector").citations)
    assert shown.columns == ["query_id", "number", "title", "source", "page", "score", "excerpt"] and shown.count() == 1


def test_stream_indexes_like_a_call(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(TEXT, encoding="utf-8")
    engine = EvidenceEngine(spark, EngineConfig(warehouse=str(tmp_path / "w"), chunk_size=80, chunk_overlap=20, embedding_dimensions=64))
    for _ in range(2):
        query = index_stream(engine, str(folder), str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert engine.stats().first().documents == 1


def test_entry_has_schema(spark, data):
    assert entry.entry(spark).columns == ["query_id", "question", "answer"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CORE = ["token_counts", "chunk_texts", "chunk_pages", "hash_embedding", "cosine_batch", "lexicon_mentions", "relation_labels", "merged_relations", "question_terms", "graph_seeds", "graph_two_hops", "node_styles", "rank_fusion", "prompt_texts", "catalog_rows"]


WHOLE = ["content_features", "content_embedding", "chunk_lookup_all", "rank_fusion_all", "citations_all", "prompt_texts_all", "extractive_answers_all"]


@pytest.mark.parametrize("name", [*CORE, *WHOLE])
def test_query_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "chunks", "parsed_pages", "relations", "lexicon", "doc_catalog", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    con.execute("set timezone = 'UTC'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = [dict(zip(columns, row, strict=True)) for row in found.fetchall()]
    got = entry.queries()[name](spark, data)
    names = sorted(got.columns)
    plain = lambda rows: sorted(repr([r[n] if not isinstance(r[n], datetime.datetime) else r[n].isoformat()[:19] for n in names]) for r in rows)
    assert plain([r.asDict() for r in got.collect()]) == plain(want)


def test_blake_embedding_of_contents(spark, data):
    found = {}
    for r in entry.queries()["content_embedding_blake"](spark, data).collect():
        found.setdefault(r.chunk_id, {})[r.place] = r.value
    for r in spark.read.parquet(f"{data}/chunks.parquet").where("chunk_id is not null and content is not null").select("chunk_id", "content").distinct().collect():
        words = [w.lower() for w in re.findall("[\u3400-\u9fff]|[A-Za-z0-9_]+", r.content)]
        totals = np.zeros(384)
        for feature in words + [f"{a}::{b}" for a, b in zip(words, words[1:], strict=False)]:
            raw = hashlib.blake2b(feature.encode(), digest_size=16).digest()
            totals[int.from_bytes(raw[:8], "big") % 384] += 1 if raw[8] % 2 else -1
        want = totals / (np.linalg.norm(totals) or 1)
        assert found.get(r.chunk_id, {}) == pytest.approx({i: v for i, v in enumerate(want) if v}, abs=1e-6)


def test_nothing_is_indexed_yet(spark, tmp_path):
    engine = EvidenceEngine(spark, EngineConfig(warehouse=str(tmp_path / "w"), embedding_dimensions=16))
    asked = spark.createDataFrame([(1, "证监会推动什么改革？")], "query_id int, question string")
    for mode in ("vector", "graph", "hybrid"):
        found = engine.ask(asked, mode)
        assert [r.answer for r in found.answers.collect()] == [answering.REFUSAL] and found.citations.count() == 0
    assert engine.documents().count() == 0
    assert engine.stats().first().asDict() == {"documents": 0, "chunks": 0, "entities": 0, "relations": 0, "vector_backend": "native", "graph_backend": "native"}
    for blank in ("", " \n", "\u3000", None):
        with pytest.raises(ValueError, match="问题"):
            engine.ask(spark.createDataFrame([(1, blank)], "query_id int, question string"))


def test_store_writes_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FANOUT", 3)
    root = f"file://{tmp_path}/s"
    kept = store.Store(spark, root)
    columns = store.SCHEMAS["vectors"]
    rows = lambda *r: spark.createDataFrame([(c, d, [float(v)]) for c, d, v in r], columns)
    for i in range(4):
        base, state = kept.state()
        kept.commit(base, state, {"vectors": rows(("a", "x", i), (f"b{i}", "y", i))})
    base, state = kept.state()
    assert [d["level"] for d in state["tables"]["vectors"]] == [1, 0]
    reader = kept.read("vectors", state)
    kept.commit(base, state, {"vectors": rows(("n", "y", 9))}, removed=spark.createDataFrame([("y",)], "doc_id string"))
    assert {(r.chunk_id, r.embedding[0]) for r in kept.read("vectors").collect()} == {("a", 3.0), ("n", 9.0)}
    assert reader.count() == 5  # a reader of the older version still has it
    with pytest.raises(ConcurrentWrite):
        kept.commit(base, state, {"vectors": rows(("z", "z", 1))})
    assert kept.read("vectors").count() == 2 and kept.vacuum() > 0 and kept.read("vectors").count() == 2 and kept.vacuum() == 0


def test_commit_does_not_read_the_store(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    base, state = kept.state()
    kept.commit(base, state, {"catalog": spark.createDataFrame([("d", "t", "s", None, "p", 1, None)], store.SCHEMAS["catalog"])})
    shutil.rmtree(kept.state()[1]["tables"]["catalog"][0]["path"].removeprefix("file://"))
    base, state = kept.state()
    kept.commit(base, state, {"catalog": spark.createDataFrame([("e", "t", "s", None, "p", 1, None)], store.SCHEMAS["catalog"])})

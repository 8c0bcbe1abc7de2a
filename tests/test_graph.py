"""Extraction and the relation graph."""

import pytest
from pyspark.sql import functions as F

from newsloom.lexicon import Lexicon, default_table
from newsloom.operators import chunking, extraction, graph
from newsloom.sources import text

POLICY = "中国证监会发布《资本市场监管办法》，该政策影响证券业。"
NOTICE = "研究院观察到市场平稳。中国证监会今日介绍资本市场情况。"


def _relations(spark, content, title="政策新闻"):
    docs = text.from_text(spark.createDataFrame([(title, content)], "name string, text string"))
    chunks = chunking.chunk_single(docs, 1024, 256).withColumnRenamed("doc_id", "doc_id")
    return extraction.extract_relations(chunks, Lexicon.default())


def _numbered(rows):
    ordered = rows.orderBy("sent_no", "emit_no").collect()
    return [(i, r.source, r.relation, r.target, r.chunk_id, r.doc_id, r.confidence, r.source_type, r.target_type) for i, r in enumerate(ordered)]


SCHEMA = "seq bigint, source string, relation string, target string, chunk_id string, doc_id string, confidence double, source_type string, target_type string"


def test_extraction_golden(spark):
    rows = _numbered(_relations(spark, POLICY))
    assert [r[1:4] + (r[6], r[7], r[8]) for r in rows[:4]] == [
        ("中国证监会", "发布", "资本市场", 0.72, "机构", "行业"),
        ("资本市场", "发布", "资本市场监管办法", 0.72, "行业", "政策"),
        ("资本市场监管办法", "发布", "该政策影响证券", 0.72, "政策", "公司"),
        ("该政策影响证券", "发布", "证券业", 0.72, "公司", "行业"),
    ]
    assert [(r[1], r[2], r[3], r[6]) for r in rows[4:]] == [(n, "来源于", "政策新闻", 1.0) for n in ("中国证监会", "资本市场", "资本市场监管办法", "该政策影响证券", "证券业")]
    assert rows[0][4:6] == ("cc1da3a5f1277e2c0ab066e4", "8bee46fdbdfe5c6e38d0581e")
    merged = graph.merge_relations(spark.createDataFrame(rows, SCHEMA))
    assert merged.where("seq = 0").first().id == "2bee1c0638b047db15b08d4cbdcf3c45"
    assert graph.counts(merged).first().asDict() == {"entities": 6, "relations": 9}


@pytest.mark.parametrize(("hops", "want"), [(1, [0, 4]), (2, [0, 4, 1, 5, 6, 7, 8]), (3, [0, 4, 1, 5, 6, 7, 8, 2, 3])])
def test_search_golden(spark, hops, want):
    merged = graph.merge_relations(spark.createDataFrame(_numbered(_relations(spark, POLICY)), SCHEMA))
    asked = spark.createDataFrame([(1, "证监会发布了什么政策？"), (2, "。"), (3, "毫无关系的句子")], "query_id int, question string")
    out = graph.search(asked, merged, hops, aliases=Lexicon.default().aliases).orderBy("pos").collect()
    assert [r.seq for r in out] == want and {r.query_id for r in out} == {1}
    assert [r.seq for r in graph.search(asked, merged, hops, 3, aliases=Lexicon.default().aliases).orderBy("pos").collect()] == want[:3]
    assert [r.seq for r in graph.search(asked, merged, hops, 0, aliases=Lexicon.default().aliases).orderBy("pos").collect()] == [0]


def test_terms(spark):
    out = graph.question_terms(spark.createDataFrame([(1, "证监会发布了什么政策？ABC abc a")], "query_id int, question string"), Lexicon.default().aliases).first()
    assert out.terms == ["证监会发布了什么政策", "abc", "证监会", "中国证监会"]


def test_event_edge_single_entity_and_no_entity(spark):
    rows = _numbered(_relations(spark, "央行宣布改革与监管并行。今天天气好。", "题"))
    assert [(r[1], r[2], r[3], r[6], r[8]) for r in rows] == [("中国人民银行", "监管", "改革", 0.62, "事件"), ("中国人民银行", "来源于", "题", 1.0, "文档")]


def test_repeated_edge_last_value_first_place(spark):
    rows = spark.createDataFrame([(5, "a", "r", "b", "c", "d", 0.5, "X", None), (7, "a", "r", "b", "c", "d", 0.9, "Y", "Z"), (6, None, "r", "b", "c", "d", 0.9, "Y", "Z")], SCHEMA)
    row = graph.merge_relations(rows).collect()
    assert [(r.seq, r.confidence, r.source_type, r.target_type) for r in row] == [(5, 0.9, "X", "Entity")]


def test_fallback_scope_and_hub_limit(spark):
    rows = [(i, f"s{i % 3}", "owns", "hub", f"c{i}", f"d{i % 2}", 0.5, "A", "B") for i in range(200)] + [(300, "hub", "near", "far", "c", "d0", 0.5, "A", "B")]
    merged = graph.merge_relations(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([(1, "who owns?"), (2, "about s1")], "query_id int, question string")
    out = graph.search(asked, merged, 2, 5)
    assert [r.seq for r in out.where("query_id = 1").orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert [r.seq for r in out.where("query_id = 2").orderBy("pos").collect()] == [1, 4, 7, 10, 13]
    everything = graph.search(asked.where("query_id = 2"), merged, 2, 500).orderBy("pos").collect()
    assert len(everything) == 201 and [r.hop for r in everything].count(1) == 67
    scoped = graph.search(asked.where("query_id = 2"), merged, 1, 5, ["d0"]).orderBy("pos").collect()
    assert [r.seq for r in scoped] == [4, 10, 16, 22, 28]
    with pytest.raises(ValueError, match="dialect"):
        graph.search(asked, merged, dialect="x")


def test_lexicon_table_and_styles(spark):
    assert Lexicon.from_table(default_table(spark)).aliases[0] == ("证监会", "中国证监会")
    rows = [(1, "a" * 13, "r", "b", "c", "d", 0.5, "公司", "机构"), (2, "a" * 13, "q", "b", "c", "d", 0.7, "公司", "行业"), (3, "b", "r", "b", "c", "d", 0.5, "机构", "机构")]
    merged = graph.merge_relations(spark.createDataFrame(rows, SCHEMA))
    assert {(r.source[:1], r.relation, r.confidence) for r in graph.simple_edges(merged).collect()} == {("a", "q", 0.7), ("b", "r", 0.5)}
    styles = {r.name[:1]: r for r in graph.node_styles(merged).collect()}
    assert styles["a"].label == "a" * 11 + "…" and styles["b"].degree == 3 and styles["b"]["size"] == 32 and styles["b"].entity_type == "机构"


def test_companies_keep_their_places(spark):
    row = spark.createDataFrame([("甲公司，星河科技股份有限公司与，乙集团",)], "s string").select(extraction._matches(F.col("s"), extraction.COMPANY).alias("m")).first()
    assert [(m.name, m.pos) for m in row.m] == [("星河科技", 4)] or all("甲公司，星河科技股份有限公司与，乙集团"[m.pos :].startswith(m.name) for m in row.m)


def test_a_long_lexicon_finds_the_same(spark, monkeypatch):
    rows = [("c1", "d1", "标题", "中国证监会发布意见，推动资本市场改革；央行支持人工智能。术语0699号与华夏银行合作"), ("c2", "d1", None, "没有什么"), ("c3", "d2", "t", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, content string")
    more = spark.createDataFrame([(f"术语{i:04d}号", "industry", "行业", None, 1000 + i) for i in range(700)], "term string, kind string, entity_type string, canonical string, ord int")
    lexicon = Lexicon.from_table(default_table(spark).unionByName(more))
    plain = lambda df: sorted(map(repr, df.collect()))
    long = plain(extraction.extract_relations(chunks, lexicon))
    assert any("术语0699号" in r for r in long)
    short = plain(extraction.extract_relations(chunks, Lexicon.default()))
    monkeypatch.setattr(extraction, "INLINE", 0)
    assert plain(extraction.extract_relations(chunks, Lexicon.default())) == short
    monkeypatch.setattr(extraction, "INLINE", 10_000)
    assert plain(extraction.extract_relations(chunks, lexicon)) == long


def test_a_usual_pair_of_characters_is_no_hot_key(spark):
    """All names and questions share a beginning: they are joined by a rarer pair."""
    names = spark.range(3000).selectExpr("concat('股份公司', id, '号') as name")
    asked = graph.question_terms(spark.range(300).selectExpr("id as query_id", "concat('股份公司', id * 7, '号怎么样') as question"))
    got = {(r.query_id, r.name) for r in graph.seeds(asked, names).collect()}
    want = set()
    for q in range(300):
        question = f"股份公司{q * 7}号怎么样"
        terms = {"股份公司", "号怎么样"} | ({str(q * 7)} if q * 7 >= 10 else set())
        want |= {(q, f"股份公司{i}号") for i in range(3000) if f"股份公司{i}号" in question or any(t in f"股份公司{i}号" for t in terms)}
    assert got == want


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_a_scoped_path_search_keeps_no_relations_on_the_way(spark, monkeypatch, hops):
    """Against a traversal of all relations; what is written is far less than what lies within the hops."""
    rows = [(i, f"n{i * 7 % 61}", "owns", f"n{i * i % 53}", f"c{i % 5}", f"d{i % 40}", 0.5, "A", "B") for i in range(1500)]
    rows += [(2000 + i, f"n{i}", "owns", "hub", "c", f"d{i % 3}", 0.5, "A", "B") for i in range(60)] + [(2100 + i, "m0", "near", f"n{i}", "c9", "d1", 0.5, "A", "B") for i in range(3)]
    rows += [(3000 + i, *r[1:5], "d1", *r[6:]) for i, r in enumerate(rows[:200])]  # the same edges in another document
    merged = graph.merge_relations(spark.createDataFrame(rows, SCHEMA)).cache()
    asked = spark.createDataFrame([(i, f"about n{10 + i}") for i in range(30)] + [(90, "m0?"), (91, "nothing")], "query_id int, question string")
    names = merged.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    terms = graph.question_terms(asked)
    direct = F.col("question").contains(F.col("name")) | F.exists("terms", lambda t: F.lower("name").contains(t))
    seeded = terms.crossJoin(names).where(direct).select("query_id", "name")
    whole = graph.traverse(seeded, merged, hops, 1 << 30).join(graph.scoped(merged, ["d1", "d7"]), "id").collect()
    want = {}
    for r in sorted(whole, key=lambda r: r.pos):
        want.setdefault(r.query_id, []).append((r.hop, r.seq))
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name, *a: written.append((name, keep(df, name, *a))) or written[-1][1])
    got = {}
    for r in graph.search(asked, merged, hops, 25, ["d1", "d7"], dialect="path").orderBy("pos").collect():
        got.setdefault(r.query_id, []).append((r.hop, r.seq))
    assert got == {q: v[:25] for q, v in want.items()} and got
    assert max(df.count() for name, df in written if name != "seeds") <= 2500  # questions by names, not by relations

"""Shared spans and splitting, against brute force."""

import random
import re

import pytest

from newsloom.llm import shared_spans, splitting
from newsloom.runtime import settings
from newsloom.sources.versions import ConcurrentWrite


def _brute(texts, span):
    out = {}
    for key, text in texts.items():
        covered = set()
        for i in range(len(text) - span + 1):
            part = text[i : i + span]
            if any(part in other for k, other in texts.items() if k != key):
                covered.update(range(i, i + span))
        if covered:
            out[key] = len(covered)
    return out


@pytest.mark.parametrize("batches", [1, 9])
def test_spans_equal_brute_force(spark, batches):
    rng = random.Random(batches)
    text = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛x ") for _ in range(n))
    passages = [text(n) for n in (120, 119, 121, 300, 130)]
    texts = {i: text(rng.randrange(0, 200)) + rng.choice(passages) + text(rng.randrange(0, 100)) + rng.choice([*passages, ""]) for i in range(40)}
    texts |= {100: passages[3] * 3, 101: "重" * 400, 102: "重" * 150, 103: texts[0], 104: texts[0], 105: "短"}
    rows = [(k, v, "x") for k, v in texts.items()] + [(0, texts[0], "x"), (200, None, "x"), (201, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rec string").repartition(4)
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared_spans(docs, batches=batches).collect()}
    assert got == _brute(texts, 120)


def test_spans_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert shared_spans.shared_spans(docs).count() == 0
    one = spark.createDataFrame([(1, "长" * 500), (1, "长" * 500)], "doc_id bigint, text string")
    assert shared_spans.shared_spans(one).count() == 0
    with pytest.raises(ValueError, match="window"):
        shared_spans.shared_spans(docs, window=120)


def test_index_of_another_session(spark, tmp_path):
    """Batches are added to an index that another session has written; tiers are verified and compacted."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(n))
    passage = text(150)
    texts = {i: text(60) + (passage if i % 3 == 0 else "") + text(80) for i in range(18)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    root = f"file://{tmp_path}/index"
    for part in range(6):
        session = spark.newSession()
        index = shared_spans.FingerprintIndex(session, root, fanout=2, buckets=3)
        rows = session.createDataFrame([(k, v) for k, v in texts.items() if k % 6 == part], "doc_id bigint, text string")
        index.add(rows, corpus=session.createDataFrame([(k, v) for k, v in texts.items() if k % 6 <= part], "doc_id bigint, text string"))
    assert [len(t) for t in index.state["tiers"]] == [0, 1, 1] and index.number == 6
    late = shared_spans.FingerprintIndex(spark.newSession(), root)
    late.verify(docs)
    assert {r.doc_id: r.shared_chars for r in late.spans().collect()} == _brute(texts, 120)
    with pytest.raises(ConcurrentWrite):
        index.add(docs)


def test_runs_are_merged_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i % 5:04d}" * 50) for i in range(30)], "doc_id bigint, text string")
    index = shared_spans.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=9)
    for part in range(3):
        index.add(docs.where(f"doc_id % 3 = {part}"))
    with settings(spark, index._settings()):
        runs = [index.run(p) for p in index.runs()]
        plan = index.hits(runs[2], runs[:2])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Union") :]
    assert below.count("SortMergeJoin") == 2 and "Exchange" not in below and " Sort [" not in below and plan.count("Exchange") == 1


def test_compaction_keeps_one_row_a_hash(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i % 5:04d}" * 50) for i in range(30)], "doc_id bigint, text string")
    index = shared_spans.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=3)
    for part in range(3):
        index.add(docs.where(f"doc_id % 3 = {part}"), corpus=docs)
    assert [len(t) for t in index.state["tiers"]] == [0, 1]
    rows = index.run(index.runs()[0])
    assert rows.count() == rows.select("fp").distinct().count() > 0


TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")


def _texts():
    rng = random.Random(5)
    sentence = lambda n: "".join(rng.choice("天地玄黄宇宙洪荒，") for _ in range(n))
    out = {"prose": "。".join(sentence(rng.randrange(5, 60)) for _ in range(120)) + "。", "unbroken": sentence(3000), "latin": " ".join("word%d" % i for i in range(1500)), "lines": "\n".join(sentence(90) for _ in range(30))}
    out |= {"exact": "字" * 512, "over": "字" * 513, "mixed": sentence(100) + "。" + sentence(700) + "！" + sentence(100), "quote": ("他说：“" + sentence(30) + "。”") * 40, "ends": "。" * 1200, "blank": " \n\u3000", "none": None, "empty": ""}
    return out


def test_pieces(spark):
    texts = _texts()
    pages = spark.createDataFrame([(i, k, None, t, 1) for i, (k, t) in enumerate(texts.items())] + [(0, "prose", None, texts["prose"], 1)], "page_id bigint, doc_id string, page_number int, text string, rec_kind int")
    chunks = spark.createDataFrame([("c1", "字" * 600), ("c2", None), ("c2", None)], "chunk_id string, content string")
    names = list(texts)
    by = {}
    for r in splitting.split_items(pages, chunks).collect():
        by.setdefault(r.rec_id, []).append(r)
    assert set(by) == {str(i) for i, k in enumerate(names) if k not in ("blank", "none", "empty")} | {"c1"}
    for rec, rows in by.items():
        rows.sort(key=lambda r: r.chunk_index)
        text = texts[names[int(rec)]] if rec != "c1" else "字" * 600
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        whole = [t for r in rows for t in TOKEN.findall(r.content)[r.repeated :]]
        assert whole == TOKEN.findall(text)
        for a, b in zip(rows, rows[1:]):
            assert b.repeated == 64 and TOKEN.findall(a.content)[-64:] == TOKEN.findall(b.content)[:64]
        assert all(r.n_tokens == len(TOKEN.findall(r.content)) <= 512 and r.content in text for r in rows)
        if rec != "c1" and names[int(rec)] in ("prose", "lines", "quote", "ends"):
            assert all(r.cut != "hard" for r in rows)
    got = {(r.rec_kind, r.rec_id): r.hard_cut for r in splitting.oversized(pages, chunks).collect()}
    want = {}
    for i, t in enumerate(texts.values()):
        if t and len(TOKEN.findall(t)) > 512:
            want["page", str(i)] = int(max(len(TOKEN.findall(s)) for s in re.split(r"[。！？!?；;\n]+", t)) > 512)
    assert got == want | {("chunk", "c1"): 1}
    assert splitting.oversized(pages.limit(0), chunks.limit(0)).count() == 0


def test_edit_alters_neighbours_only():
    text = _texts()["prose"] * 4
    edited = text[:2000] + "插入几个字" + text[2000:]
    cuts = lambda t: {t[s.spans[p.fresh, 0] : s.spans[p.stop - 1, 1]] for s in [splitting.TokenSpans(t)] for p in splitting.cut_pieces(s)}
    a, b = cuts(text), cuts(edited)
    assert len(a - b) <= 4 and len(b - a) <= 5


def test_parameters(spark):
    pages = spark.createDataFrame([], "page_id bigint, text string")
    chunks = spark.createDataFrame([], "chunk_id string, content string")
    with pytest.raises(ValueError, match="overlap"):
        splitting.oversized(pages, chunks, 100, 100)

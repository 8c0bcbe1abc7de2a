"""Sources, chunking and embedding."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from newsloom.config import EngineConfig, as_bool, load_dotenv
from newsloom.operators import chunking, embedding
from newsloom.sources import connectors, files, text

SENTENCE = "资本市场监管强调防风险。"


def test_windows_and_ids(spark):
    rows = spark.createDataFrame([(SENTENCE * 20,)], "text string").select(text.doc_id(F.col("text")).alias("doc_id"), F.lit(1).alias("page_number"), "text")
    out = chunking.chunk_single(rows, 30, 8).orderBy("chunk_index").collect()
    assert len(out) == 11 and {r.doc_id for r in out} == {"b6c1fb0a4a26b177c13443c1"}
    assert len({r.chunk_id for r in out}) == 11 and len(out[-1].content) == 20


@pytest.mark.parametrize(("size", "overlap"), [(10, 10), (0, 0), (5, -1)])
def test_bad_windows(size, overlap):
    with pytest.raises(ValueError, match="overlap"):
        chunking.check_window(size, overlap)


def test_index_runs_through_pages_and_missing_page_is_none(spark):
    rows = spark.createDataFrame([("d", 1, "甲乙丙丁", 0), ("d", None, "  \u3000", 1), ("d", None, "x\u3000\u00a0y z ", 2), ("e", 2, None, 0)], "doc_id string, page_number int, text string, page_pos int")
    out = chunking.chunk_pages(rows, 3, 1).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content) for r in out] == [(0, "甲乙丙"), (1, "丙丁"), (2, "x\u3000\u00a0y z")]
    want = spark.sql("select substr(sha2(concat('d:None:2:', 'x\u3000\u00a0y z'), 256), 1, 24) as i").first().i
    assert out[2].chunk_id == want
    empty = chunking.without_chunks(rows.select("doc_id").distinct(), chunking.chunk_pages(rows, 3, 1))
    assert [r.doc_id for r in empty.collect()] == ["e"]


def test_reference_feature_places():
    assert embedding.blake_place("监", 384) == (89, 1)
    assert embedding.blake_place("监::管", 384) == (263, -1)


@pytest.mark.parametrize("scheme", ["sha256", "blake2b"])
def test_embedding_is_unit_or_zero(spark, scheme):
    rows = spark.createDataFrame([("a", "监管 Alpha alpha"), ("b", "。！"), ("c", None), ("d", "")], "chunk_id string, content string")
    out = {r.chunk_id: r.embedding for r in embedding.hash_embed(rows, 64, scheme).collect()}
    assert set(out) == {"a", "b", "c", "d"} and all(len(v) == 64 for v in out.values())
    assert math.isclose(sum(x * x for x in out["a"]), 1) and not any(map(any, (out["b"], out["c"], out["d"])))


def test_features(spark):
    row = spark.createDataFrame([("Café 监管X",)], "t string").select(embedding.features(F.col("t")).alias("f")).first()
    assert row.f == ["caf", "监", "管", "x", "caf::监", "监::管", "管::x"]


def test_title_date_and_identity(spark):
    raw = "# 证\n发布时间：2026年1月15日\n# 证监会明确资本市场监管工作主线\n"
    row = spark.createDataFrame([(raw,)], "t string").select(text.publish_time(F.array("t")).alias("p"), text.title(F.col("t"), F.lit("stem")).alias("t"), text.title(F.lit("日期：2020"), F.lit("stem")).alias("s"), text.publish_time(F.array(F.lit("date: 2020-01-01"))).alias("n")).first()
    assert (row.p, row.t, row.s, row.n) == ("2026年1月15日", "发布时间：2026年1月15日", "stem", None)


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t> One </w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t> b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def _xlsx() -> bytes:
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>h, x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_parsers():
    assert files.parse_bytes(".csv", "\ufeffa, b\n\"c,d\",e\n".encode()) == [("a | b\nc,d | e", None)]
    assert files.parse_bytes(".html", b"<title>T</title><p> x &amp; y </p><script>s</script>") == [("T\nx & y\ns", None)]
    assert files.parse_bytes(".DOCX", _docx()) == [("One\nTwo\na | b", None)]
    assert files.parse_bytes(".xlsx", _xlsx()) == [('工作表：S\n"h, x",,3\n1,,\n', 1)]
    assert files.parse_bytes(".md", b"# x\0y") == [("# xy", None)]
    assert files.clean("公式字符：\ud835，正文继续") == "公式字符：?，正文继续"
    with pytest.raises(ValueError, match="unsupported"):
        files.parse_bytes(".exe", b"")
    with pytest.raises(UnicodeDecodeError):
        files.parse_bytes(".txt", b"\xff")


def test_paths(tmp_path, spark):
    with pytest.raises(FileNotFoundError):
        files.check_paths([str(tmp_path / "no.txt")])
    (tmp_path / "a.txt").write_text("发布日期：2026-01-02\n正文内容在此", encoding="utf-8")
    row = files.read_files(spark, [str(tmp_path / "a.txt")]).first()
    assert (row.source, row.publish_time, row.page_number, row.metadata["file_type"]) == ("a.txt", "2026-01-02", None, "txt")
    copied = files.read_files(spark, [str(tmp_path / "a.txt")], str(tmp_path / "up")).first().metadata["stored_path"]
    assert copied == str(tmp_path / "up" / f"{row.doc_id}.txt") and (tmp_path / "up" / f"{row.doc_id}.txt").read_text(encoding="utf-8").startswith("发布日期")
    assert files.store_copy((tmp_path / "a.txt").read_bytes(), ".TXT", row.doc_id, str(tmp_path / "up")) == copied


def test_config(tmp_path, monkeypatch):
    assert EngineConfig.from_env({"NEWSLOOM_CHUNK_SIZE": "80", "NEWSLOOM_CHUNK_OVERLAP": "20"}).chunk_size == 80
    for wrong in ({"chunk_size": 10, "chunk_overlap": 10}, {"top_k": 0}, {"graph_backend": "x"}):
        with pytest.raises(ValueError, match="must"):
            EngineConfig(**wrong)
    (tmp_path / ".env").write_text("# c\nLOOM_A='1'\nnothing\nLOOM_B=2\n")
    monkeypatch.setenv("LOOM_B", "kept")
    assert load_dotenv(str(tmp_path / ".env")) == {"LOOM_A": "1", "LOOM_B": "2"}
    assert as_bool("Yes") and not as_bool("0") and as_bool(None, True)


def test_connectors_say_what_is_missing(spark):
    rows = spark.createDataFrame([("a", "d", [1.0])], "chunk_id string, doc_id string, embedding array<double>")
    with pytest.raises(ValueError, match="base_url"):
        connectors.remote_embed(rows, "", "m")
    for make in (connectors.VectorService, connectors.GraphService):
        with pytest.raises(ValueError, match="url"):
            make("")
    with pytest.raises(RuntimeError, match="failed"):
        connectors.VectorService("http://127.0.0.1:9").count()
    assert connectors.point_id("x") == connectors.point_id("x")

"""The engine over a vector service and a graph service, played by a server of this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from newsloom.config import EngineConfig
from newsloom.engine import EvidenceEngine
from newsloom.sources import connectors


class Services(BaseHTTPRequestHandler):
    points: dict = {}
    edges: dict = {}
    made: list = []

    def log_message(self, *_):
        pass

    def _reply(self, body, code=200):
        raw = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _body(self):
        return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")

    def do_GET(self):
        self._reply({}, 200 if self.made else 404)

    def do_PUT(self):
        body = self._body()
        if self.path.split("?")[0].endswith("/points"):
            self.points.update({p["id"]: p for p in body["points"]})
        else:
            self.made.append(body["vectors"])
        self._reply({})

    def do_POST(self):
        body = self._body()
        if self.path.endswith("/search"):
            scope = body.get("filter", {"must": []})["must"]
            kept = [p for p in self.points.values() if all(p["payload"][m["key"]] in m["match"]["any"] for m in scope)]
            v = np.array(body["vector"])
            scored = sorted(((float(v @ np.array(p["vector"])), p) for p in kept), key=lambda x: -x[0])[: body["limit"]]
            self._reply({"result": [{"score": s, "payload": p["payload"]} for s, p in scored]})
        elif self.path.endswith("/count"):
            self._reply({"result": {"count": len(self.points)}})
        elif self.path.endswith("/scroll"):
            names = sorted(self.points)
            start = names.index(body["offset"]) if body["offset"] else 0
            page = names[start : start + body["limit"]]
            after = names[start + body["limit"]] if start + body["limit"] < len(names) else None
            self._reply({"result": {"points": [self.points[n] for n in page], "next_page_offset": after}})
        elif self.path.endswith("/points"):
            self._reply({"result": [self.points[i] for i in body["ids"] if i in self.points]})
        else:
            statement = body["statements"][0]
            rows, given = [], statement["parameters"]
            if statement["statement"] == connectors.GraphService.UPSERT:
                self.edges.update({r["id"]: r for r in given["rows"]})
            elif statement["statement"] == connectors.GraphService.COUNT:
                rows = [[len({e[k] for e in self.edges.values() for k in ("source", "target")}), len(self.edges)]]
            else:
                named = lambda n: n in given["question"] or any(t in n.lower() for t in given["terms"])
                near = sorted((e["seq"], i) for i, e in self.edges.items() if (named(e["source"]) or named(e["target"])) and (not given["docs"] or e["doc_id"] in given["docs"]))
                rows = [[i, 1] for _, i in near[: given["limit"]]]
            self._reply({"results": [{"data": [{"row": r} for r in rows]}], "errors": []})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Services)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_engine_over_services(spark, tmp_path, url):
    (tmp_path / "a.txt").write_text("中国证监会发布意见，推动资本市场改革。华夏银行支持人工智能。", encoding="utf-8")
    (tmp_path / "b.txt").write_text("天气晴朗。半导体行业投资增长。", encoding="utf-8")
    settings = {"warehouse": str(tmp_path / "w"), "embedding_dimensions": 64}
    engine = EvidenceEngine(spark, EngineConfig(vector_backend="qdrant", vector_url=url, graph_backend="neo4j", graph_url=url, graph_user="u", **settings))
    report = {r.source: r for r in engine.index_files([str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()}
    service, graph = engine.vector_service, engine.graph_service
    assert service.count() == 2 and Services.made == [{"size": 64, "distance": "Cosine"}] and graph.counts()[1] == len(Services.edges) > 0
    assert sum(len(page) for page in service.scroll(1)) == 2
    known = next(iter(Services.points.values()))["payload"]["chunk_id"]
    found = service.lookup(spark.createDataFrame([(known,), ("none",)], "chunk_id string")).collect()
    assert [r.chunk_id for r in found] == [known]
    native = EvidenceEngine(spark, EngineConfig(**settings))
    asked = spark.createDataFrame([(1, "证监会推动什么改革？"), (2, "半导体")], "query_id int, question string")
    for mode in ("vector", "hybrid"):
        one, other = ({(r.query_id, r.number, r.chunk_id) for r in e.ask(asked, mode).citations.collect()} for e in (engine, native))
        assert one == other and one
    scoped = engine.ask(asked, "graph", doc_ids=[report["b.txt"].doc_id])
    assert {r.doc_id for r in scoped.relations.collect()} == {report["b.txt"].doc_id}
    assert engine.stats().first().vector_backend == "qdrant"

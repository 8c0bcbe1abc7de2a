"""Optional services over HTTP: remote embeddings, a vector service and a graph service.

They give what the native tables give. Tasks talk to the services themselves; nothing passes the driver.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from newsloom.operators.answering import post_json

BATCH = 64
POINTS = 256
PAYLOAD = ["chunk_id", "doc_id", "content", "title", "source", "page_number", "publish_time", "chunk_index"]


def remote_embed(texts: DataFrame, base_url: str, model: str, api_key: str = "", timeout: int = 120, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, embedding`` from an embeddings service, in the order of its ``index``; a request a batch."""
    if not base_url:
        raise ValueError("base_url must be set")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), BATCH):
                part = rows.iloc[start : start + BATCH]
                reply = post_json(f"{base_url.rstrip('/')}/embeddings", {"model": model, "input": part[text].tolist()}, api_key, timeout)
                ordered = sorted(reply["data"], key=lambda d: d["index"])
                yield pd.DataFrame({key: part[key].tolist(), "embedding": [[float(x) for x in d["embedding"]] for d in ordered]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


def point_id(chunk_id: str, prefix: str = "chunk:") -> str:
    """A stable id of a chunk in the vector service."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, prefix + chunk_id))


def call(method: str, url: str, body: dict | None = None, headers: dict[str, str] | None = None, timeout: int = 120) -> dict | None:
    """The JSON reply; None for 404."""
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}), method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read() or b"{}")
    except urllib.error.HTTPError as error:
        if error.code == 404:
            return None
        raise RuntimeError(f"request to {url} failed: {error}") from error
    except (urllib.error.URLError, TimeoutError, ValueError) as error:
        raise RuntimeError(f"request to {url} failed: {error}") from error


@dataclass(frozen=True)
class VectorService:
    """A collection of a vector service: points by chunk, with the chunk as payload."""

    url: str
    collection: str = "chunks"
    timeout: int = 120

    def __post_init__(self) -> None:
        if not self.url:
            raise ValueError("vector_url must be set")

    @property
    def base(self) -> str:
        return f"{self.url.rstrip('/')}/collections/{self.collection}"

    def ensure(self, dimensions: int) -> None:
        """Make the collection if it isn't there."""
        if call("GET", self.base, timeout=self.timeout) is None:
            call("PUT", self.base, {"vectors": {"size": dimensions, "distance": "Cosine"}}, timeout=self.timeout)

    def upsert(self, rows: DataFrame) -> None:
        """Chunks with their ``embedding``, by partition, a few hundred points a request."""
        base, timeout, names = self.base, self.timeout, [c for c in PAYLOAD if c in rows.columns]

        def send(part: Iterator) -> None:
            points = []
            for row in part:
                points.append({"id": point_id(row.chunk_id), "vector": list(row.embedding), "payload": {c: row[c] for c in names}})
                if len(points) == POINTS:
                    call("PUT", f"{base}/points?wait=true", {"points": points}, timeout=timeout)
                    points = []
            if points:
                call("PUT", f"{base}/points?wait=true", {"points": points}, timeout=timeout)

        rows.select(*names, "embedding").foreachPartition(send)

    def search(self, queries: DataFrame, k: int, doc_ids: list[str] | None = None) -> DataFrame:
        """``query_id, chunk_id, score, rank``: a request a query."""
        base, timeout = self.base, self.timeout
        scope = {"filter": {"must": [{"key": "doc_id", "match": {"any": doc_ids}}]}} if doc_ids else {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for query_id, vector in zip(batch["query_id"], batch["embedding"], strict=True):
                    reply = call("POST", f"{base}/points/search", {"vector": [float(x) for x in vector], "limit": k, "with_payload": ["chunk_id"]} | scope, timeout=timeout)
                    rows += [(query_id, hit["payload"]["chunk_id"], float(hit["score"]), n) for n, hit in enumerate((reply or {}).get("result", []), 1)]
                yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "rank"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "embedding").mapInPandas(run, f"query_id {kind}, chunk_id string, score double, rank int")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The payloads of ``chunk_id``s; unknown ones are dropped."""
        base, timeout = self.base, self.timeout

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), POINTS):
                    ids = [point_id(c) for c in batch["chunk_id"][start : start + POINTS]]
                    reply = call("POST", f"{base}/points", {"ids": ids, "with_payload": True}, timeout=timeout)
                    yield pd.DataFrame([[hit["payload"].get(c) for c in PAYLOAD] for hit in (reply or {}).get("result", [])], columns=PAYLOAD)

        return wanted.select("chunk_id").distinct().mapInPandas(run, "chunk_id string, doc_id string, content string, title string, source string, page_number int, publish_time string, chunk_index int")

    def scroll(self, limit: int = POINTS) -> Iterator[list[dict]]:
        """All payloads, page by page."""
        offset = None
        while True:
            reply = call("POST", f"{self.base}/points/scroll", {"limit": limit, "with_payload": True, "offset": offset}, timeout=self.timeout)
            found = (reply or {"result": {"points": [], "next_page_offset": None}})["result"]
            yield [p["payload"] for p in found["points"]]
            offset = found.get("next_page_offset")
            if offset is None:
                return

    def count(self) -> int:
        reply = call("POST", f"{self.base}/points/count", {"exact": True}, timeout=self.timeout)
        return 0 if reply is None else reply["result"]["count"]


@dataclass(frozen=True)
class GraphService:
    """A property graph behind a transaction endpoint: Entity nodes, RELATED edges."""

    url: str
    user: str = ""
    password: str = ""
    database: str = "neo4j"
    timeout: int = 120

    UPSERT = (
        "UNWIND $rows AS r MERGE (s:Entity {name: r.source, entity_type: r.source_type}) MERGE (t:Entity {name: r.target, entity_type: r.target_type}) "
        "MERGE (s)-[e:RELATED {id: r.id}]->(t) ON CREATE SET e.relation = r.relation, e.chunk_id = r.chunk_id, e.doc_id = r.doc_id, e.seq = r.seq SET e.confidence = r.confidence"
    )
    SEARCH = (
        "MATCH (s:Entity) WHERE $question CONTAINS s.name OR any(t IN $terms WHERE toLower(s.name) CONTAINS t) MATCH p = (s)-[:RELATED*1..%d]-(:Entity) "
        "UNWIND range(0, length(p) - 1) AS i WITH relationships(p)[i] AS e, i + 1 AS hop WHERE size($docs) = 0 OR e.doc_id IN $docs "
        "WITH e, min(hop) AS hop ORDER BY hop, e.seq LIMIT $limit RETURN e.id, hop"
    )
    COUNT = "MATCH (n:Entity) WITH count(n) AS nodes OPTIONAL MATCH ()-[e:RELATED]->() RETURN nodes, count(e)"

    def __post_init__(self) -> None:
        if not self.url:
            raise ValueError("graph_url must be set")

    def run(self, statement: str, **parameters: object) -> list[list]:
        token = base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        headers = {"Authorization": f"Basic {token}"} if self.user else {}
        reply = call("POST", f"{self.url.rstrip('/')}/db/{self.database}/tx/commit", {"statements": [{"statement": statement, "parameters": parameters}]}, headers, self.timeout)
        if reply is None or reply.get("errors"):
            raise RuntimeError(f"the graph service refused: {(reply or {}).get('errors')}")
        return [row["row"] for row in reply["results"][0]["data"]]

    def upsert(self, relations: DataFrame) -> None:
        """Merged relations, a few hundred a transaction; known ids take the new confidence."""

        def send(part: Iterator) -> None:
            rows = []
            for row in part:
                rows.append(row.asDict())
                if len(rows) == POINTS:
                    self.run(self.UPSERT, rows=rows)
                    rows = []
            if rows:
                self.run(self.UPSERT, rows=rows)

        relations.select("id", "seq", "source", "relation", "target", "chunk_id", "doc_id", "confidence", "source_type", "target_type").foreachPartition(send)

    def search(self, questions: DataFrame, hops: int, limit: int, doc_ids: list[str] | None = None) -> DataFrame:
        """``query_id, id, hop, pos`` of questions (query_id, question, terms), in the path dialect: 1 to 4 hops, scope after the walk."""
        statement = self.SEARCH % min(4, max(1, hops))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for query_id, question, terms in zip(batch["query_id"], batch["question"], batch["terms"], strict=True):
                    if len(terms):
                        found = self.run(statement, question=question, terms=list(terms), docs=doc_ids or [], limit=limit)
                        rows += [(query_id, name, hop, pos) for pos, (name, hop) in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=["query_id", "id", "hop", "pos"])

        kind = questions.schema["query_id"].dataType.simpleString()
        return questions.select("query_id", "question", "terms").mapInPandas(run, f"query_id {kind}, id string, hop int, pos int")

    def counts(self) -> tuple[int, int]:
        """Entities and relations."""
        rows = self.run(self.COUNT)
        return (rows[0][0], rows[0][1]) if rows else (0, 0)

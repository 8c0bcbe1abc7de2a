"""Tables of an engine on shared storage: deltas by key, under numbered versions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import catalog, graph
from newsloom.runtime import file_system
from newsloom.sources.versions import Versions

SCHEMAS = {
    "chunks": "chunk_id string, doc_id string, content string, title string, source string, page_number int, publish_time string, chunk_index int, metadata map<string,string>",
    "vectors": "chunk_id string, doc_id string, embedding array<double>",
    "relations": "id string, seq bigint, source string, relation string, target string, chunk_id string, doc_id string, confidence double, source_type string, target_type string",
    "catalog": "doc_id string, title string, source string, publish_time string, stored_path string, chunk_count int, indexed_at timestamp",
}
FANOUT = 8


class Store:
    """A version lists the deltas of each table. A commit writes its own rows only, whatever the store holds.

    Rows are put together when they are read: the last delta of a key holds (chunks, vectors, catalogue), relations
    are merged by their ids. When ``FANOUT`` deltas of one level are there, they become one of the next, so a
    row is rewritten a logarithmic number of times. Documents that are replaced leave a mark that
    hides their rows of earlier deltas. An empty store reads as empty tables. Two writers: see Versions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root)

    def state(self) -> tuple[int, dict]:
        number, found = self.versions.latest()
        return number, found or {"turn": 0, "next_seq": 0, "removed": [], "tables": {name: [] for name in SCHEMAS}}

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        state = self.state()[1] if state is None else state
        return self._merged(name, state["tables"][name], state["removed"])

    def _merged(self, name: str, deltas: list[dict], removed: list[dict]) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], SCHEMAS[name])
        parts = []
        for delta in deltas:
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(delta["path"])
            later = [r["path"] for r in removed if r["turn"] > delta["turn"]]
            if later and name != "catalog":
                rows = rows.join(self.spark.read.schema("doc_id string").parquet(*later).distinct(), "doc_id", "left_anti").select(rows.columns)
            parts.append(rows)
        if name in ("relations", "catalog"):
            together = parts[0]
            for more in parts[1:]:
                together = together.unionByName(more)
            if len(parts) == 1:
                return together
            return graph.merge_relations(together) if name == "relations" else catalog.upsert(together)
        out, newer = parts[-1], parts[-1].select("chunk_id")
        for older in reversed(parts[:-1]):  # rows whose key no later delta has; only keys are compared
            out = out.unionByName(older.join(newer, "chunk_id", "left_anti").select(older.columns))
            newer = newer.unionByName(older.select("chunk_id"))
        return out

    def commit(self, base: int, state: dict, rows: dict[str, DataFrame], removed: DataFrame | None = None, next_seq: int | None = None) -> int:
        """Write ``rows`` as deltas on top of version ``base``; raises if another writer was faster."""
        turn = state["turn"] + 1
        fresh = {"turn": turn, "next_seq": state["next_seq"] if next_seq is None else next_seq, "removed": list(state["removed"]), "tables": {k: list(v) for k, v in state["tables"].items()}}
        if removed is not None:
            fresh["removed"].append({"path": self._write("removed", removed.select("doc_id")), "turn": turn})
        for name, df in rows.items():
            fresh["tables"][name].append({"path": self._write(name, df.select([c.split()[0] for c in SCHEMAS[name].split(", ")])), "turn": turn, "level": 0})
            self._compact(name, fresh)
        return self.versions.publish(base, fresh)

    def _compact(self, name: str, state: dict) -> None:
        deltas = state["tables"][name]
        while len(deltas) >= FANOUT and len({d["level"] for d in deltas[-FANOUT:]}) == 1:
            last = deltas[-FANOUT:]
            path = self._write(name, self._merged(name, last, state["removed"]))
            del deltas[-FANOUT:]
            deltas.append({"path": path, "turn": last[-1]["turn"], "level": last[-1]["level"] + 1})

    def _write(self, name: str, df: DataFrame) -> str:
        path = os.path.join(self.root, f"{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(path)
        return path

    def vacuum(self) -> int:
        """Delete the folders that the current version doesn't name. Run it while nobody reads an older version or writes."""
        state = self.state()[1]
        named = {d["path"] for deltas in state["tables"].values() for d in deltas} | {r["path"] for r in state["removed"]}
        system, root = file_system(self.spark, self.root)
        gone = 0
        for status in system.listStatus(root) if system.exists(root) else ():
            name = status.getPath().getName()
            if name.split("-")[0] in (*SCHEMAS, "removed") and os.path.join(self.root, name) not in named:
                system.delete(status.getPath(), True)
                gone += 1
        return gone

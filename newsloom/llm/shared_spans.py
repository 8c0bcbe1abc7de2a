"""Exact spans shared between records (problem 9).

A log-structured fingerprint index. Of every text, windows of ``WINDOW`` characters are hashed and
the smallest hash of each stretch is kept (winnowing), so that any span of ``span`` characters
keeps at least one window whatever surrounds it. A batch's kept hashes become an immutable run of (hash,
smallest and largest key), bucketed and sorted by hash like all runs of the index. Adding a batch
merge-joins its run with the runs there are: a hash of the batch that another record holds is a hit of the
batch's records, and of the old record if it was the only one until then. So every record meets each
hash that it shares once, when its second holder arrives, and a hash that stands in a third of the texts
costs one row a run. Hits and the batch's hashes wait in a log until they are verified: the texts that are hit, no others, are
read, every span of ``span`` characters whose own smallest window was hit is hashed, and these marks are
appended. A full tier of runs is verified and then compacted to one run of the next.

The index lives in a folder (numbered versions, see ``sources.versions``) and can be opened by another session.
``FingerprintIndex.spans`` gives what is shared; ``shared_spans`` adds a table in ``BATCHES`` batches by a hash
of the key and reports.

Spans are compared by 64-bit hashes of their characters (two unequal spans of n agree with
probability n * n / 2**65 in all). Null, empty and short texts share nothing. A repeated key is one
record. Exact copies under different keys share their whole text. An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.runtime import file_system, settings, table_path
from newsloom.sources.versions import Versions

SPAN = 120
WINDOW = 40
FANOUT = 8
BATCHES = 8
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + np.uint64(_BASE)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    return _mix(np.arange(0x110000, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, dtype=np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _prefix(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    size = 1 << max(12, len(points).bit_length())
    up, _ = _powers(size)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_characters()[points] * up[: len(points)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` characters."""
    n = len(sums) - width
    _, down = _powers(1 << max(12, (len(sums) - 1).bit_length()))
    return _mix((sums[width:] - sums[:-width]) * down[:n])


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of ``width``, by doubling."""
    at = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        reach += step
    return at


def kept_windows(text: str, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each span, the place of its smallest window; and the windows' hashes."""
    sums = _prefix(text)
    hashes = _hashes(sums, window)
    return _sliding_argmin(hashes, span - window + 1), hashes


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """``rec, fp``: the kept hashes of each text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], np.zeros(batch.num_rows, dtype=np.int64)
            for i, value in enumerate(batch.column(1).to_pylist()):
                at, hashes = kept_windows(value, span, window)
                kept = np.unique(hashes[np.unique(at)])
                found.append(kept)
                sizes[i] = len(kept)
            fps = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            recs = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([recs, pa.array(fps)], names=["rec", "fp"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.where(F.length(text) >= span).select(F.col(key).alias("rec"), text).mapInArrow(run, f"rec {kind}, fp bigint")


#: Bucketed files keep their order when they are read; equal plans of different batches share their compiled code. A
#: union of bucketed files says that it is partitioned like them, but Spark 4.1 doesn't run it so: that must be off.
_MERGED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.codegen.useIdInClassName": "false", "spark.sql.unionOutputPartitioning": "false"}


class FingerprintIndex:
    """Runs (fp, low, high) in tiers, hits that wait and verified marks (mark, rec, place), in a folder.

    ``buckets`` is the number of files of a run; it is fixed when the index is made (by default the session's
    shuffle partitions) and is to be chosen for the size the index will have.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str = "bigint", span: int = SPAN, window: int = WINDOW, fanout: int = FANOUT, buckets: int | None = None):
        if not 0 < window < span:
            raise ValueError("window must be shorter than span")
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.versions = Versions(spark, self.root)
        self.number, found = self.versions.latest()
        self.state = found or {"span": span, "window": window, "kind": kind, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "batches": 0, "tiers": [[]], "pending": [], "marks": []}
        self.tables: dict[str, DataFrame] = {}

    # tables

    def _new(self, name: str) -> str:
        return os.path.join(self.root, f"{name}-{uuid.uuid4().hex}")

    def run(self, path: str) -> DataFrame:
        """A run as a bucketed, sorted table."""
        if path not in self.tables:
            name, kind = f"newsloom_{uuid.uuid4().hex}", self.state["kind"]
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, low {kind}, high {kind}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.state['buckets']} BUCKETS LOCATION '{path}'")
            self.tables[path] = self.spark.table(name)
        return self.tables[path]

    def _write_run(self, folded: DataFrame) -> str:
        """Write rows that are hashed by fp into as many partitions as there are buckets: a file a bucket."""
        path, name = self._new("run"), f"newsloom_{uuid.uuid4().hex}"
        folded.write.format("parquet").bucketBy(self.state["buckets"], "fp").sortBy("fp").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.tables[path] = self.spark.table(name)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _settings(self) -> dict[str, str]:
        return _MERGED | {"spark.sql.shuffle.partitions": str(self.state["buckets"]), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

    def runs(self) -> list[str]:
        return [path for tier in self.state["tiers"] for path in tier]

    # adding

    def hits(self, fresh: DataFrame, olds: list[DataFrame]) -> DataFrame:
        """``fp, old``: hashes of a batch's run that two records hold; ``old``: the one record that held it before.

        All runs are bucketed and sorted by fp: every old one is merge-joined without a shuffle or a sort; only what
        matches is shuffled, for the last aggregate.
        """
        kind = self.state["kind"]
        none = F.lit(None).cast(kind)
        met = fresh.where("low <> high").select("fp", "low", "high", none.alias("old_low"), none.alias("old_high"))
        for old in olds:
            before = old.select("fp", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
            met = met.unionByName(fresh.hint("merge").join(before.hint("merge"), "fp").select("fp", "low", "high", "old_low", "old_high"))
        once = met.groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("old_low").alias("old_low"), F.max("old_high").alias("old_high"))
        shared = once.where(F.least("low", "old_low") != F.greatest("high", "old_high"))
        return shared.select("fp", F.when(F.col("old_low") == F.col("old_high"), F.col("old_low")).alias("old"))

    def add(self, documents: DataFrame, key: str = "doc_id", text: str = "text", corpus: DataFrame | None = None) -> None:
        """Add a batch. ``corpus`` holds the texts of all keys added so far, for the verification of full tiers."""
        s = self.state
        paths = {"prints": self._new("prints"), "hits": self._new("hits")}
        batch = F.lit(s["batches"]).alias("batch")
        with settings(self.spark, self._settings()):
            fingerprints(documents, key, text, s["span"], s["window"]).select("rec", "fp", batch).write.option("compression", "zstd").parquet(paths["prints"])
            prints = self._read([paths["prints"]], self._prints())
            fresh = self._write_run(prints.groupBy("fp").agg(F.min("rec").alias("low"), F.max("rec").alias("high")))
            self.hits(self.run(fresh), [self.run(p) for p in self.runs()]).select("fp", "old", batch).write.option("compression", "zstd").parquet(paths["hits"])
        s["batches"] += 1
        s["tiers"][0].append(fresh)
        s["pending"].append(paths)
        gone: list[str] = []
        if len(s["tiers"][0]) >= self.fanout and corpus is not None:
            gone += self._verified(corpus, key, text)
        tier = 0
        while len(s["tiers"][tier]) >= self.fanout:
            runs, s["tiers"][tier] = s["tiers"][tier], []
            if tier + 1 == len(s["tiers"]):
                s["tiers"].append([])
            s["tiers"][tier + 1].append(self._compacted(runs))
            gone += runs
            tier += 1
        self._publish(gone)

    def _prints(self) -> str:
        return f"rec {self.state['kind']}, fp bigint, batch int"

    def _compacted(self, runs: list[str]) -> str:
        rows = self.run(runs[0])
        for more in runs[1:]:
            rows = rows.unionByName(self.run(more))
        with settings(self.spark, self._settings()):
            return self._write_run(rows.groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    def _publish(self, gone: list[str]) -> None:
        """The new version holds before the files it doesn't name are deleted; a reader of the old one fails and retries."""
        self.number = self.versions.publish(self.number, self.state)
        for path in gone:
            self.tables.pop(path, None)
            system, target = file_system(self.spark, path)
            system.delete(target, True)

    # verification

    def verify(self, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Read the texts of the hits that wait and append their marks."""
        self._publish(self._verified(corpus, key, text))

    def _verified(self, corpus: DataFrame, key: str, text: str) -> list[str]:
        s = self.state
        span, window, kind = s["span"], s["window"], s["kind"]
        if not s["pending"]:
            return []

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks, places, sizes = [], [], np.zeros(batch.num_rows, dtype=np.int64)
                for i, (value, shared) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    at, hashes = kept_windows(value, span, window)
                    kept = np.unique(at)
                    good = np.zeros(len(hashes), dtype=bool)
                    good[kept] = np.isin(hashes[kept], np.array(shared, dtype=np.int64).view(np.uint64))
                    starts = np.flatnonzero(good[at])
                    marks.append(_hashes(_prefix(value), span)[starts])
                    places.append(starts.astype(np.int32))
                    sizes[i] = len(starts)
                mark = np.concatenate(marks).view(np.int64) if marks else np.zeros(0, np.int64)
                place = np.concatenate(places) if places else np.zeros(0, np.int32)
                recs = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([recs, pa.array(mark), pa.array(place)], names=["rec", "mark", "place"])

        # a text has at most one hash a character
        prints = self._read([p["prints"] for p in s["pending"]], self._prints())
        hits = self._read([p["hits"] for p in s["pending"]], f"fp bigint, old {kind}, batch int")
        own = prints.join(hits, ["batch", "fp"], "left_semi").select("rec", "fp")
        held = own.unionByName(hits.where("old is not null").select(F.col("old").alias("rec"), "fp")).groupBy("rec").agg(F.collect_set("fp").alias("fps"))
        texts = corpus.where(F.length(text) >= span).select(F.col(key).alias("rec"), F.col(text).alias("body"))
        path = self._new("marks")
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            texts.join(held, "rec").select("rec", "body", "fps").mapInArrow(spans, f"rec {kind}, mark bigint, place int").write.option("compression", "zstd").parquet(path)
        gone, s["pending"] = [path for p in s["pending"] for path in p.values()], []
        s["marks"].append(path)
        return gone

    # reading

    def spans(self, key: str = "doc_id") -> DataFrame:
        """``key, shared_chars`` of all records that share a verified span."""
        span = self.state["span"]
        marks = self._read(self.state["marks"], f"rec {self.state['kind']}, mark bigint, place int")
        twice = marks.groupBy("mark").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).where("low <> high").select("mark")
        found = marks.join(twice, "mark", "left_semi").groupBy("rec").agg(F.array_sort(F.collect_set("place")).alias("places"))
        covered = F.aggregate(
            F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))),
            F.struct(F.element_at("places", 1).alias("last"), F.lit(span).cast("bigint").alias("total")),
            lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(span), x - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )
        return found.select(F.col("rec").alias(key), covered.alias("shared_chars"))


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, batches: int = BATCHES, root: str | None = None) -> DataFrame:
    """``key, shared_chars``: records with a span of ``span`` characters that another one holds.

    The texts are added to a fingerprint index in ``batches`` parts, by a hash of the key. ``root``: the
    index's folder, which is kept; by default one that lasts as long as the application.
    """
    spark = documents.sparkSession
    rows = documents.select(key, text)
    index = FingerprintIndex(spark, root or table_path(spark, "fingerprints"), documents.schema[key].dataType.simpleString(), span, window)
    for part in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == part), key, text, rows)
    index.verify(rows, key, text)
    return index.spans(key)

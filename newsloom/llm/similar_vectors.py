"""The k most similar vectors for every vector (problem 1).

Balanced posting lists in shards. A bounded random sample (``SAMPLE`` vectors) is divided by
k-means, again and again, into regions of about ``REGION`` shards each. A random share of every
region (``SHARE`` of its vectors, at most ``MOST_FITTED``) is divided in the same way, by a task a
region, into shards that expect about ``SHARD`` vectors however unequal the topics are. So the number
of shards grows with the input, and what the driver fits and sends (the regions' centroids and a
neighbour graph over them) does not.

A vector's region is found by a best-first search of the region graph. Vectors are sorted by region and
stream past the centroids of that region's shards and of its ``NEIGHBOURS``', where a neighbour graph is
searched in the same way: a vector is a member of its nearest shard and of those about as near (boundary
replicas), and asks the shards within a distance ratio. A shard divides its members into
posting lists of about ``LIST``, again with boundary replicas and a graph over the centroids; each of its
askers is compared exactly with the lists within a distance ratio, and the best of all shards are
merged by query. A vector travels once a shard, however many lists it asks there. A shard of more
than ``LONGEST`` rows is divided into blocks, and every block of members meets every block of askers in a
group of its own, so no group has more than about 2 * ``LONGEST`` rows.

Every vector is indexed and asked; recall against brute force is tested.

Null, empty, zero and non-finite vectors take no part, nor null ids. Vectors of a length other
than ``dimensions`` (by default that of most of the sample) take no part. A repeated row is one
record. Equal vectors are one class, compared once; ties go to the smaller id. Empty input gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.runtime import drop, materialize

SAMPLE = 50_000
REGION, NEIGHBOURS = 4, 64
SHARD, LIST = 8000, 200
SHARE, MOST_FITTED = 0.1, 65_536
LEAST_LEAF = 16
LONGEST = 65_536
MOST_PARTS = 20_000
PASSES = 2  # the shards are compared in so many turns, each of which ships its part of the vectors
DEGREE, POOL = 16, 48
BEAM, TURNS, EXPAND = 24, 8, 6
FEW = 1024  # up to so many centroids, comparing all takes less time than the search
PIVOT = 4  # one centroid in so many is an entry of the search
SEEN = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 6) -> np.ndarray:
    """The cell of each row, by spherical k-means."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        cell = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        empty = np.bincount(cell, minlength=k) == 0
        if empty.any():
            sums[empty] = x[rng.choice(len(x), int(empty.sum()), replace=False)]
        centres = _unit(sums)
    return np.argmax(x @ centres.T, axis=1)


def balanced_cells(x: np.ndarray, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of cells of at most ``most`` rows, and the centroids of the division's first steps."""
    rng = np.random.default_rng(seed)
    leaves, pivots, todo = [], [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(x[rows].mean(axis=0))
            continue
        k = int(min(16, max(2, -(-len(rows) // most))))
        cell = _kmeans(x[rows], k, rng)
        parts = [rows[cell == c] for c in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # rows that k-means can't tell apart
            parts = np.array_split(rows, 2)
        if len(rows) * 256 > len(x):
            pivots += [x[p].mean(axis=0) for p in parts]
        todo += parts
    return _unit(np.array(leaves, dtype=np.float32)), _unit(np.array(pivots or leaves, dtype=np.float32))


@dataclass
class CentroidGraph:
    """Centroids, their neighbours, and entry points for a best-first search."""

    centroids: np.ndarray
    neighbours: np.ndarray
    pivots: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, pivots: np.ndarray, degree: int = DEGREE) -> CentroidGraph:
        """Neighbours are near and lie in different directions: a candidate that is nearer to a kept one than to the
        centroid comes last, so that a search can leave a dense topic."""
        near = np.tile(np.arange(len(centroids), dtype=np.int32)[:, None], (1, degree))
        pool = min(POOL, len(centroids) - 1)
        for a in range(0, len(centroids) if pool else 0, 512):
            scores = centroids[a : a + 512] @ centroids.T
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -2
            found = np.argpartition(-scores, pool - 1, axis=1)[:, :pool]
            found = np.take_along_axis(found, np.argsort(-np.take_along_axis(scores, found, axis=1), axis=1, kind="stable"), axis=1)
            best = np.take_along_axis(scores, found, axis=1)
            among = np.matmul(centroids[found], centroids[found].transpose(0, 2, 1))
            kept = np.zeros(found.shape, dtype=bool)
            for j in range(pool):
                kept[:, j] = ~((among[:, j] >= best[:, j, None]) & kept).any(axis=1)
            order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
            near[a : a + len(found), : order.shape[1]] = np.take_along_axis(found, order, axis=1)
        entries = np.concatenate([np.argmax(pivots[a : a + 1024] @ centroids.T, axis=1) for a in range(0, len(pivots), 1024)])
        return cls(centroids, near, pivots, entries.astype(np.int32))

    def search(self, queries: np.ndarray, width: int, turns: int = TURNS, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the ``width`` nearest centroids, best first; -1 where there are fewer."""
        n = len(queries)
        if len(self.centroids) <= max(FEW, 4 * width):
            scores = queries @ self.centroids.T
            ids = np.argsort(-scores, axis=1, kind="stable")[:, :width].astype(np.int32)
            return ids, np.take_along_axis(scores, ids, axis=1)
        beam = max(width, BEAM)
        start = min(beam, len(self.pivots))
        coarse = queries @ self.pivots.T
        ids = self.entries[np.argpartition(-coarse, start - 1, axis=1)[:, :start]]
        ids, scores = self._best(queries, ids, None, beam)
        done = np.zeros(ids.shape, dtype=bool)
        for _ in range(turns):
            rank = np.argsort(done | (ids < 0), axis=1, kind="stable")[:, :expand]  # best that aren't expanded
            chosen = np.take_along_axis(ids, rank, axis=1)
            np.put_along_axis(done, rank, True, axis=1)
            expanded = np.where(done, ids, -9)
            more = self.neighbours[np.maximum(chosen, 0)].reshape(n, -1)
            ids, scores = self._best(queries, np.concatenate([ids, more], axis=1), scores, beam)
            done = (ids[:, :, None] == expanded[:, None, :]).any(axis=2)
            if done[:, : 2 * width].all():  # the best ones are expanded and brought nothing nearer
                break
        return ids[:, :width], scores[:, :width]

    def _best(self, queries: np.ndarray, ids: np.ndarray, known: np.ndarray | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        k = 0 if known is None else known.shape[1]
        fresh = np.matmul(self.centroids[np.maximum(ids[:, k:], 0)], queries[:, :, None])[:, :, 0]
        scores = fresh if known is None else np.concatenate([known, fresh], axis=1)
        order = np.argsort(ids, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        scores = np.where(ids < 0, -2, scores)
        scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
        top = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        scores = np.take_along_axis(scores, top, axis=1)
        return np.where(scores > -2, np.take_along_axis(ids, top, axis=1), -1).astype(np.int32), scores


@dataclass(frozen=True)
class Pruning:
    """How many cells, and up to which multiple of the distance of its nearest one, a vector is in and asks."""

    replicas: int
    replica_ratio: float
    probes: int
    probe_ratio: float


SHARDS = Pruning(3, 1.2, 5, 1.35)
LISTS = Pruning(2, 1.15, 16, 1.5)


def postings(graph: CentroidGraph, x: np.ndarray, pruning: Pruning) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, is member) of unit vectors, the nearest list of a row first: lists pruned by the ratio of distances."""
    rows, lists, members = [], [], []
    for a in range(0, len(x), 1024):
        ids, scores = graph.search(x[a : a + 1024], max(pruning.probes, pruning.replicas))
        far = np.sqrt(np.maximum(2 - 2 * scores, 1e-9))
        rank = np.arange(ids.shape[1])
        asks = (ids >= 0) & (far <= pruning.probe_ratio * far[:, :1]) & (rank < pruning.probes)
        holds = (ids >= 0) & (far <= pruning.replica_ratio * far[:, :1]) & (rank < pruning.replicas)
        at, col = np.nonzero(asks | holds)
        rows.append(at + a)
        lists.append(ids[at, col])
        members.append(holds[at, col])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(members)


def best_in_list(x: np.ndarray, member: np.ndarray, k: int, least: float, asker: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, member, cosine) of the ``k`` nearest members of each asker, equal ones included; in blocks."""
    held = np.flatnonzero(member)
    asks = np.arange(len(x)) if asker is None else np.flatnonzero(asker)
    if not len(held) or not len(asks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    y = x[held]
    block = max(16, 4_000_000 // max(len(held), 1))
    for a in range(0, len(asks), block):
        rows = asks[a : a + block]
        scores = x[rows] @ y.T
        own = np.searchsorted(held, rows)
        hit = (own < len(held)) & (held[np.minimum(own, len(held) - 1)] == rows)
        scores[np.flatnonzero(hit), own[hit]] = -2
        good = scores >= np.float32(least - 1e-5)
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
        if len(many):
            good[many] &= scores[many] >= np.partition(scores[many], len(held) - k, axis=1)[:, len(held) - k, None] - np.float32(1e-5)
        i, j = np.nonzero(good)
        out.append((rows[i], held[j]))
    i, j = (np.concatenate(p) for p in zip(*out, strict=True))
    left, right = x[i].astype(np.float64), x[j].astype(np.float64)
    cosine = np.einsum("ij,ij->i", left, right) / np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    good = cosine >= least
    return i[good], j[good], cosine[good]


def best_in_shard(x: np.ndarray, member: np.ndarray, k: int, least: float, asker: np.ndarray, pruning: Pruning = LISTS, most: int = LIST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_in_list, by posting lists of the shard's members"""
    held = np.flatnonzero(member)
    if len(held) <= 2 * most:
        return best_in_list(x, member, k, least, asker)
    centroids, pivots = balanced_cells(x[held], most)
    graph = CentroidGraph.build(centroids, np.concatenate([pivots, centroids[::PIVOT]]))
    row, cell, holds = postings(graph, x, pruning)
    holds &= member[row]
    asks = asker[row]
    useful = holds | asks
    row, cell, holds, asks = row[useful], cell[useful], holds[useful], asks[useful]
    order = np.argsort(cell, kind="stable")
    row, cell, holds, asks = row[order], cell[order], holds[order], asks[order]
    edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    parts = []
    for a, b in zip(edges, edges[1:], strict=False):
        i, j, cosine = best_in_list(x[row[a:b]], holds[a:b], k, least, asks[a:b])
        parts.append((row[a:b][i], row[a:b][j], cosine))
    i, j, cosine = (np.concatenate(p) for p in zip(*parts, strict=True))
    _, once = np.unique(i * np.int64(len(x)) + j, return_index=True)  # a pair may meet in several lists
    i, j, cosine = i[once], j[once], cosine[once]
    order = np.lexsort((-cosine, i))
    i, j, cosine = i[order], j[order], cosine[order]
    first = np.searchsorted(i, i)
    last = np.minimum(first + k - 1, len(i) - 1)
    bar = np.where(i[last] == i, cosine[last], -2.0)
    good = cosine >= bar - 1e-9  # equal ones stay for the order of ids
    return i[good], j[good], cosine[good]


def _packed(raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(raw.shape[1] * 4), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw, dtype=np.float32))]).cast(pa.binary())


def _matrix(raw: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype=np.float32).reshape(-1, size)


class _Seen:
    """What a task has sent; it forgets all beyond a bound."""

    def __init__(self) -> None:
        self.codes: set[int] = set()

    def fresh(self, codes: list[int]) -> list[int]:
        out = []
        for i, code in enumerate(codes):
            if code not in self.codes:
                if len(self.codes) >= SEEN:
                    self.codes.clear()
                self.codes.add(code)
                out.append(i)
        return out


@dataclass
class Regions:
    """The upper level: a graph over the regions' centroids, and for each region those that read its shards."""

    graph: CentroidGraph
    readers: list[np.ndarray]
    near: np.ndarray
    share: float
    leaf: int
    pruning: Pruning

    @classmethod
    def fit(cls, points: np.ndarray, total: int, number: int) -> Regions:
        centroids, pivots = balanced_cells(points, max(min(LEAST_LEAF, len(points)), -(-len(points) // number)))
        near = np.concatenate([np.argsort(-(centroids[a : a + 512] @ centroids.T), axis=1, kind="stable")[:, : NEIGHBOURS + 1] for a in range(0, len(centroids), 512)])
        readers: list[list[int]] = [[] for _ in centroids]
        for region, others in enumerate(near.tolist()):
            for other in {*others, region}:
                readers[other].append(region)
        share = min(SHARE, MOST_FITTED * len(centroids) / total) if total * SHARE > MOST_FITTED else 1.0 if total < SHARD else SHARE
        return cls(CentroidGraph.build(centroids, pivots), [np.array(r, dtype=np.int32) for r in readers], near, share, max(LEAST_LEAF, int(SHARD * share)), SHARDS)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.graph.search(x[a : a + 1024], 1)[0][:, 0] for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int32)


def _place(graph: CentroidGraph, pruning: Pruning, names: np.ndarray, codes: list[int], raw: np.ndarray) -> pa.RecordBatch:
    """``code, raw, shards, members``: the shards of each vector; it is a member of the first ones."""
    row, shards, member = postings(graph, _unit(raw), pruning)
    ends = np.searchsorted(row, np.arange(len(raw) + 1)).astype(np.int32)
    members = np.bincount(row, weights=member, minlength=len(raw)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), _packed(raw), pa.ListArray.from_arrays(pa.array(ends), pa.array(names[shards])), pa.array(members)], names=["code", "raw", "shards", "members"])


def posted(rows: DataFrame, size: int, points: np.ndarray, total: int) -> DataFrame:
    """``code, raw, shards, members`` of each distinct vector of (code, vec): a written table."""
    spark = rows.sparkSession
    number = max(1, min(len(points) // LEAST_LEAF, -(-total // (SHARD * REGION))))
    sent = spark.sparkContext.broadcast(Regions.fit(points, total, number))

    def region_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, seen = sent.value, _Seen()
        for batch in batches:
            codes = batch.column(0).to_numpy()
            if fresh := seen.fresh(codes.tolist()):
                raw = batch.column(1).take(pa.array(fresh)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(regions.of(_unit(raw))), pa.array(np.ones(len(fresh), np.int8)), pa.array(codes[fresh]), _packed(raw)], names=["region", "turn", "code", "raw"])

    def fit(table: pa.Table) -> pa.Table:
        regions = sent.value
        _, once = np.unique(table.column("code").to_numpy(), return_index=True)
        centroids, _ = balanced_cells(_unit(_matrix(table.column("raw"), size)[once]), regions.leaf)
        region = int(table.column("region")[0].as_py())
        return pa.table({"region": pa.array(np.full(len(centroids), region, np.int32)), "shard": (np.int64(region) << 32) + np.arange(len(centroids)), "raw": _packed(centroids)})

    def read_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = sent.value.readers
        for batch in batches:
            to = [readers[r] for r in batch.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(to)), [len(r) for r in to]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to) if to else np.zeros(0, np.int32)), pa.array(np.zeros(len(at), np.int8)), batch.column(1).take(at), batch.column(2).take(at)], names=["region", "turn", "code", "raw"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (region, turn, code): a region's shard centroids come before its vectors."""
        regions, last, graph = sent.value, None, None
        names: list[np.ndarray] = []
        centroids: list[np.ndarray] = []
        region = -1
        for batch in batches:
            at, turn, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (turn[1:] != turn[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at[a] != region:
                    region, names, centroids, graph = int(at[a]), [], [], None
                raw = _matrix(batch.column(3).slice(a, b - a), size)
                if turn[a] == 0:
                    names.append(codes[a:b])
                    centroids.append(raw)
                    continue
                if graph is None:
                    all_names = np.concatenate(names)
                    held = np.concatenate(centroids)
                    graph = CentroidGraph.build(held, np.concatenate([regions.graph.centroids[regions.near[region]], held[::PIVOT]]))
                part = codes[a:b]
                fresh = np.flatnonzero(np.concatenate([[last != part[0]], part[1:] != part[:-1]]))
                last = part[-1]
                if len(fresh):
                    yield _place(graph, regions.pruning, all_names, part[fresh].tolist(), raw[fresh])

    kind = "region int, turn byte, code bigint, raw binary"
    routed = rows.mapInArrow(region_of, kind)
    share = sent.value.share
    drawn = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("code", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
    # a region that the share leaves without a row has no shards of its own; its vectors read its neighbours'
    shards = materialize(drawn.mapInArrow(region_of, kind).groupBy("region").applyInArrow(fit, "region int, shard bigint, raw binary"), "shards", True)
    both = shards.mapInArrow(read_by, kind).unionByName(routed)
    out = materialize(both.repartition("region").sortWithinPartitions("region", "turn", "code").mapInArrow(place, "code bigint, raw binary, shards array<bigint>, members int"), "placed", True)
    drop(shards)
    return out


def similar_vectors(vectors: DataFrame, k: int = 5, least: float = -1.0, key: str = "chunk_id", vector: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """``key, neighbour, cosine, rank``: the ``k`` others of highest cosine, if at least ``least``."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    vec = F.col(vector).cast("array<float>")
    usable = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), vec.alias("vec")).where((usable > 0) & (usable < float("inf")))
    if dimensions is not None:
        rows = rows.where(F.size("vec") == dimensions)
    rows = rows.withColumn("code", F.xxhash64("vec"))

    total = max(1, vectors.count())
    share = min(1.0, SAMPLE / total)
    picked = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("code"), F.lit(1_000_000)) < int(share * 1_000_000))
    # each distinct vector at most once, so that a vector that a third of the rows have counts as one
    sample = picked.select("code", "vec").dropDuplicates(["code"]).toArrow()
    schema = f"`{key}` {kind}, neighbour {kind}, cosine double, rank int"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    lengths = np.diff(sample.column("vec").combine_chunks().offsets.to_numpy())
    size = dimensions or int(np.bincount(lengths).argmax())
    rows = rows.where(F.size("vec") == size)
    _, once = np.unique(sample.column("code").to_numpy(), return_index=True)
    once = once[lengths[once] == size]
    points = _unit(np.stack(sample.column("vec").take(pa.array(once)).to_numpy(zero_copy_only=False)).astype(np.float32))
    placed = posted(rows.select("code", "vec"), size, points, total)

    most = LIST

    def compare(table: pa.Table) -> pa.Table:
        raw = _matrix(table.column("raw"), size)
        codes = table.column("code").to_numpy()
        flags = (table.column(name).to_numpy(zero_copy_only=False) for name in ("member", "asks"))
        i, j, cosine = best_in_shard(_unit(raw), next(flags), k, least, next(flags), LISTS, most)
        return pa.table({"code": codes[i], "other": codes[j], "cosine": cosine})

    # shards that are too long for one group, by their number of blocks; at most one in LONGEST rows
    long = materialize(placed.select(F.explode("shards").alias("shard")).groupBy("shard").count().where(F.col("count") > LONGEST).select("shard", F.ceil(F.col("count") / LONGEST).cast("int").alias("blocks")), "long-shards", True)
    entries = placed.select("code", "raw", "members", F.posexplode("shards").alias("at", "shard")).join(long, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    cells = F.concat(
        F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"))),
        F.transform(others, lambda b: F.struct(F.col("own").alias("i"), b.alias("j"))),
        F.transform(others, lambda b: F.struct(b.alias("i"), F.col("own").alias("j"))),
    )
    entries = entries.select("shard", "code", "raw", "own", (F.col("at") < F.col("members")).alias("holds"), F.explode(cells).alias("cell"))
    entries = entries.select("shard", "cell.i", "cell.j", "code", "raw", (F.col("holds") & (F.col("cell.i") == F.col("own"))).alias("member"), (F.col("cell.j") == F.col("own")).alias("asks"))
    # a partition a group, as far as hashes allow: groups are few and large
    parts = int(min(MOST_PARTS, max(8, 3 * -(-total // SHARD))))
    compared = []
    for turn in range(PASSES):
        part = entries.where(F.pmod(F.xxhash64("shard"), F.lit(PASSES)) == turn).repartition(parts, "shard", "i", "j")
        compared.append(materialize(part.groupBy("shard", "i", "j").applyInArrow(compare, "code bigint, other bigint, cosine double"), "compared", True))
    drop(placed, long)
    pairs = compared[0]
    for more in compared[1:]:
        pairs = pairs.unionByName(more)
    # the same pair has the same cosine in every shard but for rounding
    found = materialize(pairs.groupBy("code", "other").agg(F.max("cosine").alias("cosine")), "found", True)
    drop(*compared)

    named = rows.select("code", "id")
    few = named.withColumn("n", F.dense_rank().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    firsts = materialize(few.groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("firsts")), "firsts", True)
    others = found.join(firsts.withColumnRenamed("code", "other"), "other").select("code", "cosine", F.explode("firsts").alias("neighbour"))
    own = firsts.where((F.size("firsts") > 1) & F.lit(least <= 1.0)).select("code", F.lit(1.0).alias("cosine"), F.explode("firsts").alias("neighbour"))
    best = (
        others.unionByName(own)
        .withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("cosine"), "neighbour")))
        .where(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("best"))
    )
    answers = named.distinct().join(best, "code").select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("id")), 1, k)).alias("at", "hit"))
    return answers.select(F.col("id").alias(key), F.col("hit.neighbour").alias("neighbour"), F.col("hit.cosine").alias("cosine"), (F.col("at") + 1).cast(T.IntegerType()).alias("rank"))


def found_similar(vectors: DataFrame) -> DataFrame:
    """``chunk_a, chunk_b``: one is among the 5 nearest of the other, at a cosine of 0.85 or more."""
    near = similar_vectors(vectors, 5, 0.85)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()

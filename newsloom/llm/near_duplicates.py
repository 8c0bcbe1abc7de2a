"""Near-duplicate records with small edits (problem 4).

Fast similarity sketching: every shingle of a record is thrown into one of ``bins`` bins, round by
round with a fresh hash, and each bin keeps its smallest (round, hash); in the last ``bins`` rounds
round i fills bin i. A record stops as soon as all its bins are filled, so the cost is about
bins * ln(bins) hashes and the share of equal bins has the concentration of as many independent
samples. Bands of ``rows`` bins give keys; records that share a key are candidates. A candidate
pair is dropped if 128 one-bit samples of its sketches agree less often than at the least
similarity by ``SIGMAS`` standard deviations (a chance of 3 in a million to lose a pair); the
Jaccard similarity of every other pair is computed exactly.

Shingles are sets of code points as written. A record with fewer than ``k`` characters has no
shingle and matches nothing; null texts match nothing. Equal texts form one class, told apart by a
64-bit hash: keys and comparisons use one member. ``near_duplicates`` gives the links between classes
and the members of each class, which is linear in the number of copies; ``near_duplicate_pairs`` writes
out all pairs of records from that, however many copies a class has. Members of a band, of a class and of two
linked classes meet in blocks of bounded size (``pairs_within``, ``expand_links``), so that one key that a third
of the records have is work of many tasks. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.runtime import drop, expand_links, materialize, pairs_within

BITS, SIGMAS = 128, 4.5
SEEN = 500_000
KEPT_SHINGLES = 400_000  # that a task keeps between pairs
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Measure:
    """Sets of ``k``-character substrings, linked from ``least`` on; found by bands of ``rows`` bins."""

    kind: str
    k: int
    least: float
    bands: int
    rows: int

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def most_unequal(self) -> int:
        """Bits that may differ between the one-bit samples of a linked pair."""
        agree = (1 + self.least) / 2
        return int(BITS * (1 - agree) + SIGMAS * (BITS * agree * (1 - agree)) ** 0.5)


CHUNK = Measure("chunk", 5, 0.6, 48, 4)
TITLE = Measure("title", 2, 0.75, 44, 7)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each substring of ``k`` characters, and the text it is of. Texts hold ``k`` or more."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        hashes = (hashes + points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:n] == owner[k - 1 :]
    return mix(hashes[inside]), owner[:n][inside]


def sketches(hashes: np.ndarray, owner: np.ndarray, count: int, bins: int) -> np.ndarray:
    """``count`` rows of ``bins`` values; no row is without a hash."""
    out = np.full((count, bins), _FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    for turn in range(2 * bins):
        values = mix(hashes + np.uint64((turn * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF))
        at = (values & np.uint64(0xFFFFFF)).astype(np.int64) * bins >> 24 if turn < bins else np.int64(turn - bins)
        np.minimum.at(flat, owner * bins + at, (values >> np.uint64(12)) | np.uint64(turn << 52))
        open_ = (out == _FULL).any(axis=1)
        if not open_.any():
            break
        keep = open_[owner]
        hashes, owner = hashes[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, measure: Measure, salt: int) -> np.ndarray:
    """``bands`` keys of each sketch."""
    parts = sketch.reshape(len(sketch), measure.bands, measure.rows)
    keys = np.broadcast_to(np.arange(measure.bands, dtype=np.uint64) + np.uint64(salt), parts.shape[:2]).copy()
    for i in range(measure.rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def _bands(records: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """``band, text_class``. A task sends a text that it has seen before only again if it forgot it."""
    salts = {kind: i * 1000 for i, kind in enumerate(sorted(measures))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            by_kind: dict[str, tuple[list[int], list[str]]] = {}
            for kind, text, text_class in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, text_class) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((kind, text_class))
                    classes, texts = by_kind.setdefault(kind, ([], []))
                    classes.append(text_class)
                    texts.append(text)
            for kind, (classes, texts) in by_kind.items():
                measure = measures[kind]
                start = 0
                while start < len(texts):  # about 200,000 characters at a time
                    stop, size = start, 0
                    while stop < len(texts) and (size == 0 or size + len(texts[stop]) < 200_000):
                        size += len(texts[stop])
                        stop += 1
                    keys = band_keys(sketches(*shingle_hashes(texts[start:stop], measure.k), stop - start, measure.bins), measure, salts[kind])
                    owners = np.repeat(np.array(classes[start:stop], dtype=np.int64), measure.bands)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(owners)], names=["band", "text_class"])
                    start = stop

    return records.select("rec_kind", "text", "text_class").mapInArrow(run, "band bigint, text_class bigint")


def _signed(texts: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """The rows of ``texts`` and 128 one-bit samples of their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist())
            all_texts = batch.column(2).to_pylist()
            signs = np.zeros((batch.num_rows, 2), dtype=np.int64)
            for kind in np.unique(kinds):
                measure = measures[str(kind)]
                at = np.flatnonzero(kinds == kind)
                for part in np.array_split(at, max(1, sum(len(all_texts[i]) for i in at) // 200_000)):
                    if len(part):
                        sketch = sketches(*shingle_hashes([all_texts[i] for i in part], measure.k), len(part), measure.bins)
                        bits = (mix(sketch[:, :BITS]) & np.uint64(1)).astype(np.uint8)
                        signs[part] = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())], names=["text_class", "rec_kind", "text", "high", "low"])

    return texts.select("text_class", "rec_kind", "text").mapInArrow(run, "text_class bigint, rec_kind string, text string, high bigint, low bigint")


def _verify(pairs: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """Pairs (rec_kind, a, b, text_a, text_b) whose shingle sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[tuple[str, int], frozenset[str]] = OrderedDict()
        held = 0

        def shingles(kind: str, text_class: int, text: str) -> frozenset[str]:
            nonlocal held
            found = known.get((kind, text_class))
            if found is None:
                k = measures[kind].k
                found = known[kind, text_class] = frozenset(text[i : i + k] for i in range(len(text) - k + 1))
                held += len(found)
                while held > KEPT_SHINGLES and len(known) > 2:
                    held -= len(known.popitem(last=False)[1])
            return found

        for batch in batches:
            keep = []
            for kind, a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, other = shingles(kind, a, text_a), shingles(kind, b, text_b)
                both = len(one & other)
                keep.append(both >= measures[kind].least * (len(one) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])

    return pairs.select("rec_kind", "a", "b", "text_a", "text_b").mapInArrow(run, "rec_kind string, a bigint, b bigint")


def near_duplicates(records: DataFrame, measures: list[Measure]) -> tuple[DataFrame, DataFrame]:
    """Links ``rec_kind, a, b`` between classes of equal texts, and members ``rec_kind, text_class, rec_id``.

    ``records``: rec_kind, rec_id, text. All records of the measures' kinds with a shingle are members.
    """
    by_kind = {m.kind: m for m in measures}
    enough = F.lit(False)
    for m in measures:
        enough = enough | ((F.col("rec_kind") == m.kind) & (F.length("text") >= m.k))
    rows = records.where(F.col("rec_id").isNotNull() & F.col("text").isNotNull() & enough).select("rec_kind", "rec_id", "text", F.xxhash64("rec_kind", "text").alias("text_class"))

    by_class = Window.partitionBy("band").orderBy("text_class")
    neighbours = _bands(rows, by_kind).withColumns({"before": F.lag("text_class").over(by_class), "after": F.lead("text_class").over(by_class)})
    kept = materialize(neighbours.where("before <> text_class or after <> text_class").select("band", "text_class").distinct(), "kept-bands", True)
    asked = kept.select("text_class").distinct()
    texts = materialize(_signed(rows.select("rec_kind", "text_class", "text").join(asked, "text_class", "left_semi").dropDuplicates(["text_class"]), by_kind), "texts", True)
    signed = materialize(kept.join(texts.select("text_class", "rec_kind", "high", "low"), "text_class"), "signed", True)
    drop(kept)
    most = F.lit(0)
    for m in measures:
        most = F.when(F.col("rec_kind") == m.kind, m.most_unequal).otherwise(most)
    unequal = F.bit_count(F.col("a_high").bitwiseXOR(F.col("b_high"))) + F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low")))
    near = pairs_within(signed, ["rec_kind", "band"], ["text_class", "high", "low"], unequal <= most)
    candidates = materialize(near.select(F.least("a_text_class", "b_text_class").alias("a"), F.greatest("a_text_class", "b_text_class").alias("b")).distinct(), "candidates", True)
    left = texts.select("rec_kind", F.col("text_class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("text_class").alias("b"), F.col("text").alias("text_b"))
    linked = materialize(_verify(candidates.join(right, "b").join(left, "a"), by_kind), "linked", True)
    drop(signed, texts, candidates)
    return linked, materialize(rows.select("rec_kind", "text_class", "rec_id").distinct(), "members", True)


def near_duplicate_pairs(records: DataFrame, measures: list[Measure]) -> DataFrame:
    """``rec_kind, id_a, id_b`` of all records (rec_kind, rec_id, text) that are nearly the same, copies included."""
    linked, members = near_duplicates(records, measures)
    several = members.groupBy("rec_kind", "text_class").agg(F.count("*").alias("n")).where("n > 1").select("rec_kind", "text_class")
    copies = materialize(members.join(several, ["rec_kind", "text_class"], "left_semi"), "copies", True)
    own = pairs_within(copies, ["rec_kind", "text_class"], ["rec_id"], F.lit(True)).select("rec_kind", F.col("a_rec_id").alias("x"), F.col("b_rec_id").alias("y"))
    ends = linked.select("rec_kind", F.col("a").alias("text_class")).unionByName(linked.select("rec_kind", F.col("b").alias("text_class"))).distinct()
    groups = materialize(members.join(ends, ["rec_kind", "text_class"], "left_semi").select("rec_kind", F.col("text_class").alias("group"), F.col("rec_id").alias("id")), "groups", True)
    across = expand_links(linked, groups, ["rec_kind"]).where("x <> y")
    return across.unionByName(own).select("rec_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_classes(records: DataFrame, measures: list[Measure]) -> DataFrame:
    """``rec_kind, rec_id, class_id, links``: a row a record; the smallest id with its text, and the number of other texts that are nearly the same."""
    linked, members = near_duplicates(records, measures)
    ends = linked.select("rec_kind", F.col("a").alias("text_class")).unionByName(linked.select("rec_kind", F.col("b").alias("text_class")))
    classes = members.groupBy("rec_kind", "text_class").agg(F.min("rec_id").alias("class_id")).join(ends.groupBy("rec_kind", "text_class").agg(F.count("*").alias("links")), ["rec_kind", "text_class"], "left")
    return members.join(classes, ["rec_kind", "text_class"]).select("rec_kind", "rec_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text")).unionByName(
        documents.select(F.lit("title").alias("rec_kind"), F.col("doc_id").cast("string").alias("rec_id"), F.col("title").alias("text"))
    )


def found_near_duplicates(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk contents by 5-character and titles by 2-character substrings."""
    return near_duplicate_pairs(_records(chunks, documents), [CHUNK, TITLE])


def classes_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """As found_near_duplicates, a row a record."""
    return near_duplicate_classes(_records(chunks, documents), [CHUNK, TITLE])

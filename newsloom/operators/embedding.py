"""Feature-hash embeddings: signed counts of words and word pairs, scaled to length 1."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a CJK character or an ASCII word.
FEATURE = r"[㐀-鿿]|[A-Za-z0-9_]+"
DIMENSIONS = 384


def unigrams(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(FEATURE), F.lit(0)), lambda t: F.lower(t))


def features(text: Column) -> Column:
    """Lower-case words, then the pairs of neighbours; repeats count."""
    one = unigrams(text)
    n = F.size(one)
    pairs = F.when(n > 1, F.zip_with(F.slice(one, F.lit(1), n - 1), F.slice(one, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("::"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, pairs)


def sha_place(feature: str, dimensions: int) -> tuple[int, int]:
    """Place and sign of a feature from the hex digits of its SHA-256."""
    digest = hashlib.sha256(feature.encode()).hexdigest()
    return int(digest[:15], 16) % dimensions, 1 if int(digest[15], 16) % 2 else -1


def blake_place(feature: str, dimensions: int) -> tuple[int, int]:
    raw = hashlib.blake2b(feature.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big") % dimensions, 1 if raw[8] % 2 else -1


SCHEMES = {"sha256": sha_place, "blake2b": blake_place}
_FEATURE = re.compile(FEATURE)
MOST_KNOWN = 400_000  # features that a task remembers


class Folder:
    """Signed feature counts of texts, one text at a time; places of features that were met are remembered."""

    def __init__(self, dimensions: int, scheme: str):
        if scheme not in SCHEMES:
            raise ValueError("scheme must be sha256 or blake2b")
        self.dimensions, self.place = dimensions, SCHEMES[scheme]
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.pairs: dict[int, tuple[int, int]] = {}
        self.single: list[tuple[int, int]] = []

    def _number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.words)
            self.words.append(word)
            self.single.append(self.place(word, self.dimensions))
        return found

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """A row of signed counts a text."""
        if len(self.words) > MOST_KNOWN or len(self.pairs) > MOST_KNOWN:
            self.numbers, self.words, self.pairs, self.single = {}, [], {}, []
        number, lists = self._number, []
        for text in texts:
            lists.append([number(w) for w in ("\n".join(_FEATURE.findall(text)).lower().split("\n") if text else ()) if w])
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        words = np.fromiter((w for one in lists for w in one), dtype=np.int64, count=int(sizes.sum()))
        rows = np.repeat(np.arange(len(lists)), sizes)
        out = np.zeros(len(lists) * self.dimensions)
        if len(words):
            single = np.array(self.single, dtype=np.int64)
            out += np.bincount(rows * self.dimensions + single[words, 0], weights=single[words, 1], minlength=len(out))
            beside = np.flatnonzero(rows[1:] == rows[:-1])
            codes, back = np.unique((words[beside] << 32) | words[beside + 1], return_inverse=True)
            known = np.array([self._pair(c) for c in codes.tolist()], dtype=np.int64).reshape(-1, 2)
            out += np.bincount(rows[beside] * self.dimensions + known[back, 0], weights=known[back, 1], minlength=len(out))
        return out.reshape(len(lists), self.dimensions)

    def _pair(self, code: int) -> tuple[int, int]:
        found = self.pairs.get(code)
        if found is None:
            found = self.pairs[code] = self.place(f"{self.words[code >> 32]}::{self.words[code & 0xFFFFFFFF]}", self.dimensions)
        return found


def _embedded(batches: Iterator[pa.RecordBatch], dimensions: int, scheme: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their unit vectors, a few hundred texts at a time."""
    folder = Folder(dimensions, scheme)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            totals = folder.totals(part.column(1).to_pylist())
            length = np.sqrt(np.einsum("ij,ij->i", totals, totals))[:, None]
            yield part, totals / np.where(length == 0, 1, length)


def hash_embed_sparse(texts: DataFrame, dimensions: int = DIMENSIONS, scheme: str = "sha256", key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, place, value``: non-zero places of unit vectors; texts without features have none. All features of a text are in its row: no shuffle."""
    if scheme not in SCHEMES:
        raise ValueError("scheme must be sha256 or blake2b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, unit in _embedded(batches, dimensions, scheme):
            row, place = np.nonzero(unit)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(unit[row, place])], names=[key, "place", "value"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, place int, value double")


def hash_embed(texts: DataFrame, dimensions: int = DIMENSIONS, scheme: str = "sha256", key: str = "chunk_id", text: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, carry..., embedding array<double>`` of every row; a text without features, or null, has the zero vector."""
    if scheme not in SCHEMES:
        raise ValueError("scheme must be sha256 or blake2b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, unit in _embedded(batches, dimensions, scheme):
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dimensions)
            kept = [rows.column(0), *rows.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1)))], names=[key, *carry, "embedding"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return texts.select(key, text, *carry).mapInArrow(run, f"{kinds}, embedding array<double>")

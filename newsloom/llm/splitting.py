"""Cutting oversized items at natural boundaries (problem 3).

Content-defined chunking over reference tokens (a CJK character, an ASCII word, or one other
character that isn't white space). A rolling hash of the last ``ROLL`` tokens marks landmarks. From
a piece's first new token on, the first landmark between the smallest and the largest size is
taken, or else the smallest hash there, and is moved to the nearest sentence or line end between
the two sizes. An edit therefore moves cuts only until the next landmark both versions have. If
there is no end in that range, an earlier one is taken, as long as the piece keeps more tokens
than the overlap; only if there is none either, the cut is hard, at the landmark. Every piece but
the first repeats the last ``overlap`` tokens before it, within the limit.

Items within the limit are one piece. Null, empty and blank texts have no pieces. A repeated row is
cut once (``distinct`` on kind, id and text). Texts of any length are cut in one pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip, token_count

LIMIT = 512
OVERLAP = 64
SMALLEST = 224
ROLL = 8
MARKS = 8
LANDMARK = 96  # one token in so many is a landmark
_TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")
_ENDS = frozenset("。！？!?；;")
_CLOSING = frozenset("”’」』）)》】\"'")


@dataclass
class Piece:
    first: int  # tokens, with the overlap
    fresh: int  # first token that isn't repeated
    stop: int
    cut: str  # natural, hard or end


class TokenSpans:
    """Places of a text's tokens, its natural boundaries and the length of its longest sentence."""

    def __init__(self, text: str):
        spans, tokens = [], []
        for found in _TOKEN.finditer(text):
            spans.append(found.span())
            tokens.append(found[0])
        self.text, self.tokens, n = text, tokens, len(tokens)
        self.spans = np.array(spans, dtype=np.int64).reshape(n, 2)
        ends = np.fromiter((t in _ENDS for t in tokens), dtype=bool, count=n)
        lines = np.zeros(n, dtype=bool)  # a line end follows the token
        at = np.fromiter((m.start() for m in re.finditer("\n", text)), dtype=np.int64)
        before = np.searchsorted(self.spans[:, 0], at) - 1
        lines[before[before >= 0]] = True
        inner = np.flatnonzero(ends)
        edges = np.unique(np.concatenate([[0], inner, inner + 1, np.flatnonzero(lines) + 1, [n]]))
        lengths = np.diff(edges)
        single = ends[edges[:-1]] if n else np.zeros(0, dtype=bool)
        self.longest_sentence = int(lengths[~single].max(initial=0))
        natural = lines.copy()
        closing = np.fromiter((t in _CLOSING for t in tokens), dtype=bool, count=n)
        done = -1
        for i in inner.tolist():  # end marks and closing quotes that follow stay with the sentence, up to MARKS of them
            if i > done:
                done = i
                while done + 1 < min(n, i + MARKS) and (ends[done + 1] or closing[done + 1]):
                    done += 1
                natural[done] = True
        self.natural = np.flatnonzero(natural) + 1  # a piece may stop before these tokens

    def rolling(self) -> np.ndarray:
        """A hash of the ``ROLL`` tokens before each place."""
        values = np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) for t in self.tokens), dtype=np.uint64, count=len(self.tokens))
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        for k in range(min(ROLL, len(values))):
            out[k + 1 :] += values[: len(values) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def cut_pieces(item: TokenSpans, limit: int = LIMIT, overlap: int = OVERLAP, smallest: int = SMALLEST) -> list[Piece]:
    n = len(item.tokens)
    if n <= limit:
        return [Piece(0, 0, n, "end")] if n else []
    rolling = item.rolling()
    landmark = rolling % np.uint64(LANDMARK) == 0
    pieces, fresh = [], 0
    while True:
        first = max(0, fresh - overlap)
        top = first + limit
        if top >= n:
            pieces.append(Piece(first, fresh, n, "end"))
            return pieces
        low = min(fresh + smallest, top)
        marks = np.flatnonzero(landmark[low : top + 1])
        mark = low + int(marks[0] if len(marks) else np.argmin(rolling[low : top + 1]))
        a, b = np.searchsorted(item.natural, [low, top + 1])
        if a < b:
            near = item.natural[a:b]
            stop, kind = int(near[np.argmin(np.abs(near - mark))]), "natural"
        elif a and item.natural[a - 1] > fresh + (0 if pieces else overlap):
            stop, kind = int(item.natural[a - 1]), "natural"
        else:
            stop, kind = mark, "hard"
        pieces.append(Piece(first, fresh, stop, kind))
        fresh = stop


def _items(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    return (
        pages.select(F.lit("page").alias("rec_kind"), F.col("page_id").cast("string").alias("rec_id"), "text")
        .unionByName(chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text")))
        .where("rec_id is not null and text is not null")
    )


def _cut(items: DataFrame, limit: int, overlap: int, smallest: int, contents: bool) -> DataFrame:
    if not 0 <= overlap < limit or not overlap < smallest <= limit - overlap:
        raise ValueError("0 <= overlap < smallest <= limit - overlap must hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                item = TokenSpans(text)
                for k, piece in enumerate(cut_pieces(item, limit, overlap, smallest)):
                    at.append(i)
                    content = text[item.spans[piece.first, 0] : item.spans[piece.stop - 1, 1]] if contents else None
                    rows.append((k, piece.stop - piece.first, piece.fresh - piece.first, piece.cut, content, len(item.tokens), item.longest_sentence))
            keys = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=NAMES)

    return items.select("rec_kind", "rec_id", "text").mapInArrow(run, "rec_kind string, rec_id string, chunk_index int, n_tokens int, repeated int, cut string, content string, item_tokens int, longest_sentence int")


NAMES = ["rec_kind", "rec_id", "chunk_index", "n_tokens", "repeated", "cut", "content", "item_tokens", "longest_sentence"]


def split_items(pages: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, smallest: int = SMALLEST) -> DataFrame:
    """Numbered pieces of every item. Texts of no more characters than ``limit`` stay on the JVM."""
    items = _items(pages, chunks).distinct()
    short = (
        items.where(F.length("text") <= limit)
        .select("rec_kind", "rec_id", F.lit(0).alias("chunk_index"), token_count(F.col("text")).alias("n_tokens"), F.lit(0).alias("repeated"), F.lit("end").alias("cut"), strip(F.col("text")).alias("content"))
        .where("n_tokens > 0")
    )
    return _cut(items.where(F.length("text") > limit), limit, overlap, smallest, True).select(NAMES[:7]).unionByName(short)


def oversized(pages: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, smallest: int = SMALLEST) -> DataFrame:
    """``rec_kind, rec_id, hard_cut`` of items that the cutting divides.

    A text of no more characters than ``limit`` has no more tokens either, and isn't read again.
    """
    pieces = _cut(_items(pages, chunks).where(F.length("text") > limit), limit, overlap, smallest, False)
    return pieces.where("chunk_index = 1").select("rec_kind", "rec_id", (F.col("longest_sentence") > limit).cast("int").alias("hard_cut")).distinct()

"""Encoding with a public byte-level BPE vocabulary (problem 7).

The merges are compiled into a finite-state transducer over characters that is determinised
while it runs. A state is the text read but not yet emitted; a transition on one character emits
the tokens of the part that no later character can change. A boundary between two characters is
settled when no vocabulary entry can lie across it, given the characters on both sides: then no
merge crosses it, and both sides can be encoded apart. Chinese text settles after a character or
two, so the lookahead is bounded by the vocabulary. ASCII words settle at their end only, as any two
letters stand in some entry; the ids of a pretoken of ASCII characters are remembered once it has
gone through the states, so that a frequent word takes one step. A pretoken that
stays unsettled for more than ``LOOKAHEAD`` bytes (long runs of one letter) is merged directly
with a heap, with the same result. The vocabulary is read by the driver and sent once.

Null, empty: an empty list of ids. Blank text is text and has ids. Strings that look like special
tokens are ordinary text. Lone surrogates cannot stand in a Spark string.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pretokenizer pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKAHEAD = 128
MAX_STATES = 400_000
MAX_WORDS = 200_000


class _Long(Exception):
    pass


class _State(dict):
    """Transitions by character; ``pending`` is the unsettled text as UTF-8."""

    __slots__ = ("final", "pending")

    def __init__(self, pending: bytes):
        super().__init__()
        self.pending = pending
        self.final: tuple[int, ...] | None = None


def parse_vocabulary(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return parse_vocabulary(file.read())


class MergeTransducer:
    """Byte-level BPE as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        across: dict[int, list[tuple[bytes, bytes]]] = {}
        for token in ranks:
            for cut in range(1, len(token)):
                if token[cut] & 0xC0 != 0x80:  # only cuts before a character
                    across.setdefault(token[cut], []).append((token[:cut], token[cut:]))
        self.across = across
        self.lefts: dict[str, frozenset[bytes]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = _State(b"")
        self.start.final = ()
        self.states: dict[bytes, _State] = {b"": self.start}

    def _state(self, pending: bytes) -> _State:
        found = self.states.get(pending)
        if found is None:
            found = self.states[pending] = _State(pending)
        return found

    def _unsettled(self, pending: bytes, char: str, encoded: bytes) -> bool:
        """May some entry hold the end of ``pending`` and the start of ``char``?"""
        lefts = self.lefts.get(char)
        if lefts is None:
            lefts = self.lefts[char] = frozenset(left for left, right in self.across.get(encoded[0], ()) if right.startswith(encoded) or encoded.startswith(right))
        return bool(lefts) and any(pending[-n:] in lefts for n in range(1, min(len(pending), self.longest) + 1))

    def _expand(self, state: _State, char: str) -> tuple[tuple[int, ...], _State]:
        encoded = char.encode("utf-8", "replace")
        if state.pending and self._unsettled(state.pending, char, encoded):
            if len(state.pending) > LOOKAHEAD:
                raise _Long
            step = ((), self._state(state.pending + encoded))
        else:
            step = (self._final(state), self._state(encoded))
        state[char] = step
        return step

    def _final(self, state: _State) -> tuple[int, ...]:
        if state.final is None:
            state.final = tuple((self.merge_short if len(state.pending) <= 32 else self.merge)(state.pending))
        return state.final

    def merge(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first among equals, by a heap over a linked list."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            middle = end[i]
            if middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_short(self, piece: bytes) -> list[int]:
        """As merge, by a list of pair ranks: faster for a few bytes."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        never = len(ranks) + 1 << 1
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) < never:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
        return [ranks[part] for part in parts]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words, start = self.words, self.start
        for piece in self.pieces.findall(text):
            known = words.get(piece)
            if known is not None:
                out += known
                continue
            state, at = start, len(out)
            try:
                for char in piece:
                    step = state.get(char)
                    if step is None:
                        step = self._expand(state, char)
                    emitted, state = step
                    if emitted:
                        out += emitted
                out += state.final if state.final is not None else self._final(state)
            except _Long:
                del out[at:]
                out += self.merge(piece.encode("utf-8", "replace"))
            if len(piece) <= 32 and piece.isascii():
                if len(words) >= MAX_WORDS:
                    words.clear()
                words[piece] = tuple(out[at:])
            if len(self.states) > MAX_STATES:
                self._reset()
                start = self.start
        return out


class IncrementalDecoder:
    """Ids to text, chunk by chunk; a character cut by a chunk's end waits for its other bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.entries = {rank: token for token, rank in ranks.items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        text = self.utf8.decode(b"".join(self.entries[i] for i in ids), last)
        if last:
            self.utf8.reset()
        return text


@lru_cache(maxsize=2)
def transducer(raw: bytes) -> MergeTransducer:
    """One per Python worker and vocabulary."""
    return MergeTransducer(parse_vocabulary(raw))


@lru_cache(maxsize=2)
def decoder(raw: bytes) -> IncrementalDecoder:
    return IncrementalDecoder(parse_vocabulary(raw))


def _sent(rows: DataFrame, vocabulary: str) -> Broadcast[bytes]:
    """The vocabulary file, read by the driver; its size is that of a published vocabulary, a few MB."""
    with open(vocabulary, "rb") as file:
        return rows.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>``: one row per input row. Other columns are not read."""
    sent = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(sent.value).encode
        for batch in batches:
            flat: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, value in enumerate(batch.column(1).to_pylist()):
                flat += encode(value)
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens int``: as encode_documents, without keeping the ids."""
    sent = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(sent.value).encode
        for batch in batches:
            sizes = np.fromiter((len(encode(value)) for value in batch.column(1).to_pylist()), dtype=np.int32, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode_ids(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id") -> DataFrame:
    """``key, text string``: the text of each list of ids; null ids give null."""
    sent = _sent(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(sent.value).feed
        for batch in batches:
            texts = [None if ids is None else decode(ids, True) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")

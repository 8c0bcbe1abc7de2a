"""Filling containers of fixed capacity (problem 8) by best-two-fit.

Items are spread by a hash of their key over shards of about ``shard_items`` items. Each shard is
packed by one task from the counts of its sizes: a container is filled greedily with the largest
item that fits, then its smallest item is replaced by the two unpacked items that fill the gap
and the freed room best, for as long as such a pair leaves less room. The number of shards grows
with the input and a shard's size doesn't, so no task sees an unbounded group; a shard ends with
one or two containers that are not full, which is all that sharding costs.

Sizes of 0 and null sizes are not placed. An item larger than a container is cut into full
containers and a rest, which is placed like an item; other items are never cut. Repeated keys are
items of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from newsloom.runtime import materialize

CAPACITY = 2048
SHARD_ITEMS = 20_000


def fill_containers(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; sizes are 1 .. capacity."""
    order = np.argsort(-sizes, kind="stable")
    counts = np.bincount(sizes, minlength=capacity + 1)
    size_axis = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(counts > 0, size_axis, 0))  # largest size left, at most x
    left = counts.tolist()
    plans: list[list[int]] = []

    def take(size: int) -> None:
        left[size] -= 1
        counts[size] -= 1
        if not left[size]:
            smaller = int(below[size - 1])
            stop = size + 1
            while stop <= capacity and below[stop] == size:
                stop += 1 if stop + 64 > capacity or below[stop + 63] != size else 64
            below[size:stop] = smaller

    def put_back(size: int) -> None:
        left[size] += 1
        counts[size] += 1
        if left[size] == 1:
            stop = size + int(np.searchsorted(below[size:], size, side="left"))
            below[size:stop] = size

    while (largest := int(below[capacity])) > 0:
        plan, room = [], capacity
        while room and (size := int(below[room])):
            take(size)
            plan.append(size)
            room -= size
        while room and len(plan) > 0:
            smallest = plan[-1]
            gap = room + smallest
            firsts = size_axis[1:gap][counts[1:gap] > 0]
            if not len(firsts):
                break
            seconds = below[gap - firsts]
            same = (seconds == firsts) & (counts[firsts] < 2)
            if same.any():
                seconds = np.where(same, below[np.minimum(gap - firsts, firsts - 1)], seconds)
            sums = np.where(seconds > 0, firsts + seconds, 0)
            at = int(np.argmax(sums))
            if sums[at] <= smallest:
                break
            a, b = int(firsts[at]), int(seconds[at])
            plan.pop()
            take(a)
            take(b)
            put_back(smallest)
            plan += sorted((a, b), reverse=True)
            plan.sort(reverse=True)
            room = gap - a - b
        plans.append(plan)

    queues: dict[int, Iterator[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(capacity - sizes[order], minlength=capacity + 1))])
    for number, plan in enumerate(plans):
        for size in plan:
            queue = queues.get(size)
            if queue is None:
                queue = queues[size] = iter(order[starts[capacity - size] : starts[capacity - size + 1]].tolist())
            out[next(queue)] = number
    return out


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``key, part int, start int, n_tokens int, container bigint``.

    ``part`` counts the pieces of a cut item and ``start`` is a piece's first unit in it.
    """
    if capacity < 1 or shard_items < 1:
        raise ValueError("capacity and shard_items must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    pieces = (
        items.select(F.col(key).alias("item"), F.col(size).cast("int").alias("units"))
        .where("units > 0")
        .select("item", "units", F.explode(F.sequence(F.lit(0), F.floor((F.col("units") - 1) / capacity).cast("int"))).alias("part"))
        .select("item", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("units") - F.col("part") * capacity).alias("n_tokens"))
    )
    pieces = materialize(pieces, "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_items))
    names = [key, "part", "start", "n_tokens", "container"]

    def one(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "item", "part"], kind="stable", ignore_index=True)
        rows["container"] = fill_containers(rows["n_tokens"].to_numpy(np.int64), capacity) + (int(shard[0]) << 32)
        return rows[["item", "part", "start", "n_tokens", "container"]].set_axis(names, axis=1)

    return pieces.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards))).groupBy("shard").applyInPandas(one, f"`{key}` {kind}, part int, start int, n_tokens int, container bigint")


def pack_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of ``capacity`` tokens holding every non-empty text."""
    return pack(count_tokens(documents.where("length(text) > 0"), vocabulary), capacity=capacity, shard_items=shard_items)

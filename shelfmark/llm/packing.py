"""Filling fixed-capacity containers: sum-of-squares online packing.

Every item goes to the fill level that makes the sum of squared counts of partially filled containers smallest: levels
held by many containers are drained, rare ones are built up, so that no level piles up. The counts lie in one array
over the levels and all levels are weighed at once. Items are dealt to groups of bounded size by a hash of their key;
each group is packed in one task, and what its containers leave open is at most a few containers per GROUP_ITEMS items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import collect_small, cut_counting

#: Items in a group, about; kinds of containers there may be (more is an error); tasks that pack, at most.
GROUP_ITEMS, KINDS, TASKS = 20_000, 1000, 10_000


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The container number (from 0) of every item; each size is 1 to ``capacity``. Ties go to the fullest level."""
    count = np.zeros(capacity + 1, np.int64)
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, out = 0, []
    for s in sizes:
        level, best = 0, (int(count[s]) + 0.5 if s < capacity else 0.0)
        if s < capacity:
            head = count[1 : capacity - s + 1]
            change = (count[s + 1 :] + 1 - head).astype(np.float64)
            change[-1] = 0.5 - head[-1]  # filled to the brim: a full container is no partial one
            change[head == 0] = np.inf
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        if level:
            container = holders[level].pop()
            count[level] -= 1
        else:
            container, made = made, made + 1
        out.append(container)
        if level + s < capacity:
            count[level + s] += 1
            holders[level + s].append(container)
    return out


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(container_kind, container_id, key, piece_no, tokens) of every item for every kind of container.

    An item up to the capacity is one piece, 0; a larger one is cut into full containers and one rest, numbered on. Items
    of size 0 or null take no room: piece 0, 0 tokens, no container (null). container_id is unique within a kind. Kinds
    with a null or non-positive capacity are left out, repeated kinds count once (their largest capacity). Repeated items
    are packed each. The outcome depends on keys and sizes only, not on how the rows were spread.
    """
    kind = items.schema[key].dataType.simpleString()
    kinds = {r[0]: r[1] for r in collect_small(containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens")), KINDS)}
    items, seen = cut_counting(items.select(key, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("tokens")), n=F.count(F.lit(1)))  # counted while written
    groups = max(1, math.ceil(seen["n"] / GROUP_ITEMS))
    spread = items.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).withColumn("_k", F.explode(F.array(*(F.lit(k) for k in sorted(kinds)))) if kinds else F.lit(None).cast("string"))
    if not kinds:
        spread = spread.where("false")
    schema = f"container_kind string, container_id bigint, `{key}` {kind}, piece_no int, tokens bigint"
    names = ["container_kind", "container_id", key, "piece_no", "tokens"]

    def fill(group: int, name: str, keys: pa.Array, tokens: np.ndarray) -> pa.RecordBatch:
        capacity = kinds[name]
        full, rest = np.divmod(tokens, capacity)
        pieces = full + (rest > 0) + (tokens == 0)
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        took = np.where(piece < full[row], capacity, rest[row])
        number = np.full(len(row), -1, np.int64)
        part = np.flatnonzero((took > 0) & (took < capacity))
        number[part] = sum_of_squares(took[part].tolist(), capacity)
        whole = np.flatnonzero(took == capacity)
        number[whole] = number.max(initial=-1) + 1 + np.arange(len(whole))
        ids = pa.array(np.where(number < 0, 0, number) + (group << 36), pa.int64(), mask=number < 0)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(row)), ids, keys.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(took)], names)

    def run(batches):
        now, parts = None, []
        for b in batches:
            group, name = np.array(b.column(0)), b.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1] or group[i] != group[i - 1]), len(name)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if now not in (None, (int(group[x]), name[x])):
                    yield fill(*now, pa.concat_arrays([p for p, _ in parts]), np.concatenate([t for _, t in parts]))
                    parts = []
                now = (int(group[x]), name[x])
                parts.append((b.column(2).slice(x, y - x), np.array(b.column(3).slice(x, y - x))))
        if parts:
            yield fill(*now, pa.concat_arrays([p for p, _ in parts]), np.concatenate([t for _, t in parts]))

    # an item order that is the same on every run: by a hash of the key
    # packing is all work and little data: a task per group and kind, which adaptive execution would merge by their bytes
    placed = spread.repartition(max(1, min(TASKS, groups * len(kinds))), "_g", "_k").sortWithinPartitions("_g", "_k", F.xxhash64(key), key, "tokens")
    return placed.select("_g", "_k", key, "tokens").mapInArrow(run, schema)

"""Filling containers of fixed capacity with items, never cutting an item unless it alone exceeds the capacity.

Method: large-item matching. Items above a third of the capacity fit at most twice into a container: each is matched,
from the largest on, with the largest remaining one that fits beside it. Smaller items then go, from the largest on, to
the container whose gap they fill best; a new one is opened where none has room. An item above the capacity fills whole
containers, and its rest is an item like any other.

Items are packed in shards: hashed by key into as many groups as keep a group at about ``shard_rows`` items, whatever
the size of the table, and each group is packed by one task. Only keys and sizes are shuffled, never texts. A shard's
loss against packing all at once is a few containers at its end, that is of the order of ten in ``shard_rows`` items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """For each item its parts as (container, start, length), containers counting from 0.

    Sizes below 0 count as 0; an item of size 0 lies in the container it would fit best. Ties go by the items' order.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    parts: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    bins = 0
    items: list[tuple[int, int, int]] = []  # (size, item, start)
    for i, s in enumerate(sizes):
        start = 0
        while s - start > capacity:
            parts[i].append((bins, start, capacity))
            bins, start = bins + 1, start + capacity
        items.append((max(s, 0) - start, i, start))
    large = sorted((x for x in items if 3 * x[0] > capacity), key=lambda x: (x[0], -x[1]))
    small = sorted((x for x in items if 3 * x[0] <= capacity), key=lambda x: (-x[0], x[1]))
    gaps: list[tuple[int, int]] = []  # (gap, container), sorted
    waiting = [(s, k) for k, (s, _, _) in enumerate(large)]
    while waiting:
        s, k = waiting.pop()
        parts[large[k][1]].append((bins, large[k][2], s))
        gap = capacity - s
        at = bisect_left(waiting, (gap + 1, -1)) - 1
        if at >= 0:
            t, j = waiting.pop(at)
            parts[large[j][1]].append((bins, large[j][2], t))
            gap -= t
        gaps.append((gap, bins))
        bins += 1
    gaps.sort()
    for s, i, start in small:
        at = bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b, bins = capacity, bins, bins + 1
        parts[i].append((b, start, s))
        insort(gaps, (gap - s, b))
    return parts


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, shard_rows: int = 20_000) -> DataFrame:
    """(key, part, container, start, length): where each item, or each part of an oversized one, lies.

    ``container`` is a string, unique over all shards. Repeated rows of a key count as one item (the largest size, if
    they differ); a NULL size counts as 0, a NULL key is a key. An empty table gives no rows; other columns are dropped.
    """
    kind = items.schema[key].dataType.simpleString()
    # Keys travel as strings: pandas has no whole numbers with NULL.
    named = items.select(F.col(f"`{key}`").cast("string").alias("k"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("s"))
    one = named.groupBy("k").agg(F.max("s").alias("s"))
    shards = max(1, -(-one.count() // shard_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "k"], kind="stable", na_position="first")
        name = str(group["shard"].iloc[0])
        rows = [
            (k, n, f"{name}-{b}", start, length)
            for k, parts in zip(group["k"], pack(group["s"].tolist(), capacity), strict=True)
            for n, (b, start, length) in enumerate(sorted(parts, key=lambda p: p[1]), 1)
        ]
        return pd.DataFrame(rows, columns=["k", "part", "container", "start", "length"])

    sharded = one.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    packed = sharded.groupBy("shard").applyInPandas(run, "k string, part int, container string, start long, length long")
    return packed.select(F.col("k").cast(kind).alias(key), "part", "container", "start", "length")

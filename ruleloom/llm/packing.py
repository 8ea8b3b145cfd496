"""Filling containers of fixed capacity with items, by cost-balanced packing.

An item of n characters costs a linear and a quadratic part, as attention within it does. Items go in descending
order to the container of least cost that still has room; a new container is opened if none has. Items are
independent, so they are packed in blocks of bounded size, each as many items as fill a few hundred containers;
only sizes travel, never texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.splitting import family, split
from ruleloom.plans.lineage import settle

ITEMS = "id long, piece_no int, start_line int, end_line int, n_chars int"


def balanced(sizes: list[int], capacity: int, joint: int = 1, linear: float = 1.0, quadratic: float = 1e-4) -> list[int]:
    """Container of each item; every item must fit alone. ``joint`` characters separate two items of a container."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    n = max(1, math.ceil(sum(s + joint for s in sizes) / (capacity + joint))) if sizes else 0
    used = [-joint] * n
    heap = [(0.0, c) for c in range(n)]
    place = [0] * len(sizes)
    for i in order:
        need = sizes[i] + joint
        passed = []
        while heap and used[heap[0][1]] + need > capacity:
            full = heapq.heappop(heap)
            # a container without room for the smallest item is never looked at again
            if used[full[1]] + sizes[order[-1]] + joint <= capacity:
                passed.append(full)
        if heap:
            cost, c = heapq.heappop(heap)
        else:
            cost, c = 0.0, len(used)
            used.append(-joint)
        used[c] += need
        place[i] = c
        heapq.heappush(heap, (cost + linear * sizes[i] + quadratic * sizes[i] ** 2, c))
        for full in passed:
            heapq.heappush(heap, full)
    return place


def items(df: DataFrame, capacity: int) -> DataFrame:
    """Items of the rows of (id, name, start_line, text): whole texts, or pieces of those beyond the capacity.

    Null and empty texts are no items. Line ranges count line feeds from ``start_line`` (null: 1).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, name, start, text in zip(batch["id"], batch["name"], batch["start_line"], batch["text"], strict=True):
                first = 1 if start != start or start is None else int(start)
                if len(text) <= capacity:
                    rows.append((i, 0, first, first + text.count("\n"), len(text)))
                else:
                    rows.extend((i, p["piece_no"], p["start_line"], p["end_line"], len(p["text"])) for p in split(text, capacity, 0, family(name, text), first))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start_line", "end_line", "n_chars"])

    own = df.where(F.length("text") > 0).select(F.col("id").cast("long").alias("id"), "name", F.col("start_line").cast("int").alias("start_line"), "text")
    return own.mapInPandas(run, ITEMS)


def pack(sized: DataFrame, capacity: int, containers_per_block: int = 500) -> DataFrame:
    """``sized`` (id, piece_no, start_line, end_line, n_chars) with the ``container`` of each item.

    No container exceeds ``capacity`` characters, one between two items included. Which block an item is packed in
    is a hash of its id, piece and lines, so a block holds what fills about ``containers_per_block`` containers,
    unless the same row is repeated beyond that.
    """
    held = settle(sized, "items")
    total = held.agg(F.sum(F.col("n_chars") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / (capacity * containers_per_block)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "piece_no"], kind="stable")
        place = balanced(frame["n_chars"].tolist(), capacity)
        return frame.assign(container=[int(b) * (1 << 32) + c for b, c in zip(frame["block"], place, strict=True)]).drop(columns=["block"])

    blocked = held.withColumn("block", F.pmod(F.xxhash64("id", "piece_no", "start_line"), F.lit(blocks)))
    return blocked.groupBy("block").applyInPandas(run, ITEMS + ", container long")

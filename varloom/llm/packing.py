"""Filling containers of fixed capacity with texts measured in tokens, by bulk-synchronous best fit.

Documents are range-sorted by (size, doc_id): each gets its rank within its size, and with it its
place in the order of all documents, by counts per task, so no size class is ever one
task and the result doesn't depend on how the rows lay. Documents of one size are equal for the packing, and so are containers with the
same gap; both are held as runs (size or gap, how many). A superstep takes the largest
unplaced size, sweeps the gaps upwards from the successor of that size, gives the
documents to the gaps in rank order - so no two claim the same one - and updates the
gaps; what finds no gap opens containers. Supersteps repeat until every size is placed.
The runs depend on the capacity, not on the number of documents; they are applied to the
documents by binary search on the place in the order. The result equals best-fit
decreasing over single documents.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048


@functools.lru_cache(2)
def load_tokenizer(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("varloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens); a null text has 0 tokens. The texts do not leave the tasks that read them.

    `tokenizer` is the vocabulary file's path as the driver sees it (or a URL Spark can fetch); it is shipped to the executors.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(SparkFiles.get(name))
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in f["text"]]})

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id bigint, tokens bigint")


@dataclass(frozen=True)
class Placed:
    """Documents [first, first + items) of one size go to the containers from `container` on, `each` to a container."""

    size: int
    first: int
    items: int
    container: int
    each: int


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Placed], int]:
    """Supersteps over sizes (1..capacity, number of documents) in descending order: placed runs and the number of containers."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, how many)
    order: list[int] = []  # gaps in ascending order
    placed: list[Placed] = []
    opened = 0

    def add(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for size in sorted(counts, reverse=True):
        left, first = counts[size], 0
        if size < 1 or size > capacity:
            raise ValueError(f"size {size} is not in 1..{capacity}")

        def fill(gap: int, container: int, many: int) -> int:
            """Places what it can into containers with that gap; returns how many of them it used."""
            nonlocal left, first
            each = gap // size
            whole = min(many, left // each)
            if whole:
                placed.append(Placed(size, first, whole * each, container, each))
                add(gap - whole_room(each), container, whole)
                left, first = left - whole * each, first + whole * each
            if left and whole < many:  # the last one is filled in part
                placed.append(Placed(size, first, left, container + whole, left))
                add(gap - whole_room(left), container + whole, 1)
                first, left = first + left, 0
                return whole + 1
            return whole

        def whole_room(items: int) -> int:
            return items * size

        while left:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                break
            gap = order.pop(at)
            for container, many in gaps.pop(gap):
                used = fill(gap, container, many) if left else 0
                add(gap, container + used, many - used)
        if left:
            many = -(-left // (capacity // size))
            start, opened = opened, opened + many
            fill(capacity, start, many)
    return placed, opened


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, size, container) of documents (doc_id, tokens): every piece in exactly one container.

    A document up to the capacity is one piece. A longer one is divided into pieces of the
    capacity and a last one; each full piece fills a container, the last is packed like
    any other. Documents of 0 tokens take no room and get container null. Repeated rows are items of
    their own. The driver holds a row per size class and task boundary, at most capacity + tasks.
    """
    cap = F.lit(capacity)
    pieces = F.greatest(F.ceil(F.col("tokens") / cap), F.lit(1)).cast("int")
    items = sizes.where(F.col("tokens").isNotNull()).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * cap
    items = cut(items.select("doc_id", "piece", start.alias("start"), F.least(cap, F.col("tokens") - start).cast("int").alias("size")))
    order = ["size", "doc_id", "piece"]
    ranged = cut(items.where("size > 0").repartitionByRange(*order).sortWithinPartitions(*order))
    # in range order a task has few sizes, and a size that spans tasks is continued where the task before left it
    found = sorted((r["size"], r["task"], r["m"]) for r in ranged.groupBy(F.spark_partition_id().alias("task"), "size").agg(F.count("*").alias("m")).collect())
    counts: dict[int, int] = {}
    first: dict[int, list[tuple[int, int]]] = {}  # task -> (size, place of its first document of that size)
    for place, (size, task, m) in zip(itertools.accumulate((m for *_, m in found), initial=0), found):
        counts[size] = counts.get(size, 0) + m
        first.setdefault(task, []).append((size, place))
    placed, _ = best_fit(counts, capacity)
    by_size = sorted(counts)
    base = dict(zip(by_size, itertools.accumulate((counts[s] for s in by_size), initial=0)))
    runs = np.array(sorted((base[p.size] + p.first, p.container, p.each) for p in placed), np.int64).reshape(-1, 3)
    carried = items.sparkSession.sparkContext.broadcast(({t: np.array(v, np.int64) for t, v in first.items()}, runs))

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        starts, runs = carried.value
        place = None
        for f in frames:
            if not len(f):
                continue
            if place is None:  # rows lie in the order of places, and a task's places follow each other
                place = int(starts[TaskContext.get().partitionId()][0, 1])
            at = place + np.arange(len(f))
            place += len(f)
            run = runs[np.searchsorted(runs[:, 0], at, side="right") - 1]
            f["container"] = run[:, 1] + (at - run[:, 0]) // run[:, 2]
            yield f[["doc_id", "piece", "start", "size", "container"]]

    full = ranged.mapInPandas(apply, "doc_id bigint, piece int, start bigint, size int, container bigint")
    return full.unionByName(items.where("size = 0").select("doc_id", "piece", "start", "size", F.lit(None).cast("bigint").alias("container")))

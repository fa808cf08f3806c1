"""Labelled arrays as long tables: one row per cell, keyed by its dimensions; dimension tables hold one row per label."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.pipe import Pipe
from varloom.operators.reshape import unpivot

#: Labels up to which a dimension may be clustered on the driver.
MOST_LABELS = 5_000


def from_wide(key: str, variable: str = "tissue", value: str = "value") -> Pipe:
    """Wide matrix (key, one column per label) as a long array."""
    return unpivot([key], None, variable, value)


def most_significant(cells: DataFrame, labels: DataFrame, dim: str, by: str, n: int, descending: bool = False) -> DataFrame:
    """Cells of the n first labels of a dimension by a column of its table; ties by label, nulls last."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return cells.join(labels.orderBy(order, dim).limit(n).select(dim), dim, "left_semi")


def significance_filter(cells: DataFrame, labels: DataFrame, dim: str, p: str, z: str, threshold: float) -> DataFrame:
    """Cells of labels with p <= threshold / number of labels and z >= 0."""
    n = max(labels.count(), 1)
    return cells.join(labels.where((F.col(p) <= threshold / n) & (F.col(z) >= 0) & ~F.isnan(z)).select(dim), dim, "left_semi")


def annotate(cells: DataFrame, dim: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Left joins of annotation tables on a dimension; of a repeated label the first row by all columns counts."""
    for s in sources:
        rest = [c for c in s.columns if c != dim]
        one = s.groupBy(dim).agg(F.min(F.struct(*rest)).alias("_r"))
        cells = cells.join(one.select(dim, *(F.col(f"_r.{c}").alias(c) for c in rest)), dim, "left")
    return cells


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering; ties go to the smaller index."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    leaves, size, alive = {i: [i] for i in range(n)}, np.ones(n), np.ones(n, bool)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        leaves[i] = leaves[i] + leaves.pop(j)
    return leaves[int(np.flatnonzero(alive)[0])] if n else []


def cluster_order(cells: DataFrame, dim: str, other: str, value: str, metric: str = "correlation") -> list:
    """Labels of a dimension in clustered order. Distances need sums over pairs of labels that share the other dimension, made by the tasks; linkage is the driver's, for at most MOST_LABELS labels."""
    labels = sorted(r[0] for r in cells.select(dim).distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{dim} has more than {MOST_LABELS} labels")
    a = cells.select(F.col(dim).alias("a"), F.col(other).alias("o"), F.col(value).alias("x"))
    b = cells.select(F.col(dim).alias("b"), F.col(other).alias("o"), F.col(value).alias("y"))
    if metric == "correlation":
        dist = 1 - F.corr("x", "y")
    elif metric == "euclidean":
        dist = F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))))
    else:
        raise ValueError(f"metric is {metric}")
    pairs = a.join(b, "o").where("a < b").groupBy("a", "b").agg(dist.alias("d")).collect()
    at = {v: i for i, v in enumerate(labels)}
    m = np.full((len(labels), len(labels)), 2.0 if metric == "correlation" else np.finfo(float).max)
    for r in pairs:
        if r["d"] is not None and not np.isnan(r["d"]):
            m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["d"]
    return [labels[i] for i in leaf_order(m)]

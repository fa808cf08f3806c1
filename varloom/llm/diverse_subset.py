"""Choosing a varied subset by tournament-pivoted rank-revealing QR.

Every record is a sparse feature row: its items, hashed with signs into `item_dims`
dimensions, and its group (collection) in dimensions of its own. In a round every task
runs a QR with row pivoting over its rows and nominates the
`block` rows that are most independent of each other and of what is already chosen;
nominees meet in pairs, tree level by tree level, and are pivoted again until one block
is left. All rows are deflated by the chosen ones and the next round begins.

Residual lengths are those of sparse rows against an orthonormal basis, so a row costs its
items times the directions, and a row's residual is looked at again only where the old, larger one
would make it the pivot. A row may be a pivot only if `tolerance` of its own length is
left, whatever longer rows there are; the tolerance is lowered once no row has it left. So a
near-copy of a chosen record is passed over as long as a more independent record remains,
and exact copies come last of all. The chosen rows and their directions are kept throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.session import cut

ROWS_AT_ONCE = 32_768
#: Products of entries and directions made at a time.
PRODUCTS_AT_ONCE = 4_000_000
#: Shares of a row's own length that must be left for it to be a pivot; the next one holds once no row meets the one before.
TOLERANCES = (0.8, 0.6, 0.4, 0.2, 0.01)


@dataclass(frozen=True)
class Space:
    """Feature space: hashed item dimensions, group dimensions, the group's share of a row's squared length.

    The item part has its full length from `full_size` distinct items on, less below it (in
    proportion to the logarithm), as a record with many items covers more.
    """

    item_dims: int = 8192
    group_dims: int = 64
    group_share: float = 0.4
    full_size: int = 64

    @property
    def dims(self) -> int:
        return self.item_dims + self.group_dims


def features(records: DataFrame, items: DataFrame, space: Space = Space()) -> DataFrame:
    """(id, items, group): hashed distinct items (twice the dimension, plus one for a minus sign) and the group's dimension.

    Up to group_dims groups have a dimension each; more are hashed into them.

    records: (id, group); items: (id, item). Repeated items count once, folded before the only shuffle of the items; null items and null
    ids are left out; a null group is a group of its own; a record without items has its
    group only. Of repeated ids one row stays.
    """
    h = F.xxhash64("item")
    code = (F.pmod(h, F.lit(space.item_dims)) * 2 + F.when(F.xxhash64(F.lit(7), "item") % 2 == 0, 0).otherwise(1)).cast("int")
    # items are told apart by their hash
    vectors = items.where("id is not null and item is not null").groupBy("id").agg(F.collect_set(F.struct(h.alias("h"), code.alias("code"))).alias("e"))
    one = records.where("id is not null").groupBy("id").agg(F.min(F.coalesce("group", F.lit("(none)"))).alias("group"))
    groups = sorted(r["group"] for r in one.select("group").distinct().limit(space.group_dims + 1).collect())
    if 0 < len(groups) <= space.group_dims:
        at = F.element_at(F.create_map(*(F.lit(x) for pair in zip(groups, range(len(groups)), strict=True) for x in pair)), F.col("group")) + space.item_dims
    else:
        at = F.pmod(F.xxhash64("group"), F.lit(space.group_dims)).cast("int") + space.item_dims
    return one.join(vectors, "id", "left").select("id", F.coalesce("e.code", F.array().cast("array<int>")).alias("items"), at.cast("int").alias("group"))


@dataclass
class Rows:
    """Sparse feature rows: row i has the entries [starts[i], starts[i + 1]) of slots and vals; own is the length of its item part, or of the group's where there are no items."""

    ids: np.ndarray
    slots: np.ndarray
    vals: np.ndarray
    starts: np.ndarray
    own: np.ndarray
    source: pd.DataFrame | None = None

    @classmethod
    def of(cls, f: pd.DataFrame, space: Space) -> Rows:
        """Rows of (id, items, group), by id. The item part has its full length from full_size items on."""
        f = f.sort_values("id", kind="stable", ignore_index=True)
        n = len(f)
        many = np.fromiter((len(x) for x in f["items"]), np.int64, n)
        code = np.concatenate([*f["items"], np.zeros(0, np.int64)]).astype(np.int64)
        # entries of the items, equal dimensions added up, and one of the group
        cell, entry = np.unique(np.repeat(np.arange(n), many) * space.dims + code // 2, return_inverse=True)
        val = np.bincount(entry, 1.0 - 2 * (code & 1), len(cell)) if len(cell) else np.zeros(0)
        norm = np.sqrt(np.bincount(cell // space.dims, val**2, n))
        length = np.minimum(1.0, np.log1p(many) / math.log1p(space.full_size)) * math.sqrt(1 - space.group_share)
        scale = np.divide(length, norm, out=np.zeros(n), where=norm > 1e-9)
        row = np.concatenate([cell // space.dims, np.arange(n)])
        slot = np.concatenate([cell % space.dims, f["group"].to_numpy(np.int64)])
        val = np.concatenate([val * scale[cell // space.dims], np.full(n, math.sqrt(space.group_share))])
        order = np.argsort(row, kind="stable")
        own = np.where(scale > 0, length, math.sqrt(space.group_share))
        return cls(f["id"].to_numpy(np.int64), slot[order], val[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), own, f)

    def frame(self, at: np.ndarray) -> pd.DataFrame:
        return self.source.iloc[at].reset_index(drop=True)

    def dense(self, i: int, dims: int) -> np.ndarray:
        c = slice(self.starts[i], self.starts[i + 1])
        return np.bincount(self.slots[c], self.vals[c], dims)

    def times(self, at: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Products of rows `at` with the columns of basis (dims x r)."""
        out = np.zeros((len(at), basis.shape[1]), np.float64)
        if not basis.shape[1]:
            return out
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        step, i = max(1, PRODUCTS_AT_ONCE // basis.shape[1]), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + step, side="right")))
            n, first = counts[i:j], self.starts[at[i:j]]
            before = np.cumsum(n) - n
            entry = np.repeat(first - before, n) + np.arange(n.sum())
            out[i:j] = np.add.reduceat(basis[self.slots[entry]] * self.vals[entry, None], before, axis=0)
            i = j
        return out

    def squares(self) -> np.ndarray:
        return np.add.reduceat(self.vals**2, self.starts[:-1]) if len(self.ids) else np.zeros(0)


def pivoted(rows: Rows, basis: np.ndarray, block: int, tolerance: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """QR with row pivoting after deflation by basis: places of the pivots in order and their residual lengths.

    The pivot is the longest residual of the rows that have `tolerance` of their own length left.
    Rows are only met through their products with the basis and with the pivots, so the triangular
    factor is found without a dense direction. Residuals only shrink, so the top of the old ones
    is brought up to date until the longest is known. Ties go to the smaller id.
    """
    n = len(rows.ids)
    size = min(block, n)
    inside = rows.times(np.arange(n), basis)
    start = rows.squares() - np.einsum("ij,ij->i", inside, inside)
    least = (tolerance * rows.own) ** 2

    def score(left: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(left >= least[at], np.round(left, 9), -1.0)

    upper, seen = score(start, np.arange(n)), np.zeros(n, np.int64)
    factor, own_row = np.zeros((size, size)), np.zeros((n, size))  # of the pivots; of rows when last looked at
    pivots, places, lengths = np.zeros((dims, size)), [], []
    for t in range(size):
        while True:
            p = int(np.argmax(upper))
            if upper[p] <= 0 or seen[p] == t:
                break
            top = np.argpartition(upper, -min(64, n))[-min(64, n) :]
            top = np.union1d(top[(seen[top] < t) & (upper[top] > 0)], [p])
            common = rows.times(top, pivots[:, :t]) - inside[top] @ inside[places].T
            own_row[top, :t] = np.linalg.solve(factor[:t, :t], common.T).T
            upper[top], seen[top] = score(start[top] - np.einsum("ij,ij->i", own_row[top, :t], own_row[top, :t]), top), t
        if upper[p] <= 0:
            break
        length = math.sqrt(max(start[p] - float(own_row[p, :t] @ own_row[p, :t]), 1e-12))
        factor[t, :t], factor[t, t], pivots[:, t] = own_row[p, :t], length, rows.dense(p, dims)
        places.append(p)
        lengths.append(length)
        upper[p], seen[p] = -1.0, np.iinfo(np.int64).max
    return np.array(places, np.int64), np.array(lengths)


def directions(rows: Rows, places: np.ndarray, basis: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal directions (dims x pivots) that the pivots add to the basis."""
    v = np.column_stack([rows.dense(p, dims) for p in places]) if len(places) else np.zeros((dims, 0))
    for _ in range(2):  # twice is enough against rounding
        v = v - basis @ (basis.T @ v)
    return np.linalg.qr(v)[0]


def select_varied(records: DataFrame, items: DataFrame, k: int, space: Space = Space(), block: int = 128, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """(place, id, tolerance, residual): k records, or all if there are fewer, in order of choice.

    records: (id, group); items: (id, item). The driver and every task hold the directions chosen so far (at most k x
    dims numbers) and a block of nominees; neither grows with the records. Records that lie wholly
    in what the chosen ones span come last, the longest residual first, with tolerance 0.
    Ties go to the smaller id; an empty table gives no rows.
    """
    spark = records.sparkSession
    base = cut(features(records, items, space))
    tasks = base.rdd.getNumPartitions()
    schema = "node int, id bigint, items array<int>, group int"
    chosen: list[tuple[int, int, float, float]] = []
    basis, dims, level = np.zeros((space.dims, 0)), space.dims, 0

    def steps(carried, tolerance: float) -> tuple[Callable, Callable]:
        """What a task and a node of the tree do in a round."""

        def best(f: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
            rows = Rows.of(f, space)
            return rows.frame(pivoted(rows, q, block, tolerance, dims)[0])

        def nominate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            q, held, n, kept = carried.value.astype(np.float64), [], 0, None
            for f in frames:
                held.append(f)
                n += len(f)
                if n >= ROWS_AT_ONCE:
                    kept = best(pd.concat([*held, kept] if kept is not None else held, ignore_index=True), q)
                    held, n = [], 0
            if held:
                kept = best(pd.concat([*held, kept] if kept is not None else held, ignore_index=True), q)
            if kept is not None and len(kept):
                kept.insert(0, "node", np.int32(TaskContext.get().partitionId()))
                yield kept

        def meet(f: pd.DataFrame) -> pd.DataFrame:
            out = best(f.drop(columns="node"), carried.value.astype(np.float64))
            out.insert(0, "node", f["node"].iloc[0])
            return out

        return nominate, meet

    while len(chosen) < k and level < len(tolerances):
        tolerance = tolerances[level]
        nominate, meet = steps(spark.sparkContext.broadcast(basis.astype(np.float32)), tolerance)
        nominees = base.mapInPandas(nominate, schema)
        for _ in range(max(0, math.ceil(math.log2(max(tasks, 1))))):
            nominees = nominees.withColumn("node", F.expr("node div 2").cast("int")).groupBy("node").applyInPandas(meet, schema)
        final = nominees.limit(block).toPandas()
        if not len(final):
            level += 1
            continue
        rows = Rows.of(final, space)
        places, lengths = pivoted(rows, basis, min(block, k - len(chosen)), tolerance, dims)
        if not len(places):
            level += 1
        chosen += [(len(chosen) + i + 1, int(rows.ids[p]), float(tolerance), float(r)) for i, (p, r) in enumerate(zip(places, lengths, strict=True))]
        basis = np.column_stack([basis, directions(rows, places, basis, dims)])
    done = spark.createDataFrame(chosen, "place int, id bigint, tolerance double, residual double")
    if len(chosen) == k:
        return done
    carried = spark.sparkContext.broadcast((basis, np.array([c[1] for c in chosen], np.int64)))

    def left(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, gone = carried.value
        for f in frames:
            rows = Rows.of(f[~f["id"].isin(gone)], space)
            inside = rows.times(np.arange(len(rows.ids)), q)
            yield pd.DataFrame({"id": rows.ids, "residual": np.round(np.sqrt(np.maximum(rows.squares() - np.einsum("ij,ij->i", inside, inside), 0)), 4)})

    rest = base.mapInPandas(left, "id bigint, residual double").orderBy(F.desc("residual"), "id").limit(k - len(chosen))
    place = F.row_number().over(Window.orderBy(F.desc("residual"), "id")) + len(chosen)
    return done.unionByName(rest.select(place.cast("int").alias("place"), "id", F.lit(0.0).alias("tolerance"), "residual"))

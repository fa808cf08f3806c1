"""Percentiles of very large numeric columns by radix selection.

A double's 64 bits, with the sign folded in, order like the values. A pass counts, per
group, one digit of these integers for the values whose leading digits are followed; the
digit that holds a target rank is followed in the next pass. Values with the same leading
16 bits (sign, exponent, four bits of mantissa) differ by at most 1/16, so the first
pass's counts alone bound a percentile to that; each further pass of 16 bits divides the
bound by 65,536, and the fourth is exact. Counts of partitions, days or files are merged
by adding them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.session import cut

DIGIT_BITS = 16
#: Followed prefixes up to which a pass carries them to the workers itself; beyond it they are joined by shuffle.
FOLLOWED_ROWS = 500_000
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that order like the doubles; -0.0 counts as 0.0."""
    u = (np.asarray(x, dtype=np.float64) + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def bits_value(u: np.ndarray) -> np.ndarray:
    """The doubles behind ordered_bits."""
    u = np.asarray(u, dtype=np.uint64)
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def signed(u: np.ndarray) -> np.ndarray:
    return (u ^ np.uint64(1 << 63)).view(np.int64)


def long_values(df: DataFrame, scopes: dict[str, str | None], metrics: Sequence[str], part: str | None) -> tuple[DataFrame, list[str]]:
    """Narrow input of a pass: part, one text key per scope, and the metrics."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"k_{s}") if c else F.lit("").alias(f"k_{s}") for s, c in scopes.items()]
    part_col = (F.col(part).cast("string") if part else F.lit(None).cast("string")).alias("part")
    return df.select(part_col, *keys, *(F.col(m).cast("double").alias(f"m_{m}") for m in metrics)), list(scopes)


def _count_pass(narrow: DataFrame, scopes: list[str], metrics: Sequence[str], level: int, followed) -> DataFrame:
    """(part, scope, key, metric, prefix, digit, n), counted within each task before the shuffle.

    `prefix` holds the leading 16 * level bits. `followed` is None at level 0, else a
    broadcast dict (scope, key, metric) -> sorted prefixes.
    """
    shift = np.uint64(64 - DIGIT_BITS * (level + 1))
    with_part = level == 0
    schema = "part string, scope string, key string, metric string, prefix bigint, digit int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held: list[pd.DataFrame] = []
        size = 0

        def fold(frames):
            return pd.concat(frames, ignore_index=True).groupby(["part", "scope", "key", "metric", "prefix", "digit"], dropna=False, sort=False, as_index=False)["n"].sum()

        def out(frame):
            frame = frame.astype({"digit": "int32", "n": "int64", "prefix": "int64"})
            return pa.RecordBatch.from_pandas(frame[["part", "scope", "key", "metric", "prefix", "digit", "n"]], preserve_index=False, schema=arrow)

        arrow = pa.schema([("part", pa.string()), ("scope", pa.string()), ("key", pa.string()), ("metric", pa.string()), ("prefix", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])
        def wanted_codes(s, m, key_names):
            """The followed prefixes of this batch's keys, with the key's place in the batch in the low bits."""
            codes = [(followed.value[s, k, m].astype(np.uint64) << np.uint64(DIGIT_BITS)) | np.uint64(i) for i, k in enumerate(key_names) if (s, k, m) in followed.value]
            return np.concatenate(codes) if codes else np.zeros(0, np.uint64)

        # a batch has fewer keys than 2 ** DIGIT_BITS, as it has fewer rows
        for batch in (b.slice(i, 1 << (DIGIT_BITS - 1)) for b in batches for i in range(0, b.num_rows, 1 << (DIGIT_BITS - 1))):
            f = batch.to_pandas()
            parts, part_names = pd.factorize(f["part"], use_na_sentinel=False) if with_part else (np.zeros(len(f), np.int64), np.array([None], object))
            for s in scopes:
                keys, key_names = pd.factorize(f[f"k_{s}"], use_na_sentinel=False)
                group = parts.astype(np.int64) * len(key_names) + keys
                for m in metrics:
                    x = f[f"m_{m}"].to_numpy(np.float64, na_value=np.nan)
                    ok = ~np.isnan(x)
                    u, g = ordered_bits(x[ok]), group[ok]
                    if level:
                        pre = signed(u) >> np.int64(64 - DIGIT_BITS * level)
                        code = (pre.astype(np.uint64) << np.uint64(DIGIT_BITS)) | g.astype(np.uint64)
                        keep = np.isin(code, wanted_codes(s, m, key_names))
                        u, g, pre = u[keep], g[keep], pre[keep]
                    if not len(u):
                        continue
                    digit = ((u >> shift) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64)
                    if level:
                        cells = pd.DataFrame({"g": g, "prefix": pre, "digit": digit}).groupby(["g", "prefix", "digit"], sort=False, as_index=False).size()
                    else:
                        code, size_of = np.unique((g << np.int64(DIGIT_BITS)) | digit, return_counts=True)
                        cells = pd.DataFrame({"g": code >> np.int64(DIGIT_BITS), "prefix": 0, "digit": code & np.int64((1 << DIGIT_BITS) - 1), "size": size_of})
                    gg = cells["g"].to_numpy()
                    held.append(pd.DataFrame({"part": part_names[gg // len(key_names)], "scope": s, "key": key_names[gg % len(key_names)], "metric": m, "prefix": cells["prefix"], "digit": cells["digit"], "n": cells["size"]}))
                    size += len(cells)
            if size > 400_000:
                held = [fold(held)]
                size = len(held[0])
                if size > 200_000:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(fold(held))

    return narrow.mapInArrow(run, schema)


def day_counts(df: DataFrame, scopes: dict[str, str | None], metrics: Sequence[str], part: str) -> DataFrame:
    """First-digit counts per part (day): (part, scope, key, metric, digit, n). Kept per day, merged by adding n.

    Null and NaN values are left out; infinities order at the ends; a null key is "(none)".
    """
    narrow, names = long_values(df, scopes, metrics, part)
    return _count_pass(narrow, names, metrics, 0, None).groupBy("part", "scope", "key", "metric", "digit").agg(F.sum("n").alias("n"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Adds the counts of any parts: one row per (scope, key, metric, digit)."""
    return counts.groupBy("scope", "key", "metric", "digit").agg(F.sum("n").alias("n"))


def _locate(counts: DataFrame, targets: DataFrame | None, percentiles: Sequence[float]) -> DataFrame:
    """The digit that holds each target rank: (scope, key, metric, q, total, rank left within the digit, prefix, digit).

    At most 65,536 digits a group and prefix, so the running sum's window is bounded.
    """
    by = ["scope", "key", "metric", "prefix"]
    w = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    if targets is None:
        total = counts.groupBy("scope", "key", "metric").agg(F.sum("n").alias("total"))
        q = F.explode(F.array(*(F.lit(float(p)) for p in percentiles)))
        targets = total.select("*", q.alias("q")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("total"), 6)))).withColumn("prefix", F.lit(0).cast("bigint"))
    hit = run.join(targets, by).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
    return hit.select("scope", "key", "metric", "q", "total", (F.col("rank") - F.col("before")).alias("rank"), "prefix", "digit")


def _descend(found: DataFrame, level: int) -> DataFrame:
    """Appends the digit to the prefix. The first digit's sign bit is turned, so that prefixes stay signed bigints."""
    prefix = (F.col("digit").cast("bigint") - F.lit(1 << (DIGIT_BITS - 1))) if level == 0 else F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit").cast("bigint"))
    return found.select("scope", "key", "metric", "q", "total", "rank", prefix.alias("prefix"))


def _with_bounds(found: DataFrame, levels: int) -> DataFrame:
    low_bits = 64 - DIGIT_BITS * levels

    def bounds(batches):
        for f in batches:
            low = f["prefix"].to_numpy(np.int64) << np.int64(low_bits) if low_bits else f["prefix"].to_numpy(np.int64)
            high = low | np.int64((1 << low_bits) - 1)
            lo, hi = (bits_value(v.view(np.uint64) ^ np.uint64(1 << 63)) for v in (low, high))
            f["lower"], f["upper"] = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
            f["value"] = np.where(f["lower"] == f["upper"], f["lower"], f["lower"] / 2 + f["upper"] / 2)
            yield f[["scope", "key", "metric", "q", "total", "lower", "upper", "value"]]

    return found.mapInPandas(bounds, "scope string, key string, metric string, q double, total bigint, lower double, upper double, value double")


def percentiles_from_counts(counts: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Percentiles of merged first-digit counts alone: value is the middle of [lower, upper], at most 1/32 off relative to the true value."""
    first = merge_counts(counts).withColumn("prefix", F.lit(0).cast("bigint"))
    return _with_bounds(_descend(_locate(first, None, percentiles), 0), 1)


def percentiles(df: DataFrame, scopes: dict[str, str | None], metrics: Sequence[str], part: str, percentiles: Sequence[float] = PERCENTILES, levels: int = 4, counts: DataFrame | None = None) -> DataFrame:
    """(scope, key, metric, q, total, lower, upper, value): the value of rank ceil(q * total) in every group.

    scopes: name -> key column, or None for all rows. `counts` are day counts kept from
    before; without them they are made here. With four levels lower = upper = value.
    Groups without values are left out; an empty table gives no rows.
    """
    counts = cut(day_counts(df, scopes, metrics, part)) if counts is None else counts
    narrow, names = long_values(df, scopes, metrics, None)
    found = cut(_descend(_locate(merge_counts(counts).withColumn("prefix", F.lit(0).cast("bigint")), None, percentiles), 0))
    for level in range(1, levels):
        wanted = found.select("scope", "key", "metric", "prefix").distinct()
        rows = wanted.limit(FOLLOWED_ROWS + 1).collect()
        if len(rows) <= FOLLOWED_ROWS:
            by: dict[tuple, list[int]] = {}
            for r in rows:
                by.setdefault((r["scope"], r["key"], r["metric"]), []).append(r["prefix"])
            carried = df.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, np.int64)) for k, v in by.items()})
            cells = _count_pass(narrow, names, metrics, level, carried)
        else:
            cells = _joined_pass(narrow, names, metrics, level, wanted)
        cells = cells.groupBy("scope", "key", "metric", "prefix", "digit").agg(F.sum("n").alias("n"))
        found = cut(_descend(_locate(cells, found, percentiles), level))
    return _with_bounds(found, levels)


def _joined_pass(narrow: DataFrame, scopes: list[str], metrics: Sequence[str], level: int, wanted: DataFrame) -> DataFrame:
    """The pass for more followed prefixes than a task should hold: bits are taken in the workers, the join is Spark's, which splits hot keys."""
    low, shift = 64 - DIGIT_BITS * level, 64 - DIGIT_BITS * (level + 1)

    def bits(batches):
        import pandas as pd

        for f in batches:
            for s in scopes:
                for m in metrics:
                    x = f[f"m_{m}"].to_numpy(np.float64, na_value=np.nan)
                    ok = ~np.isnan(x)
                    u = ordered_bits(x[ok])
                    yield pd.DataFrame({"scope": s, "key": f[f"k_{s}"][ok], "metric": m, "prefix": signed(u) >> np.int64(low), "digit": ((u >> np.uint64(shift)) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int32)}).groupby(["scope", "key", "metric", "prefix", "digit"], as_index=False).size().rename(columns={"size": "n"})

    flat = narrow.mapInPandas(bits, "scope string, key string, metric string, prefix bigint, digit int, n bigint")
    return flat.join(wanted, ["scope", "key", "metric", "prefix"], "left_semi")

"""Percentiles against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import radix

VALUES = [0.0, -0.0, 1.5, -1.5, 1e-310, -1e-310, 1e308, -1e308, float("inf"), float("-inf"), 2.0, 2.0, 2.0, 3.25]


def test_order_of_bits():
    v = np.array(sorted(set(VALUES)))
    u = radix.ordered_bits(v)
    assert (np.diff(u.astype(object)) > 0).all() and (radix.bits_value(u) == v).all()


def frame(spark, seed=1, n=3000):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = float(rng.choice(VALUES)) if rng.random() < 0.1 else float(np.round(rng.normal() * 10.0 ** rng.integers(-3, 4), 3))
        v = None if rng.random() < 0.02 else math.nan if rng.random() < 0.02 else v
        rows.append((f"d{i % 7}", "hot" if rng.random() < 0.4 else f"k{rng.integers(5)}" if rng.random() < 0.9 else None, v, i))
    return spark.createDataFrame(rows, "day string, k string, v double, n int")


def expected(df, qs):
    groups = {}
    for r in df.collect():
        if r["v"] is not None and not math.isnan(r["v"]):
            for scope, key in (("k", r["k"] or "(none)"), ("all", "")):
                groups.setdefault((scope, key), []).append(r["v"] + 0.0)
    return {(*g, q): (sorted(v)[max(1, math.ceil(round(q * len(v), 6))) - 1], len(v)) for g, v in groups.items() for q in qs}


@pytest.mark.parametrize("limit", [radix.FOLLOWED_ROWS, 3])
def test_exact(spark, limit, monkeypatch):
    monkeypatch.setattr(radix, "FOLLOWED_ROWS", limit)
    d = frame(spark)
    qs = (0.0, 0.01, 0.5, 0.9, 1.0)
    got = {(r["scope"], r["key"], r["q"]): (r["value"], r["total"]) for r in radix.percentiles(d, {"k": "k", "all": None}, ["v"], "day", qs).collect()}
    assert got == expected(d, qs)


def test_merged_days_bound_the_value(spark):
    d = frame(spark, 2)
    days = [radix.day_counts(d.where(F.col("day") == f"d{i}"), {"k": "k", "all": None}, ["v"], "day") for i in range(7)]
    merged = days[0]
    for x in days[1:]:
        merged = merged.unionByName(x)
    want = expected(d, (0.25, 0.5))
    rows = radix.percentiles_from_counts(merged, (0.25, 0.5)).collect()
    assert len(rows) == len(want)
    for r in rows:
        v = want[r["scope"], r["key"], r["q"]][0]
        assert r["lower"] <= v <= r["upper"]
        if abs(v) > 1e-300 and math.isfinite(v):
            assert abs(r["value"] - v) <= abs(v) / 16


def test_fewer_levels_and_empty(spark):
    d = frame(spark, 3, 500)
    r = radix.percentiles(d, {"all": None}, ["v"], "day", (0.5,), levels=2).first()
    assert r["lower"] <= expected(d, (0.5,))["all", "", 0.5][0] <= r["upper"]
    assert radix.percentiles(d.limit(0), {"all": None}, ["v"], "day").count() == 0
    assert radix.percentiles(d.withColumn("v", F.lit(None).cast("double")), {"all": None}, ["v"], "day").count() == 0

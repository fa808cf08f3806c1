"""Varied subset: coverage, near-copies, laps, agreement with plain pivoting."""

import random

import numpy as np

from varloom.llm import diverse_subset as ds


def frames(spark, groups, items):
    r = spark.createDataFrame([(i, g, "x") for i, g in groups], "id bigint, group string, item string").select("id", "group")
    return r, spark.createDataFrame(items or [(None, None)], "id bigint, item bigint")


def test_near_copies_and_groups(spark):
    rng = random.Random(1)
    groups, items = [], []
    base = [sorted(rng.sample(range(2000), 40)) for _ in range(12)]
    for i in range(400):
        b = 0 if i < 200 else i % 12
        v = list(base[b])
        v[rng.randrange(40)] = rng.randrange(2000)
        groups.append((i, f"g{i % 3}" if i < 399 else "rare"))
        items += [(i, x) for x in v]
    got = ds.select_varied(*frames(spark, groups, items), k=16).orderBy("place").collect()
    ids = [r["id"] for r in got]
    assert len(set(ids)) == 16 and [r["place"] for r in got] == list(range(1, 17))
    assert {dict(groups)[i] for i in ids} == {"g0", "g1", "g2", "rare"}
    kinds = [0 if i < 200 else i % 12 for i in ids]
    assert len(set(kinds)) == 12  # the group that holds half of all rows takes no more than its share
    assert kinds.count(0) <= 4  # of 16, where half of all rows are of this kind


def sparse(x):
    return ds.Rows(np.arange(len(x)), np.tile(np.arange(x.shape[1]), len(x)), x.ravel(), np.arange(len(x) + 1) * x.shape[1], np.linalg.norm(x, axis=1))


def test_pivots_agree_with_greedy():
    rng = np.random.default_rng(4)
    for n in (60, 400):
        x = rng.normal(size=(n, 20))
        places, lengths = ds.pivoted(sparse(x), np.zeros((20, 0)), 10, 1e-6, 20)
        new = ds.directions(sparse(x), places, np.zeros((20, 0)), 20)
        assert np.allclose(new.T @ new, np.eye(10))
        r, chosen = x.copy(), []
        for _ in range(10):
            p = int(np.argmax((r**2).sum(1)))
            chosen.append(p)
            q = r[p] / np.linalg.norm(r[p])
            r = r - np.outer(r @ q, q)
        assert places.tolist() == chosen and (np.diff(lengths) <= 1e-9).all()
        more, _ = ds.pivoted(sparse(x), new, 5, 1e-6, 20)
        for p in more.tolist():
            assert p == int(np.argmax((r**2).sum(1)))
            q = r[p] / np.linalg.norm(r[p])
            r = r - np.outer(r @ q, q)


def test_no_copy_while_an_independent_record_remains(spark):
    """Large copied records are longer rows than small independent ones, which come first all the same."""
    rng = random.Random(6)
    big = [sorted(rng.sample(range(5000), 80)) for _ in range(10)]
    items = [(i, x) for i in range(300) for x in (big[i % 10] if i % 3 else [*big[i % 10][:-6], *range(9000 + 6 * i, 9006 + 6 * i)])]
    items += [(i, 20_000 + 4 * i + x) for i in range(300, 340) for x in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, so that nominees meet
    try:
        got = ds.select_varied(*frames(spark, [(i, "g") for i in range(340)], items), k=60).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    small = [r["place"] for r in got if r["id"] >= 300]
    assert len(small) == 40 and max(small) <= 50 and {r["id"] % 10 for r in got[:50] if r["id"] < 300} == set(range(10))
    assert all(a["tolerance"] >= b["tolerance"] for a, b in zip(got, got[1:]))


def test_small_and_odd_inputs(spark):
    groups = [(1, None), (1, None), (2, "a"), (3, "a"), (4, "b"), (None, "z")]
    items = [(2, 5), (2, 5), (3, 5), (4, None), (9, 1)]
    got = ds.select_varied(*frames(spark, groups, items), k=10).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4]  # a copy comes last
    assert {r["place"]: r["id"] for r in got}[4] == 3 and [r["tolerance"] for r in got if r["id"] == 3] == [0.0]
    assert ds.select_varied(*frames(spark, groups, items), k=2).count() == 2
    r, i = frames(spark, groups, items)
    assert ds.select_varied(r.limit(0), i, k=3).count() == 0

"""Similarity join against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varloom.llm import overlap_join
from varloom.llm.overlap_join import least_overlap, similar_classes, similar_pairs


def brute(rows, num=7, den=10, least=5):
    sets = {}
    for s, i in rows:
        if s is not None and i is not None:
            sets.setdefault(s, set()).add(i)
    ids = sorted(k for k, v in sets.items() if len(v) >= least)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_threshold(a, b, o):
    if o <= min(a, b):
        assert (10 * o >= 7 * (a + b - o)) == (o >= least_overlap(a, b, 7, 10))


def frame(spark, rows):
    return spark.createDataFrame([(s, i, "x", 1) for s, i in rows], "s bigint, i bigint, item string, n int")


@pytest.mark.parametrize(("num", "den", "least"), [(7, 10, 5), (1, 2, 2), (9, 10, 1)])
def test_pairs(spark, num, den, least, monkeypatch):
    if num == 7:
        monkeypatch.setattr(overlap_join, "LIST_ROWS", 30)
    rng = random.Random(num)
    rows, base = [], []
    for s in range(250):
        if base and rng.random() < 0.6:
            v = set(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                v.discard(rng.choice(sorted(v)) if v else 0) if rng.random() < 0.5 else v.add(rng.randrange(80))
        else:
            v = {int(80 * rng.random() ** 2) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 20, 40]))}
        base.append(v)
        rows += [(s, i) for i in v] + [(s, i) for i in list(v)[:2]]
    rows += [(None, 1), (3, None), (900, None)]
    got = [(r["id1"], r["id2"]) for r in similar_pairs(frame(spark, rows), "s", "i", num, den, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, num, den, least)


def test_hot_group_of_copies_and_empty(spark):
    rows = [(s, i) for s in range(40) for i in range(10, 30)] + [(100 + k, i) for k in range(3) for i in range(10 + k, 30 + k)]
    got = {(r["id1"], r["id2"]) for r in similar_pairs(frame(spark, rows), "s", "i").collect()}
    assert got == brute(rows)
    pairs, member = similar_classes(frame(spark, rows), "s", "i")
    assert member.where("rep = 0").count() == 41 and pairs.count() == 3
    assert similar_pairs(frame(spark, []).limit(0), "s", "i").count() == 0

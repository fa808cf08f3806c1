"""Linkage on hand-made records and the solver against a direct minimisation."""

import itertools

import numpy as np
import pytest

from varloom.llm import soft_linkage as sl

GWAS = "snpid string, chr int, pos int, ea string, nea string, eaf double, row_id int"
REG = "regenie_row bigint, file_name string, chrom string, genpos bigint, allele0 string, allele1 string, a1freq double, snpid int"


def link(spark, records, rows):
    r = spark.createDataFrame([(i, "f", *x, 0) for i, x in enumerate(records)], REG)
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], GWAS)
    return {x["regenie_row"]: (x["snpid"], x["confidence"]) for x in sl.link(r, g, sl.Rules()).collect()}


ROWS = [
    ("v1", 1, 1000, "A", "G", 0.2), ("v1", 1, 1000, "g", "a", 0.8), ("v1", 1, 1000, None, "G", None), ("v2", 23, 500, "TCA", "T", 0.4), ("v3", 2, 64, "A", "T", 0.3),
    ("v4", 5, 100, "A", "AAAGA", 0.25), ("v5", 5, 5000, "C", "T", None), ("v6", 7, 100, "A", "C", 0.2), ("v7", 7, 104, "A", "C", 0.25), (None, 9, 1, "A", "C", 0.1),
]


def test_cases(spark):
    records = [
        ("1", 1000, "G", "A", 0.21), ("chr1", 1012, "A", "G", 0.79), (" CHR01 ", 990, "C", "T", 0.2), ("1", 1013, "G", "A", 0.2), ("1", 1000, "G", "A", 0.31), ("1.0", 1000, "G", None, None),
        ("1", 1000, None, None, 0.19), ("X", 500, "T", "TCA", 0.4), ("23", 501, "-", "ca", 0.4), ("X", 500, "A", "TGA", 0.4), ("2", 52, "A", "T", 0.7), ("2", 76, "T", "A", 0.31), ("2", 64, "A", "T", 0.5),
        ("5", 101, "-", "AAGA", 0.76), ("5", 101, "AAGA", "-", 0.26), ("5", 5000, "T", "C", 0.9), ("7", 103, "C", "A", 0.26), ("7", 100, "C", "A", 0.2), (None, 1000, "G", "A", 0.2), ("1", None, "G", "A", 0.2), ("Un_1", 1000, "G", "A", 0.2), ("1", 1000, "", "", None),
    ]
    got = {k: v[0] for k, v in link(spark, records, ROWS).items()}
    assert got == {0: "v1", 1: "v1", 2: "v1", 5: "v1", 6: "v1", 7: "v2", 8: "v2", 9: "v2", 10: "v3", 11: "v3", 13: "v4", 14: "v4", 15: "v5", 16: "v7", 17: "v6", 18: "v1"}  # 18: a null chromosome speaks neither for nor against


def test_many_tellers_of_one_variant(spark):
    got = link(spark, [("1", 1000 + k % 3, "G", "A", 0.2) for k in range(200)], ROWS)
    assert len(got) == 200 and {v[0] for v in got.values()} == {"v1"} and min(v[1] for v in got.values()) > 0.7


def test_many_alike_variants(spark):
    """A record that eight variants fit alike is tied to the best one."""
    rows = [(f"v{k}", 3, 700, None, None, None) for k in range(8)]
    got = link(spark, [("3", 700, None, None, None)], rows)
    assert got[0][0] == "v0" and got[0][1] < 0.2


def test_contradicted_candidates_lose(spark):
    """Nearer variants with other alleles or frequencies compete and are rejected by the solution, not by the block."""
    rows = [("near", 4, 100, "A", "C", 0.2), ("off", 4, 103, "A", "T", 0.2), ("rare", 4, 101, "A", "T", 0.6), ("far", 4, 140, "A", "T", 0.2)]
    d = spark.createDataFrame([(0, "f", "4", 100, "T", "A", 0.2, 0), (1, "f", "4", 120, "T", "A", 0.2, 0), (2, "f", None, 103, "T", "A", 0.21, 0), (3, "f", "4", None, "T", "A", 0.2, 0)], REG)
    g = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], GWAS)
    got = {x["regenie_row"]: x for x in sl.link(d, g).collect()}
    assert {k: v["snpid"] for k, v in got.items()} == {0: "off", 2: "off"}
    assert got[0]["candidates"] == 4 and got[0]["confidence"] > 0.6 and got[0]["residual"] < 0.01
    x = {(r["regenie_row"], r["snpid"]): r["x"] for r in sl.solve(sl.with_blocks(sl.evidence(sl.candidates(d, sl.variants(g))))).collect()}
    assert x[0, "near"] < 0.1 and x[0, "rare"] < 0.1 and x[0, "far"] < 0.1


def test_crowded_place_is_split(spark, monkeypatch):
    monkeypatch.setattr(sl, "CROWDED", 20)
    got = link(spark, [("1", 1000 + k % 3, "G", "A", 0.2) for k in range(100)], ROWS)
    assert len(got) == 100 and {v[0] for v in got.values()} == {"v1"} and max(v[1] for v in got.values()) - min(v[1] for v in got.values()) < 0.1


def test_empty(spark):
    r, g = spark.createDataFrame([], REG), spark.createDataFrame([], GWAS)
    assert sl.link(r, g, sl.Rules()).count() == 0


@pytest.mark.parametrize(("blocks", "at_once"), [((0, 0, 0), 100), ((0, 1, 0), 100), ((0, 1, 2), 2)])
def test_solver_finds_the_minimum(spark, blocks, at_once, monkeypatch):
    monkeypatch.setattr(sl, "AT_ONCE", at_once)
    rules = sl.Rules(tolerance=1e-3, inner_tolerance=1e-4)
    pairs = [(0, "a", 0.9), (0, "b", 0.7), (1, "b", 0.6), (2, "a", 0.5), (2, "c", 0.5)]
    d = spark.createDataFrame([(*x, 1.0, blocks[x[0]]) for x in pairs], "regenie_row bigint, snpid string, s double, weakest double, block bigint")
    got = {(r["regenie_row"], r["snpid"]): r["x"] for r in sl.solve(d, rules).collect()}
    variants = sorted({v for _, v, _ in pairs})

    def energy(x, h):
        e = sum(rules.rare * v for v in h.values())
        for (_, v, s), xv in zip(pairs, x, strict=True):
            e += rules.similar * max(0, s - xv) ** 2 + rules.prior * xv + rules.told * max(0, xv - h[v]) + rules.trans * max(0, h[v] + s - 1 - xv)
        return e

    x = [got[r, v] for r, v, _ in pairs]
    for r in (0, 2):
        assert sum(v for (q, _, _), v in zip(pairs, x, strict=True) if q == r) <= 1.02
    steps = np.linspace(0, 1, 11)
    best = min(energy(c, {v: min(steps, key=lambda t, c=c, v=v: energy(c, {w: t if w == v else 0 for w in variants})) for v in variants}) for c in itertools.product(steps, repeat=5) if c[0] + c[1] <= 1 and c[3] + c[4] <= 1)
    h = {v: min(np.linspace(0, 1, 101), key=lambda t, v=v: energy(x, {w: t if w == v else 0 for w in variants})) for v in variants}
    assert energy(x, h) <= best + 0.03


@pytest.mark.parametrize(("a", "b", "forms"), [("A", "G", {"A>G"}), ("TCA", "T", {"CA>"}), ("AAAGA", "A", {"AAAG>", "AAGA>"}), ("", "CA", {">CA"}), ("A", "A", set())])
def test_forms(a, b, forms):
    assert set(sl.allele_forms(a, b)) == forms

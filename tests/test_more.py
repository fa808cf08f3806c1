"""Ordered summary-statistics steps, many tables on one index, partitioned regression, gene tables."""

import math

import numpy as np
import pytest

from varloom.operators import downstream as dn
from varloom.operators import proteins as prot
from varloom.operators import regress as reg
from varloom.operators import sumstats


def test_sumstats_steps(spark):
    rows = [(1, 10, "A", "G", 0.2, 1960099, "a"), (1, 20, "A", "GT", 0.2, 1960099, "b"), (1, 30, "A", "T", 0.2, 1960099, "c"), (6, 26_000_000, "A", "G", 0.2, 1960099, "d"), (23, 5, "A", "G", 0.2, 1960099, "e"), (1, 40, "A", "G", 0.2, 1960098, "f"), (2, 10, "A", "G", None, 1960099, "a")]
    d = spark.createDataFrame(rows, "CHR int, POS int, EA string, NEA string, EAF double, STATUS int, rsID string")
    steps = sumstats.Steps(None, True, True, "38", True, {7: "78"})
    assert sorted((r["CHR"], r["POS"]) for r in d.transform(sumstats.transform(steps)).collect()) == [(1, 10), (2, 10)]
    members = spark.createDataFrame([(1, 10), (1, 10), (9, 9)], "CHR int, POS int")
    assert d.transform(sumstats.transform(sumstats.Steps(members))).count() == 1
    assert sorted(r["rsID"] for r in sumstats.for_correlation(d).collect()) == ["e", "f"]  # both rows of a repeated rsID go
    for bad in ((1, 10, "A", "G", 1.2, 1, "x"), (1, 10, "A", "G", 0.1, 9999999, "x")):
        with pytest.raises(Exception, match="EAF|status"):
            spark.createDataFrame([bad], d.schema).transform(sumstats.transform(sumstats.Steps())).collect()
    assert sumstats.for_correlation(d.limit(0)).count() == 0


def test_slim_proteins(spark):
    index = spark.createDataFrame([(0, 1, 10, "G", "A"), (1, 1, 20, "C", "T"), (2, 2, 5, "A", "C")], "row_id bigint, CHR int, POS int, EA string, NEA string")
    p = spark.createDataFrame([("p", 1, 10, "A", "G", 0.5, 0.1, 100), ("p", 1, 20, "C", "T", 0.5, None, 100), ("p", 2, 5, "C", "A", 0.25, 0.5, 100), ("p", 2, 5, "C", "A", 0.25, 0.5, 100), ("q", 1, 10, "G", "A", 0.5, 0.1, 7), ("q", 1, 99, "G", "A", 0.5, 0.1, 8)], "protein string, CHROM int, GENPOS int, ALLELE0 string, ALLELE1 string, BETA double, SE double, N int")
    s = {(r["protein"], r["row_id"]): r for r in prot.slim(index, p).collect()}
    assert set(s) == {("p", 0), ("p", 1), ("p", 2), ("q", 0)}
    assert s["p", 0]["BETA"] == 0.5 and s["q", 0]["BETA"] == -0.5 and s["p", 1]["BETA"] == -0.5 and math.isnan(s["p", 1]["SE"])
    with pytest.raises(ValueError, match="q"):
        prot.check_chromosomes(index, p)
    prot.check_chromosomes(index, p.where("protein = 'p'"))
    assert {tuple(r) for r in prot.constant_n(prot.slim(index, p)).collect()} == {("p", 100.0), ("q", 7.0)}
    with pytest.raises(Exception, match="distinct sample sizes"):
        prot.constant_n(p).collect()


def _simulated(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    ld = rng.uniform(1, 50, (n, 2))
    size = rng.uniform(9_000, 11_000, n)
    chi = 1.05 + size * (2e-6 * ld[:, 0] + 6e-6 * ld[:, 1]) + rng.normal(0, 0.3, n)
    return ld, size, np.abs(chi)


def test_partitioned_against_least_squares(spark):
    ld, size, chi = _simulated()
    n, blocks, m = len(chi), 20, 1e6
    rows = [("t", i, float(ld[i].sum()), float(chi[i]), float(size[i]), float(ld[i, 0]), float(ld[i, 1])) for i in range(n)]
    d = spark.createDataFrame(rows, "trait string, ordinal bigint, ld double, chi2 double, n double, a double, b double")
    got = {r["annotation"]: r for r in reg.partitioned(d, ["trait"], ["a", "b"], n, m, blocks).collect()}
    total = ld.sum(1)
    tot = min(max(m * (chi.mean() - 1) / (total * size).mean(), 0), 1)
    w = 1 / (2 * (1 + tot * size / m * np.maximum(total, 1)) ** 2) / np.maximum(total, 1)
    x = np.column_stack([ld * (size / size.mean())[:, None], np.ones(n)])

    def fit(keep):
        s = np.sqrt(w[keep])
        return np.linalg.lstsq(x[keep] * s[:, None], chi[keep] * s, rcond=None)[0]

    full = fit(np.ones(n, bool))
    cuts = reg.block_bounds(n, blocks)
    loo = []
    for a, b in cuts:
        keep = np.ones(n, bool)
        keep[a:b] = False
        loo.append(fit(keep))
    se = (blocks * full - (blocks - 1) * np.array(loo)).std(axis=0, ddof=1) / math.sqrt(blocks)
    for k, name in enumerate("ab"):
        assert got[name]["coefficient"] == pytest.approx(full[k] / size.mean(), rel=1e-6) and got[name]["coefficient_se"] == pytest.approx(se[k] / size.mean(), rel=1e-6)
    assert got["b"]["coefficient"] > got["a"]["coefficient"] > 0 and got["b"]["p"] < 1e-6


def test_exact_blocks_equal_shared_ones_where_all_are_kept(spark):
    ld, size, chi = _simulated(400, 5)
    d = spark.createDataFrame([(i, float(ld[i].sum()), float(min(chi[i], 70)), float(size[i])) for i in range(400)], "ordinal bigint, ld double, chi2 double, n double")
    exact = reg.exact_heritability(d, 1e6, 10).first()
    shared = reg.heritability(d.selectExpr("*", "1 as g"), ["g"], 400, 1e6, 10).first()
    assert exact["h2"] == pytest.approx(shared["h2"]) and exact["h2_se"] == pytest.approx(shared["h2_se"])


def test_gene_tables(spark):
    genes = spark.createDataFrame([("e1", "1", 10, 20, 0.001), ("e2", "X", 5, 8, 0.005), ("e3", "2", 1, 3, 0.5)], "GENE string, CHR string, START int, STOP int, P double")
    names = spark.createDataFrame([("e1", "B"), ("e1", "A"), (None, "Z")], "gene_id string, name string")
    assert sorted((r["gene_id"], r["pos"], r["name"]) for r in dn.gene_results(genes, names).collect()) == [("e1", 15.0, "A"), ("e2", 6.5, "e2")]
    assert dn.gene_results(genes, names, None).count() == 3
    places = spark.createDataFrame([("e1", "A", "1", 10, 20), ("e1", "A", "1", 30, 40), ("e2", None, "2", 1, 2)], "gene_id string, name string, chrom string, start int, end int")
    t = spark.createDataFrame([("e1", 0.01), ("e2", 0.5), ("e9", 0.01)], "g string, p double")
    assert [(r["gene_id"], r["pos"]) for r in dn.gene_p_values(t, places, "g", "p").collect()] == [("e1", 15.0)]
    with pytest.raises(ValueError):
        dn.gene_p_values(t, places, "g", "p", "symbol")

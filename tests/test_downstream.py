"""Labelled arrays and downstream tables."""

import numpy as np
import pytest

from varloom.operators import downstream as dn
from varloom.operators import labelled as lb


def test_labelled(spark):
    wide = spark.createDataFrame([("g1", 1.0, 2.0, 3.0), ("g2", 2.0, 4.1, 6.0), ("g3", 3.0, 2.0, 0.9), ("g4", 1.0, 2.1, 2.9)], "gene string, a double, b double, c double")
    cells = wide.transform(lb.from_wide("gene"))
    assert cells.count() == 12
    labels = spark.createDataFrame([("g1", 0.001, 2.0), ("g2", 0.2, 1.0), ("g3", 1e-6, -3.0), ("g4", None, None)], "gene string, p double, z double")
    assert {r["gene"] for r in lb.most_significant(cells, labels, "gene", "p", 2).collect()} == {"g1", "g3"}
    assert {r["gene"] for r in lb.significance_filter(cells, labels, "gene", "p", "z", 0.05).collect()} == {"g1"}
    info = spark.createDataFrame([("g1", "y"), ("g1", "x")], "gene string, note string")
    notes = {r["gene"]: r["note"] for r in lb.annotate(cells, "gene", [info]).collect()}
    assert notes == {"g1": "x", "g2": None, "g3": None, "g4": None}
    order = lb.cluster_order(cells, "gene", "tissue", "value")
    assert order.index("g3") in (0, 3) and sorted(order) == ["g1", "g2", "g3", "g4"]
    with pytest.raises(ValueError):
        lb.cluster_order(cells, "gene", "tissue", "value", "cosine")


def test_leaf_order():
    d = np.array([[0, 1, 9, 8], [1, 0, 9, 8], [9, 9, 0, 2], [8, 8, 2, 0]], float)
    assert lb.leaf_order(d) == [0, 1, 2, 3] and lb.leaf_order(np.zeros((0, 0))) == []


def test_downstream(spark, tmp_path):
    d = spark.createDataFrame([("rs1", 2, 5, 0.1, 0.05, "A", "G", 10), ("rs1", 1, 9, 0.1, 0.05, "A", "G", 10), (None, 1, 1, 0.1, 0.05, "A", "G", 10), ("rs2", 1, 3, 0.1, 0.0, "A", "G", 10)], "rsID string, CHR int, POS int, BETA double, SE double, EA string, NEA string, N int")
    assert [tuple(r) for r in dn.snp_locations(d).collect()] == [("rs2", 1, 3), ("rs1", 1, 9)]
    dn.write_space_separated(dn.snp_locations(d).coalesce(1), str(tmp_path / "o"))
    assert next((tmp_path / "o").glob("part*")).read_text() == "rs2 1 3\nrs1 1 9\n"
    assert [r["Z"] for r in dn.z_table(d, 50).where("RSID = 'rs1'").collect()] == [2.0, 2.0]
    e = spark.createDataFrame([("brain_cortex", 0.01), ("liver", 1e-5)], "Name string, Coefficient_P_value double")
    assert [(r["name"], r["n"]) for r in dn.enrichment_points(e).orderBy("n").collect()] == [("Liver", 0), ("Brain Cortex", 1)]
    bars = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", None)], "FULL_NAME string, P double")
    assert [(r["FULL_NAME"], r["passes"]) for r in dn.top_bars(bars, 2).collect()] == [("b", True), ("a", False)]
    m = dn.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.linalg.eigvalsh(m).min() > -1e-9 and np.allclose(np.diag(m), 1)
    assert dn.submatrix(np.arange(9).reshape(3, 3), [0, 2]).tolist() == [[0, 2], [6, 8]]
    iv = spark.createDataFrame([(0.1, 0.05, 0.01), (0.2, 0.1, 0.01)], "beta_exposure double, beta_outcome double, se_outcome double")
    r = dn.inverse_variance_estimate(iv).first()
    assert r["b"] == pytest.approx(0.5) and r["se"] == pytest.approx(np.sqrt(1 / 500))
    o = dn.overlap_matrix(spark.createDataFrame([("a", "b", 0.3), ("a", "a", 1.2), ("b", "b", 0.9)], "p1 string, p2 string, gcov_int double"), ["a", "b"])
    assert o[0, 1] == pytest.approx(0.3 / np.sqrt(1.2 * 0.9)) and o[0, 0] == 1
    s = spark.createDataFrame([(True, 0.01), (False, 0.01), (True, 0.5)], "steiger_dir boolean, steiger_pval double")
    assert dn.steiger_kept(s, 0.05).count() == 1

"""Operators on small tables with hand-made expectations."""

import math

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from varloom.functions import normal
from varloom.operators import aggregate as agg
from varloom.operators import filters as flt
from varloom.operators import harmonize as har
from varloom.operators import intervals as itv
from varloom.operators import joins as jn
from varloom.operators import multitest as mt
from varloom.operators import project as prj
from varloom.operators import reshape as rsh
from varloom.operators import rows
from varloom.operators import scalar as sca
from varloom.operators import strings as st
from varloom.operators.pipe import composite, identity

NAN = float("nan")


def got(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_normal(spark):
    z = [-8.0, -1.0, 0.0, 0.5, 3.0, 12.0, 37.0]
    d = spark.createDataFrame([(v,) for v in z], "z double")
    for r in normal.with_two_sided(d, "z", "p").withColumn("sf", normal.norm_sf("z")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-10)
        assert r["sf"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-10)
    from statistics import NormalDist

    p = [1e-300, 1e-20, 0.01, 0.3, 0.5, 0.9, 0.0, 1.0, None]
    d = normal.with_quantile(spark.createDataFrame([(v,) for v in p], "p double"), "p", "q")
    for r in d.collect():
        if r["p"] is None or r["p"] in (0.0, 1.0):
            assert r["q"] is None
        else:
            assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-12)


def test_projection(spark):
    d = spark.createDataFrame([(1, 2, "x")], "b bigint, a bigint, c string")
    out = d.transform(composite([identity, prj.rename_column("c", "z"), prj.move_to_front("z"), prj.set_constant("k", 5)]))
    assert out.columns == ["z", "a", "b", "k"]
    assert dict(d.transform(prj.ints_to_int32()).dtypes) == {"b": "int", "a": "int", "c": "string"}
    assert d.transform(prj.rename_by_position(-1, "last")).columns == ["b", "a", "last"]
    assert d.transform(prj.column_specifiers({"POS": "a", "EA": None})).columns == ["POS"]
    for bad in (prj.drop_columns("nope"), prj.rename_column("nope", "x"), prj.select_columns("nope")):
        with pytest.raises(KeyError):
            d.transform(bad)


def test_filters_null_and_nan(spark):
    d = spark.createDataFrame([(1, 0.5), (2, NAN), (3, None), (4, 0.995)], "i int, v double")
    assert got(d.transform(flt.at_least("v", 0.5)).select("i"), "i") == [(1,), (4,)]
    assert got(d.transform(flt.drop_nulls("v")).select("i"), "i") == [(1,), (2,), (4,)]
    assert got(d.transform(flt.drop_nan("v")).select("i"), "i") == [(1,), (4,)]
    assert got(d.transform(flt.any_at_least(0.9, ["i"])).select("i"), "i") == [(4,)]
    assert got(d.where("i <> 2").transform(flt.frequency_filter("v", 0.01, validate=True)).select("i"), "i") == [(1,)]
    with pytest.raises(Exception, match="not within 0..1"):
        spark.createDataFrame([(50.0,)], "v double").transform(flt.frequency_filter("v", 0.01)).collect()
    s = spark.createDataFrame([(1960099,), (1960089,), (1960079,), (1960088,), (1960098,), (1960097,), (None,)], "STATUS int")
    assert sorted(r[0] for r in s.transform(flt.status_digits()).collect()) == [1960079, 1960099]
    assert d.transform(flt.by_values("i", list(range(2, 5000)))).count() == 3
    assert d.transform(flt.by_values("i", [])).count() == 0
    z = spark.createDataFrame([(1.0, 0.0), (1.0, 0.5), (NAN, 0.5), (1.0, float("inf"))], "BETA double, SE double")
    assert z.transform(flt.drop_degenerate_z()).count() == 1
    m = spark.createDataFrame([(6, 25_726_063), (6, 33_400_644), (5, 30_000_000)], "CHR int, POS int")
    assert m.transform(flt.exclude_mhc("38")).count() == 2 and m.transform(flt.exclude_mhc("38", closed=True)).count() == 1
    assert m.transform(flt.exclude_mhc(None)).count() == 3


def test_unique_modes(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "n"), (None, 5, "m")], "k string, o int, v string")
    assert got(d.transform(rows.unique_rows(["k"], "first", ["o"])), "o") == [("a", 1, "x"), ("b", 3, "z"), (None, 4, "n")]
    assert got(d.transform(rows.unique_rows(["k"], "last", ["o"])), "o") == [("a", 2, "y"), ("b", 3, "z"), (None, 5, "m")]
    assert got(d.transform(rows.unique_rows(["k"], "none", ["o"])), "o") == [("b", 3, "z")]
    assert d.transform(rows.unique_rows(["k"])).count() == 3
    with pytest.raises(ValueError):
        rows.unique_rows(["k"], "first")
    assert [r["o"] for r in d.transform(rows.sort_rows(["k", "o"], [True, False])).collect()] == [3, 1, 2, 4, 5]
    with pytest.raises(ValueError):
        rows.sort_rows(["k"], [True, False])


def test_scalar(spark):
    d = spark.createDataFrame([(0.0388, 0.45056), (0.05, 6.5e-18), (0.1, 1.0)], "BETA double, P double")
    se = [r["SE"] for r in d.transform(sca.se_from_p()).collect()]
    assert se[0] == pytest.approx(0.05142602, rel=1e-4) and se[1] > 0 and se[2] is None
    c = [sca.Cohort("a", 1000, 4000), sca.Cohort("b", 500, 500)]
    s = spark.createDataFrame([("+?",), ("?-",), ("+-",), ("??",)], "Cohorts string")
    assert [r["N"] for r in s.transform(sca.effective_n_from_cohorts(c, "Cohorts")).collect()] == [3200, 1000, 4200, 0]
    a = spark.createDataFrame([("n", 25.0, 5.0), ("m", None, 5.0), ("k", None, None)], "nm string, a double, b double")
    assert [r["Average"] for r in a.transform(sca.row_average(["nm"])).collect()] == [15.0, 5.0, None]
    assert got(a.transform(sca.winsorize(10.0, ["nm"]))) == [("n", 10.0, 5.0), ("m", None, 5.0), ("k", None, None)]
    r = spark.createDataFrame([(1.0, 1.1), (1.5, 1.1), (1.5, 0.9)], "m double, i double").transform(sca.attenuation_ratio("m", "i")).collect()
    assert math.isnan(r[0]["ratio"]) and r[1]["ratio"] == pytest.approx(0.2) and math.isnan(r[2]["ratio"])
    with pytest.raises(ValueError):
        d.transform(sca.beta_from_odds_ratio())
    assert d.transform(sca.beta_from_odds_ratio(if_needed=True)).columns == d.columns
    p = spark.createDataFrame([(1e-300,), (None,)], "P double").transform(sca.mlog10p_if_needed()).collect()
    assert p[0]["MLOG10P"] == pytest.approx(250) and p[1]["MLOG10P"] is None


def test_strings(spark):
    d = spark.createDataFrame([("A.b", None), ("x.y.z", "q"), (None, "r")], "s string, t string")
    assert [r["j"] for r in d.transform(st.concatenate(["s", "t"], "-", "j")).collect()] == ["A.b", "x.y.z-q", "r"]
    assert [r["j"] for r in d.transform(st.concatenate(["s", "t"], "-", "j", ignore_nulls=False)).collect()] == [None, "x.y.z-q", None]
    assert got(d.transform(st.split_to_columns("s", ".", ["a", "b", "c"])).select("a", "b", "c")) == [("A", "b", None), ("x", "y", "z"), (None, None, None)]
    assert d.transform(st.split_to_list("s", ".", "l")).transform(st.unnest("l")).count() == 6
    assert [r["u"] for r in d.transform(st.replace_pattern("s", "u", r"\.", "$")).collect()] == ["A$b", "x$y$z", None]
    assert [r["u"] for r in d.transform(st.replace_first("s", "u", r"\.", "")).collect()] == ["Ab", "xy.z", None]
    v = spark.createDataFrame([(NAN,), (1.5,)], "col double")
    assert [r["o"] for r in v.transform(st.replace_values("col", "o", {NAN: 1.0}, F.col("col"))).collect()] == [1.0, 1.5]
    with pytest.raises(PySparkException):
        v.transform(st.replace_values("col", "o", {2.0: 1.0})).collect()
    n = spark.createDataFrame([("0.25",), ("abc",), (None,), ("1234.5678",)], "n string")
    assert [r["n"] for r in n.transform(st.format_numbers("n", ".1f")).collect()] == ["0.2", "abc", None, "1234.6"]
    assert [r["n"] for r in n.transform(st.format_numbers("n", ".3g")).collect()] == ["0.25", "abc", None, "1.23e+03"]
    e = spark.createDataFrame([("cluster 12 x",), ("none",)], "c string").transform(st.extract_pattern("c", "k", "cluster ([0-9]+)", "int")).collect()
    assert [r["k"] for r in e] == [12, None]


def test_reshape(spark):
    d = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "x", 3)], "i string, o string, v int")
    wide = d.transform(rsh.pivot("o", ["i"], ["v"]))
    assert got(wide, "i") == [("g", 1, 2), ("h", 3, None)]
    with pytest.raises(PySparkException):
        d.union(d).transform(rsh.pivot("o", ["i"], ["v"])).collect()
    assert got(wide.transform(rsh.unpivot(["i"])).where("value is not null"), "i", "variable") == [("g", "x", 1), ("g", "y", 2), ("h", "x", 3)]
    assert got(wide.transform(rsh.transpose("i")), "index") == [("x", 1, 3), ("y", 2, None)]
    assert got(d.transform(rsh.indicator_matrix("o", "i")), "o") == [("x", 1, 1), ("y", 1, 0)]


def test_joins(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, v int")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "key int, v string")
    assert got(jn.join_tables(a, b, "inner", ["k"], ["key"]), "v_right") == [(1, 10, "p"), (1, 10, "q")]
    assert jn.join_tables(a, b, "left", ["k"], ["key"]).count() == 4
    assert sorted(r["k"] for r in jn.join_tables(a, b, "full", ["k"], ["key"]).collect() if r["k"]) == [1, 1, 2, 3]
    assert got(a.transform(jn.join_memory_table(pd.DataFrame({"key": [2], "n": ["two"]}), ["k"], ["key"]))) == [(2, 20, "two")]
    assert jn.semi_filter(a, b, "k", "key").count() == 1
    with pytest.raises(ValueError):
        jn.concat_tables([a, b])
    assert jn.concat_tables([a, a.withColumn("v", F.col("v").cast("string"))], casts={"v": "int"}).count() == 6
    one, two = (spark.createDataFrame([(x,) for x in s], "g string") for s in ("ABCA", "BCD"))
    assert got(jn.combine_lists({"one": (one, "g"), "two": (two, "g")}), "gene") == [("A", ["one"]), ("B", ["one", "two"]), ("C", ["one", "two"]), ("D", ["two"])]
    assert dict(got(jn.set_combinations({"one": (one, "g"), "two": (two, "g")}))) == {"one": 1, "one&two": 2, "two": 1}
    ids = jn.with_row_id(spark.createDataFrame([(2, 5), (1, 9), (1, 3), (None, 1)], "CHR int, POS int"), ["POS"])
    assert got(ids, "row_id") == [(None, 1, 0), (1, 3, 1), (1, 9, 2), (2, 5, 3)]


GWAS = [("rs1", 1, 10, "A", "G", 0.5), ("rs2", 1, 20, "C", "T", 0.1), ("rs3", 1, 30, "G", "A", 0.2), ("rs4", 1, 40, "A", "T", 0.3), ("rs5", 1, 50, "A", "C", 0.4), ("rs6", 1, 60, "A", "C", 0.6)]
REF = [("rs1", 1, 10, "G", "A"), ("rs3", 1, 30, "G", "A"), ("rs4", 1, 40, "A", "T"), ("rs5", 1, 50, "A", "G"), ("rs6", 1, 61, "A", "C")]


def test_harmonise(spark):
    g = spark.createDataFrame(GWAS, "rsID string, CHR int, POS int, EA string, NEA string, BETA double")
    r = spark.createDataFrame(REF, "rsID string, CHR int, POS int, EA string, NEA string")
    want = [("rs1", 1, 10, "G", "A", -0.5), ("rs3", 1, 30, "G", "A", 0.2)]
    assert got(har.via_rsid(g, r, validate=True), "rsID") == want
    assert got(har.via_alleles(g.drop("rsID"), r, validate=True).select("rsID", "CHR", "POS", "EA", "NEA", "BETA"), "rsID") == want
    assert har.via_alleles(g, r, palindromes="keep").count() == 3
    with pytest.raises(ValueError):
        har.via_rsid(g, r, palindromes="resolve")
    with pytest.raises(ValueError):
        har.via_rsid(g, r, alleles="raise")
    with pytest.raises(ValueError):
        har.check_unique(g.union(g), ["rsID"])
    for call in (lambda: har.via_rsid(g.union(g), r), lambda: har.via_rsid(g, r.union(r)), lambda: har.via_alleles(g.union(g), r), lambda: har.via_alleles(g, r.union(r))):
        with pytest.raises(Exception, match="repeat"):
            call().collect()
    both = r.union(r.select("rsID", "CHR", "POS", F.col("NEA").alias("EA"), F.col("EA").alias("NEA")))
    assert har.via_alleles(g, both, palindromes="keep").count() == 6
    f = spark.createDataFrame([("A", "C", 0.1, 2.0, 0.3)], "EA string, NEA string, BETA double, OR double, EAF double").transform(har.flip()).first()
    assert tuple(f) == ("C", "A", -0.1, 0.5, 0.7)
    assert [r[0] for r in spark.createDataFrame([("AC", "GT"), ("A", "T"), ("A", "C")], "EA string, NEA string").select(har.is_palindromic()).collect()] == [True, True, False]


def test_meta_analysis(spark):
    a = spark.createDataFrame([(1, 10, "A", "G", 0.2, 0.1, "rs1"), (1, 20, "C", "T", 0.1, 0.1, "rs2")], "CHR int, POS int, EA string, NEA string, BETA double, SE double, rsID string")
    b = spark.createDataFrame([(1, 10, "G", "A", -0.4, 0.1)], "CHR int, POS int, EA string, NEA string, BETA double, SE double")
    m = har.meta_analysis([a, b], validate=True).collect()
    assert len(m) == 1 and (m[0]["EA"], m[0]["rsID"], m[0]["n_flipped"]) == ("A", "rs1", 1)
    assert m[0]["BETA"] == pytest.approx(0.3) and m[0]["SE"] == pytest.approx(0.1 / math.sqrt(2))
    with pytest.raises(ValueError):
        har.meta_analysis([a])
    with pytest.raises(Exception, match="above 0"):
        har.meta_analysis([a, b.withColumn("SE", F.lit(0.0))]).collect()
    with pytest.raises(Exception, match="twice"):
        har.meta_analysis([a.union(a), b]).collect()
    with pytest.raises(Exception, match="twice"):
        har.meta_analysis([a, b.union(b.select("CHR", "POS", F.col("NEA").alias("EA"), F.col("EA").alias("NEA"), "BETA", "SE"))]).collect()
    assert har.meta_analysis([a, b], effective_n=[1000.0, 250.5]).first()["N_EFF"] == 1250.5
    with pytest.raises(ValueError):
        har.meta_analysis([a, b], effective_n=[1.0])


def test_index_and_alignment(spark):
    t = spark.createDataFrame([(1, "1:100:A:G:i", "A", "G"), (1, "1:50:A:T:i", "A", "T"), (2, "2:70:C:T:i", "C", "T"), (2, "2:90:C:A:i", "C", "A")], "CHROM int, ID string, ALLELE0 string, ALLELE1 string")
    m = spark.createDataFrame([(1, 100, "A", "G", "rs1"), (1, 50, "A", "T", "rs2"), (2, 70, "C", "T", "rs3"), (2, 91, "C", "A", "rs4")], "CHR int, POS int, EA string, NEA string, rsID string")
    index = jn.build_variant_index(t, m)
    assert got(index.select("row_id", "rsID", "EA", "is_strand_ambiguous"), "row_id") == [(0, "rs2", "T", True), (1, "rs1", "G", False), (2, "rs3", "T", False)]
    p = spark.createDataFrame([(1, 100, "A", "G", 0.5, 0.1), (2, 70, "T", "C", 0.3, 0.1)], "CHR int, POS int, EA string, NEA string, BETA double, SE double")
    a = got(jn.align_to_index(index, p).select("row_id", "BETA"), "row_id")
    assert math.isnan(a[0][1]) and a[1][1] == pytest.approx(-0.5) and a[2][1] == pytest.approx(0.3, rel=1e-6)
    c = spark.createDataFrame([(0, "rs1", "A", "G"), (1, "rs2", "A", "G"), (2, "rs3", "A", "G"), (3, "rs4", "A", "G")], "row_id int, rsID string, EA string, NEA string")
    tr = spark.createDataFrame([("rs1", "A", "G", 0.2, 0.1, 5.0), ("rs2", "G", "A", 0.2, 0.1, 5.0), ("rs3", "A", "C", 0.2, 0.1, 5.0)], "rsID string, EA string, NEA string, BETA double, SE double, N double")
    assert [r["z"] for r in jn.align_trait(c, tr).orderBy("row_id").collect()] == [2.0, -2.0, None, None]
    with pytest.raises(ValueError):
        jn.align_trait(c, tr, least=3)


def test_multiple_testing(spark):
    d = spark.createDataFrame([(0, 1e-6), (1, 0.05), (2, 1.0)], "i int, p double")
    assert [r["reject_null"] for r in d.transform(mt.reject_column("p")).orderBy("i").collect()] == [True, False, False]
    t = spark.createDataFrame([(i, v) for i, v in enumerate([0.02, 0.02, 1.0, 1.0, 1.0])], "i int, p double")
    assert t.transform(mt.corrected_table("p")).count() == 2
    assert t.transform(mt.corrected_table("p", method="bonferroni")).count() == 0
    import random

    rng = random.Random(3)
    ps = [rng.random() ** 3 for _ in range(500)] + [0.01] * 20 + [None, NAN]
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None and not math.isnan(p))
    for method, c in (("fdr_bh", 1.0), ("fdr_by", sum(1 / i for i in range(1, len(known) + 1)))):
        want, low = {}, 1.0
        for k in range(len(known), 0, -1):
            low = min(low, known[k - 1][0] * len(known) * c / k)
            want[known[k - 1][1]] = low
        out = spark.createDataFrame(list(enumerate(ps)), "i int, p double").repartition(3).transform(mt.corrected_p("p", method)).collect()
        assert len(out) == len(ps)
        for r in out:
            assert (r["p_corrected"] is None) == (r["i"] not in want)
            if r["i"] in want:
                assert r["p_corrected"] == pytest.approx(want[r["i"]], rel=1e-12)
    assert d.limit(0).transform(mt.corrected_p("p")).count() == 0


def test_aggregates(spark):
    d = spark.createDataFrame([("g", "m1", 0.01), ("g", "m2", 0.2), ("g", "m3", None), ("h", "m1", 0.5)], "g string, m string, p double")
    a = {r["g"]: r for r in d.transform(agg.acat(["g"], "p", "m")).collect()}
    t = sum(math.tan((0.5 - p) * math.pi) for p in (0.01, 0.2)) / 2
    assert a["g"]["acat_p"] == pytest.approx(0.5 - math.atan(t) / math.pi) and a["g"]["n_models"] == 2 and a["g"]["models_used"] == "m1,m2,m3"
    r = agg.with_rank_max(spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3)], "k string, v int"), ["k"], "v", "r")
    assert sorted(x["r"] for x in r.collect()) == [1, 3, 3, 4]
    c = spark.createDataFrame([("o1", "A", 0.2, 0.1), ("o2", "A", 0.4, 0.2), ("o3", "B", 0.1, 0.1)], "oid string, gene string, rg double, rg_se double")
    k = {x["oid"]: x for x in c.transform(agg.collapse_assays({"o1": "P", "o2": "P"})).collect()}
    w = [1 / 0.01, 1 / 0.04]
    assert k["P"]["rg"] == pytest.approx((0.2 * w[0] + 0.4 * w[1]) / sum(w)) and k["P"]["rg_se"] == pytest.approx((10 + 5) / sum(w)) and k["P"]["n_assays"] == 2
    j = agg.jaccard_pairs(spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 2), ("y", 3), ("z", None)], "s string, i int"), "s", "i").collect()
    assert [tuple(x) for x in j] == [("x", "y", 1, 3, 1 / 3)]
    f = agg.full_correlation_table(spark.createDataFrame([("a", "b", 0.5, 0.1), ("a", "c", 0.2, 0.2), ("b", "c", 0.1, 0.3)], "p1 string, p2 string, rg double, p double"))
    assert f.count() == 9 and f.where("p1 = p2").agg(F.sum("rg")).first()[0] == 3.0
    cells = [(t, f"{t}{i}", g, v) for t, vs in {"n": {"g1": (5, 7), "g2": (0, 0)}, "m": {"g1": (1, 1), "g2": (4, 6)}}.items() for g, v2 in vs.items() for i, v in enumerate(v2)]
    e = spark.createDataFrame(cells, "t string, cell string, gene string, count int")
    s = {(x["gene"], x["t"]): x["specificity"] for x in e.transform(agg.specificity_fraction("t", "count", "gene", "cell")).collect()}
    assert s["g1", "n"] == pytest.approx(6 / 7) and s["g2", "m"] == 1.0
    stab = {(x["gene"], x["t"]): x["specificity"] for x in e.transform(agg.specificity_stability("t", "count", "gene", "cell", validate=True)).collect()}
    assert stab["g1", "n"] > stab["g1", "m"] or stab["g2", "m"] > stab["g2", "n"]
    with pytest.raises(ValueError):
        agg.check_not_sparse(e.limit(3), "cell", "gene")
    assert agg.forward_select(["a", "b", "c"], {("a", "b"): 0.9, ("b", "a"): 0.2, ("a", "c"): 0.8, ("c", "a"): 0.8}) == ["a", "c"]
    assert agg.k_centre(["a", "b", "c", "d"], {("a", "b"): 0.9, ("a", "c"): 0.1, ("a", "d"): 0.2, ("c", "d"): 0.9}, ["a"], 3) == ["a", "c", "b"]


def test_intervals(spark):
    p = spark.createDataFrame([(1, 100), (1, 1_999_999), (2, 100)], "CHR int, POS int")
    r = spark.createDataFrame([(1, 50, 2_000_000, "g"), (1, 90, 110, "h"), (2, 101, 200, "i")], "chrom int, start int, end int, gene string")
    assert sorted((x["CHR"], x["POS"], x["gene"]) for x in itv.points_in_ranges(p, r).collect()) == [(1, 100, "g"), (1, 100, "h"), (1, 1_999_999, "g")]
    assert itv.points_in_ranges(p, r, window=1).count() == 4
    assert {(x["POS"], x["gene"]) for x in itv.best_range(p, r, ["CHR", "POS"]).collect()} == {(100, "g"), (1_999_999, "g")}
    c = spark.createDataFrame([("X", "5", "9"), ("1;1", "1", "2"), ("7", "a", "2"), ("Y", "1", "2")], "`Gene CHROM` string, `Gene start` string, `Gene end` string")
    assert [(x["chrom"], x["start"]) for x in itv.gene_coordinates(c).collect()] == [(23, 5)]
    v = spark.createDataFrame([(1, 10, 1e-9), (1, 400_000, 1e-10), (1, 5_000_000, 1e-9), (2, 7, 1e-3)], "CHR int, POS int, P double")
    assert got(itv.lead_variants(v).select("POS", "locus_variants"), "POS") == [(400_000, 2), (5_000_000, 1)]
    m = itv.manhattan_positions(v)
    assert {(x["POS"], x["x"]) for x in m.collect()} == {(10, 10), (400_000, 400_000), (5_000_000, 5_000_000), (7, 5_000_007)}


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a")], "x int, y int, z string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).transform(composite([flt.at_least("x", 1), prj.select_columns("x")]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,1)" in plan and "ReadSchema: struct<x:int>" in plan


def test_jaccard_of_disjoint_sets(spark):
    d = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "s string, i int")
    got = sorted(tuple(r) for r in agg.jaccard_pairs(d, "s", "i").collect())
    assert got == [("x", "y", 1, 1, 1.0), ("x", "z", 0, 2, 0.0), ("y", "z", 0, 2, 0.0)]

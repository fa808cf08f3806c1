"""Registered queries of the core library, each over its whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.normal import with_two_sided
from varloom.operators import aggregate as agg
from varloom.operators import causality
from varloom.operators import downstream as dn
from varloom.operators import filters as flt
from varloom.operators import harmonize as har
from varloom.operators import intervals as itv
from varloom.operators import joins as jn
from varloom.operators import labelled as lab
from varloom.operators import multitest as mt
from varloom.operators import project as prj
from varloom.operators import regress as reg
from varloom.operators import reshape as rsh
from varloom.operators import rows
from varloom.operators import scalar as sca
from varloom.operators import strings as st
from varloom.operators.pipe import composite
from varloom.session import table
from varloom.sources import rejects
from varloom.sources import tables as src
from varloom.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Derived views, written alike for both engines.


def gwas(spark: SparkSession, sf: str) -> DataFrame:
    """The summary statistics under their canonical names, alleles in capitals."""
    return table(spark, sf, "dummy_processed_gwas").select(
        "row_id", "study_id", F.col("snpid").alias("SNPID"), F.col("chr").alias("CHR"), F.col("pos").alias("POS"), F.upper("ea").alias("EA"), F.upper("nea").alias("NEA"), F.col("eaf").alias("EAF"),
        F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("chisq").alias("CHISQ"), F.col("mlog10p").alias("MLOG10P"), F.col("n").alias("N"), F.col("status").alias("STATUS"), "release_day",
    )


G = """g AS (SELECT row_id, study_id, snpid AS "SNPID", chr AS "CHR", pos AS "POS", upper(ea) AS "EA", upper(nea) AS "NEA", eaf AS "EAF", beta AS "BETA", se AS "SE",
chisq AS "CHISQ", mlog10p AS "MLOG10P", n AS "N", status AS "STATUS", release_day FROM dummy_processed_gwas)"""


def half(spark: SparkSession, sf: str, early: bool) -> DataFrame:
    """One summary table per variant from all studies released before (from) 2024, by inverse variance; the later one has every second variant turned."""
    g = gwas(spark, sf).where("EA is not null and NEA is not null and BETA is not null and SE > 0 and not isnan(SE) and not isnan(BETA)")
    g = g.where(F.col("release_day") < "2024-01-01") if early else g.where(F.col("release_day") >= "2024-01-01")
    turned = F.col("EA") < F.col("NEA")
    w = 1 / (F.col("SE") * F.col("SE"))
    h = g.groupBy("CHR", "POS", F.least("EA", "NEA").alias("lo"), F.greatest("EA", "NEA").alias("hi")).agg(
        F.min("SNPID").alias("rsID"), (F.sum(F.when(turned, -F.col("BETA")).otherwise(F.col("BETA")) * w) / F.sum(w)).alias("b"), F.sqrt(1 / F.sum(w)).alias("SE"), F.sum("N").cast("double").alias("N"),
    )
    back = F.lit(False) if early else F.col("POS") % 2 == 0
    return h.select("CHR", "POS", F.when(back, F.col("lo")).otherwise(F.col("hi")).alias("EA"), F.when(back, F.col("hi")).otherwise(F.col("lo")).alias("NEA"), "rsID", F.when(back, -F.col("b")).otherwise(F.col("b")).alias("BETA"), "SE", "N")


def _half_sql(early: bool) -> str:
    back = "false" if early else '"POS" % 2 = 0'
    return f"""(SELECT "CHR", "POS", CASE WHEN {back} THEN lo ELSE hi END AS "EA", CASE WHEN {back} THEN hi ELSE lo END AS "NEA", "rsID", CASE WHEN {back} THEN -b ELSE b END AS "BETA", "SE", "N" FROM (
SELECT chr AS "CHR", pos AS "POS", least(upper(ea), upper(nea)) AS lo, greatest(upper(ea), upper(nea)) AS hi, min(snpid) AS "rsID",
sum(CASE WHEN upper(ea) < upper(nea) THEN -beta ELSE beta END / (se * se)) / sum(1 / (se * se)) AS b, sqrt(1 / sum(1 / (se * se))) AS "SE", CAST(sum(n) AS DOUBLE) AS "N"
FROM dummy_processed_gwas WHERE ea IS NOT NULL AND nea IS NOT NULL AND beta IS NOT NULL AND se > 0 AND NOT isnan(se) AND NOT isnan(beta) AND release_day {"<" if early else ">="} DATE '2024-01-01' GROUP BY ALL))"""


A, B = f"a AS {_half_sql(True)}", f"b AS {_half_sql(False)}"
REV = "reverse(translate({}, 'ACGT', 'TGCA'))"



def tail_sql(z: str) -> str:
    """Two-sided normal p-value of z in SQL, by the power series below 3 and the continued fraction of the tail above: no coefficient is shared with the library."""
    d = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"
    series = f"list_sum(list_transform(range(0, 60), lambda i: pow(abs({z}), 2 * i + 1) * sqrt(pi()) / (pow(2.0, i + 1) * gamma(i + 1.5))))"
    fraction = f"list_reduce([abs({z})::DOUBLE] || list_transform(range(60, 0, -1), lambda i: i::DOUBLE), lambda a, i: abs({z}) + i / a)"
    return f"(CASE WHEN abs({z}) < 3 THEN 1 - 2 * {d} * {series} ELSE 2 * {d} / {fraction} END)"


# Loading delimited lines.


_LINE = r"""f AS (SELECT line_id, t, regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound,
length(regexp_replace(t, '(?s)"(?:[^"]|"")*"|[^,]', '', 'g')) + 1 AS fields FROM (SELECT line_id, regexp_replace(coalesce(line_text, ''), '\r\z', '') AS t FROM raw_gwas_lines)),
v AS (SELECT *, {0} FROM f), w AS (SELECT *, {1} FROM v),
c AS (SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN fields <> 12 THEN 'column_count' WHEN {2} THEN 'invalid_value' END AS reason FROM w)"""


def _line_sql() -> str:
    cut = r"""trim(replace(CASE WHEN starts_with({0}, '"') THEN substr({0}, 2, length({0}) - 2) ELSE {0} END, '""', '"'), ' ' || chr(9))"""
    field = r"""regexp_extract(t, '(?s)^(?:(?:"(?:[^"]|"")*"|[^",]*),){{{0}}}("(?:[^"]|"")*"|[^",]*)', 1)"""
    wrong = r"""({0} NOT IN ('', 'NA', '.') AND (NOT regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') OR NOT coalesce(isfinite(TRY_CAST({0} AS DOUBLE)), false){1}))"""
    values = {"eaf": " OR TRY_CAST(eaf AS DOUBLE) NOT BETWEEN 0 AND 1", "beta": "", "se": " OR TRY_CAST(se AS DOUBLE) <= 0"}
    return _LINE.format(
        ", ".join(f"{field.format(5 + k)} AS r_{n}" for k, n in enumerate(values)), ", ".join(f"{cut.format(f'r_{n}')} AS {n}" for n in values), " OR ".join(wrong.format(n, more) for n, more in values.items())
    )


@query(f"WITH {_line_sql()} SELECT line_id, reason FROM c WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected_lines(table(spark, sf, "raw_gwas_lines"))


@query()
def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The typed rows of the lines that load."""
    return rejects.loaded_rows(table(spark, sf, "raw_gwas_lines"))


@query(f"WITH {_line_sql()} SELECT reason, count(*) AS n_lines FROM c GROUP BY reason")
def p3_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per reason; null is a line that loads."""
    return rejects.split_lines(table(spark, sf, "raw_gwas_lines")).groupBy("reason").agg(F.count("*").alias("n_lines"))


@query()
def p3_reader_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by what the reader said and what the exact rule makes of it."""
    return rejects.split_lines(table(spark, sf, "raw_gwas_lines")).groupBy("reader_reason", "reason").agg(F.count("*").alias("n_lines"))


# Projection.


@query(f"""WITH {G} SELECT "BETA" * 2.0 AS "BETA", 'gwas' AS kind, "EA" AS effect_allele, "POS" FROM g""")
def q_project(spark, sf):
    pipes = [prj.select_columns("POS", "EA", "BETA", "SE"), prj.drop_columns("SE"), prj.rename_column("EA", "effect_allele"), prj.set_constant("kind", "gwas"), prj.scale_column("BETA", 2.0), prj.move_to_front("POS")]
    return gwas(spark, sf).transform(composite(pipes))


@query("SELECT r_regionkey AS k, r_name FROM region")
def q_rename_by_position(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", "r_name").transform(prj.rename_by_position(0, "k"))


@query("SELECT row_id, CAST(n AS INTEGER) AS n, round(CAST(CAST(beta AS FLOAT) AS DOUBLE), 5) AS beta FROM dummy_processed_gwas")
def q_narrow_types(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").select(F.col("row_id"), F.col("n"), "beta").transform(prj.floats_to_float32())
    d = d.select("row_id", "n", "beta").transform(prj.cast_column("n", "int"))
    return d.select("row_id", "n", F.round(F.col("beta").cast("double"), 5).alias("beta"))


@query("SELECT chr AS \"CHR\", pos AS \"POS\", ea AS \"EA\", nea AS \"NEA\", beta AS \"BETA\" FROM dummy_processed_gwas")
def q_column_specifiers(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(prj.column_specifiers({"CHR": "chr", "POS": "pos", "EA": "ea", "NEA": "nea", "BETA": "beta", "INFO": None}))


# Filters.


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_value_filter(spark, sf):
    return table(spark, sf, "orders").transform(flt.by_values("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("SELECT row_id, chisq FROM dummy_processed_gwas WHERE chisq >= 3.84 AND NOT isnan(chisq)")
def q_min_filter(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(flt.at_least("chisq", 3.84)).select("row_id", "chisq")


@query("SELECT row_id, eaf, mlog10p FROM dummy_processed_gwas WHERE (eaf >= 0.9 AND NOT isnan(eaf)) OR (mlog10p >= 0.9 AND NOT isnan(mlog10p))")
def q_any_min_filter(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "eaf", "mlog10p").transform(flt.any_at_least(0.9, ["row_id"]))


@query("SELECT row_id FROM dummy_processed_gwas WHERE ea IS NOT NULL AND eaf IS NOT NULL AND n IS NOT NULL")
def q_drop_nulls(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(flt.drop_nulls("ea", "eaf", "n")).select("row_id")


@query("SELECT row_id, chisq, mlog10p FROM dummy_processed_gwas WHERE chisq IS NOT NULL AND mlog10p IS NOT NULL AND NOT isnan(chisq) AND NOT isnan(mlog10p)")
def q_drop_nan(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(flt.drop_nan("chisq", "mlog10p")).select("row_id", "chisq", "mlog10p")


@query("SELECT row_id, eaf FROM dummy_processed_gwas WHERE least(eaf, 1 - eaf) >= 0.05 AND NOT isnan(eaf)")
def q_maf_filter(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(flt.frequency_filter("eaf", 0.05, validate=True)).select("row_id", "eaf")


@query(f"""WITH {G} SELECT row_id, "CHR", "POS" FROM g WHERE NOT ("CHR" = 6 AND "POS" >= 25726063 AND "POS" < 33400644)""")
def q_exclude_mhc(spark, sf):
    return gwas(spark, sf).transform(flt.exclude_mhc("38")).select("row_id", "CHR", "POS")


@query(f"""WITH {G} SELECT row_id FROM g WHERE "BETA" IS NOT NULL AND "SE" IS NOT NULL AND isfinite("BETA") AND isfinite("SE") AND "SE" > 0""")
def q_degenerate_z(spark, sf):
    return gwas(spark, sf).transform(flt.drop_degenerate_z()).select("row_id")


@query(f"""WITH {G} SELECT row_id, "STATUS" FROM g WHERE NOT (substr(CAST("STATUS" AS VARCHAR), 5, 1) IN ('3', '4') OR substr(CAST("STATUS" AS VARCHAR), 1, 1) IN ('9'))""")
def q_status_digits(spark, sf):
    return gwas(spark, sf).transform(flt.status_digits(drop={5: "34", 1: "9"})).select("row_id", "STATUS")


@query(f"""WITH {G} SELECT row_id, "STATUS" FROM g WHERE NOT (substr(CAST("STATUS" AS VARCHAR), 6, 1) = '8' OR substr(CAST("STATUS" AS VARCHAR), 7, 1) IN ('7', '8'))""")
def q_status_digits_default(spark, sf):
    return gwas(spark, sf).transform(flt.status_digits()).select("row_id", "STATUS")


# Rows.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_sort_top(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").transform(composite([rows.sort_rows(["o_totalprice", "o_orderkey"], [True, False]), flt.head(100)]))


_KEYS = '"CHR", "POS", "EA", "NEA"'


@query(f"""WITH {G} SELECT * EXCLUDE rn FROM (SELECT {_KEYS}, row_id, row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_id) AS rn FROM g) WHERE rn = 1""")
def q_unique_first(spark, sf):
    return gwas(spark, sf).select("CHR", "POS", "EA", "NEA", "row_id").transform(rows.unique_rows(["CHR", "POS", "EA", "NEA"], "first", ["row_id"]))


@query(f"""WITH {G} SELECT * EXCLUDE rn FROM (SELECT {_KEYS}, row_id, row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_id DESC) AS rn FROM g) WHERE rn = 1""")
def q_unique_last(spark, sf):
    return gwas(spark, sf).select("CHR", "POS", "EA", "NEA", "row_id").transform(rows.unique_rows(["CHR", "POS", "EA", "NEA"], "last", ["row_id"]))


@query(f"""WITH {G} SELECT study_id, "SNPID", row_id FROM (SELECT study_id, "SNPID", row_id, count(*) OVER (PARTITION BY study_id, "SNPID") AS m FROM g) WHERE m = 1""")
def q_unique_none(spark, sf):
    return gwas(spark, sf).select("study_id", "SNPID", "row_id").transform(rows.unique_rows(["study_id", "SNPID"], "none", ["row_id"]))


@query('SELECT DISTINCT study_id, snpid FROM dummy_processed_gwas')
def q_unique_any(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("study_id", "snpid").transform(rows.unique_rows(["study_id", "snpid"]))


# Scalar statistics.


@query("SELECT row_id, greatest(beta, 0.0) AS beta_floor FROM dummy_processed_gwas")
def q_row_max(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(sca.max_with_constant("beta", 0.0, "beta_floor")).select("row_id", "beta_floor")


@query("""SELECT row_id, round((coalesce(eaf, 0) + coalesce(beta, 0) + coalesce(se, 0)) / nullif((eaf IS NOT NULL)::INT + (beta IS NOT NULL)::INT + (se IS NOT NULL)::INT, 0), 9) AS "Average" FROM dummy_processed_gwas""")
def q_row_mean(spark, sf):
    return rounded(table(spark, sf, "dummy_processed_gwas").select("row_id", "eaf", "beta", "se").transform(sca.row_average(["row_id"])).select("row_id", "Average"), "Average", digits=9)


@query("SELECT event_id, round(ln(value + 1) / ln(2.0), 6) AS value FROM events")
def q_shifted_log(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("value")).transform(sca.shifted_log(2, ["value"])), "value")


@query("SELECT l_orderkey, CASE WHEN l_quantity > 40 THEN 40.0 ELSE CAST(l_quantity AS DOUBLE) END AS l_quantity, l_linenumber FROM lineitem")
def q_winsorize(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"), "l_linenumber").transform(sca.winsorize(40.0, ["l_orderkey", "l_linenumber"]))


@query("SELECT row_id, round(ln(exp(beta)), 9) AS \"BETA\" FROM dummy_processed_gwas")
def q_beta_from_or(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").select("row_id", F.exp("beta").alias("OR")).transform(sca.beta_from_odds_ratio())
    return rounded(d.select("row_id", "BETA"), "BETA", digits=9)


@query("SELECT row_id, round(pow(10.0, -mlog10p), 8) AS \"P\" FROM dummy_processed_gwas WHERE NOT isnan(mlog10p)")
def q_p_from_mlog10p(spark, sf):
    return rounded(gwas(spark, sf).transform(flt.drop_nan("MLOG10P")).transform(sca.p_from_mlog10p()).select("row_id", "P"), "P", digits=8)


@query("SELECT row_id, round(abs(log10(greatest(pow(10.0, -mlog10p), 1e-250))), 9) AS \"MLOG10P\" FROM dummy_processed_gwas WHERE NOT isnan(mlog10p)")
def q_mlog10p(spark, sf):
    d = gwas(spark, sf).transform(flt.drop_nan("MLOG10P")).transform(sca.p_from_mlog10p()).drop("MLOG10P").transform(sca.mlog10p_if_needed())
    return rounded(d.select("row_id", F.abs("MLOG10P").alias("MLOG10P")), "MLOG10P", digits=9)


@query(f"""SELECT row_id, round({tail_sql("(beta / se)")}, 8) AS "P" FROM dummy_processed_gwas WHERE beta IS NOT NULL AND se > 0""")
def q_p_from_beta_se(spark, sf):
    d = gwas(spark, sf).where("BETA is not null and SE > 0").transform(sca.p_from_beta_se_if_needed())
    return rounded(d.select("row_id", "P"), "P", digits=8)


@query("""SELECT row_id, CASE WHEN pow(10.0, -mlog10p) > 0 THEN round(pow(10.0, -mlog10p), 7) END AS p_again FROM dummy_processed_gwas WHERE mlog10p > 0.001 AND NOT isnan(mlog10p) AND beta IS NOT NULL AND beta <> 0""")
def q_se_from_p(spark, sf):
    """The p-value that BETA and the standard error made from it give again: the one the error was made from."""
    d = gwas(spark, sf).where("MLOG10P > 0.001 and not isnan(MLOG10P) and BETA is not null and BETA <> 0").drop("SE").transform(sca.p_from_mlog10p()).transform(sca.se_from_p())
    return rounded(with_two_sided(d, "(BETA / SE)", "p_again").select("row_id", "p_again"), "p_again", digits=7)


@query("""WITH t AS (SELECT study_id, avg(chisq) AS mean_chi, 1 + avg(abs(beta)) AS intercept FROM dummy_processed_gwas WHERE chisq IS NOT NULL AND NOT isnan(chisq) GROUP BY study_id)
SELECT study_id, round(CASE WHEN mean_chi >= 1.02 AND intercept >= 1 THEN (intercept - 1) / (mean_chi - 1) END, 6) AS ratio FROM t""")
def q_attenuation(spark, sf):
    t = table(spark, sf, "dummy_processed_gwas").transform(flt.drop_nan("chisq")).groupBy("study_id").agg(F.avg("chisq").alias("mean_chi"), (1 + F.avg(F.abs("beta"))).alias("intercept"))
    return t.transform(sca.attenuation_ratio("mean_chi", "intercept")).select("study_id", F.round(F.nanvl("ratio", F.lit(None).cast("double")), 6).alias("ratio"))


# 2.3263478740408408 is the published 0.99 quantile of the normal distribution
@query("SELECT study_id, round(avg(chisq) * pow(0.01 * 0.99, 2) / (0.5 * 0.5 * pow(exp(-pow(2.3263478740408408, 2) / 2) / sqrt(2 * pi()), 2)), 6) AS liability FROM dummy_processed_gwas WHERE chisq IS NOT NULL AND NOT isnan(chisq) GROUP BY study_id")
def q_liability(spark, sf):
    t = table(spark, sf, "dummy_processed_gwas").transform(flt.drop_nan("chisq")).groupBy("study_id").agg(F.avg("chisq").alias("observed"))
    return rounded(t.transform(sca.liability_heritability("observed", "liability", 0.01, 0.5)).select("study_id", "liability"), "liability")


_COHORTS = [sca.Cohort("one", 1000, 4000), sca.Cohort("two", 500, 500), sca.Cohort("three", 300, 900)]


@query("""WITH s AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '?' END) || (CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '?' END) || (CASE WHEN o_orderkey % 5 = 0 THEN '+' ELSE '?' END) AS c FROM orders)
SELECT o_orderkey, CAST(round((CASE WHEN substr(c, 1, 1) <> '?' THEN 3200.0 ELSE 0 END) + (CASE WHEN substr(c, 2, 1) <> '?' THEN 1000.0 ELSE 0 END) + (CASE WHEN substr(c, 3, 1) <> '?' THEN 900.0 ELSE 0 END)) AS BIGINT) AS "N" FROM s""")
def q_effective_n(spark, sf):
    k = F.col("o_orderkey")
    c = F.concat(F.when(k % 2 == 0, "+").otherwise("?"), F.when(k % 3 == 0, "-").otherwise("?"), F.when(k % 5 == 0, "+").otherwise("?"))
    return table(spark, sf, "orders").select("o_orderkey", c.alias("c")).transform(sca.effective_n_from_cohorts(_COHORTS, "c")).select("o_orderkey", "N")


# Multiple testing.

_P = """p AS (SELECT row_id, pow(10.0, -mlog10p) AS p FROM dummy_processed_gwas WHERE mlog10p IS NOT NULL AND NOT isnan(mlog10p))"""
_STEP = """WITH {p}, n AS (SELECT count(*) AS n{c} FROM p), r AS (SELECT row_id, p, row_number() OVER (ORDER BY p) AS k FROM p),
q AS (SELECT row_id, p, k, p * n {by} / k AS raw FROM r, n)
SELECT row_id, round(least(1.0, min(raw) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)), 8) AS p_corrected FROM q"""


def _p_values(spark, sf):
    return gwas(spark, sf).transform(flt.drop_nan("MLOG10P")).select("row_id", F.pow(F.lit(10.0), -F.col("MLOG10P")).alias("p"))


@query(f"WITH {_P} SELECT row_id, p * (SELECT count(*) FROM p) <= 0.05 AS reject_null FROM p")
def q_bonferroni(spark, sf):
    return _p_values(spark, sf).transform(mt.reject_column("p")).select("row_id", "reject_null")


@query(_STEP.format(p=_P, c="", by=""))
def q_fdr_bh(spark, sf):
    return rounded(_p_values(spark, sf).transform(mt.corrected_p("p", "fdr_bh")).select("row_id", "p_corrected"), "p_corrected", digits=8)


@query(_STEP.format(p=_P, c=", (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM p)) t(i)) AS h", by="* h"))
def q_fdr_by(spark, sf):
    return rounded(_p_values(spark, sf).transform(mt.corrected_p("p", "fdr_by")).select("row_id", "p_corrected"), "p_corrected", digits=8)


@query(f"SELECT row_id, round(p_corrected, 8) AS p_corrected FROM ({_STEP.format(p=_P, c='', by='')}) WHERE p_corrected <= 0.05")
def q_fdr_table(spark, sf):
    return rounded(_p_values(spark, sf).transform(mt.corrected_table("p", order=["row_id"])).select("row_id", "p_corrected"), "p_corrected", digits=8)


# Strings and reshape.


@query(r"""SELECT c_custkey, lower(c_mktsegment) AS seg, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer""")
def q_lower_replace(spark, sf):
    return table(spark, sf, "customer").transform(composite([st.lowercase("c_mktsegment", "seg"), st.replace_pattern("c_name", "digits", "[^0-9]", "")])).select("c_custkey", "seg", "digits")


@query("SELECT row_id, concat_ws(':', chr, pos, ea, nea) AS key, CAST(chr AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':' || ea AS strict_key FROM dummy_processed_gwas")
def q_concatenate(spark, sf):
    pipes = [st.concatenate(["chr", "pos", "ea", "nea"], ":", "key"), st.concatenate(["chr", "pos", "ea"], ":", "strict_key", ignore_nulls=False)]
    return table(spark, sf, "dummy_processed_gwas").transform(composite(pipes)).select("row_id", "key", "strict_key")


@query("SELECT row_id, split_part(snpid, ':', 1) AS c, split_part(snpid, ':', 2) AS p, nullif(split_part(snpid, ':', 5), '') AS beyond FROM dummy_processed_gwas")
def q_split_exact(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").transform(st.split_to_columns("snpid", ":", ["c", "p", "x", "y", "beyond"]))
    return d.select("row_id", "c", "p", "beyond")


@query("SELECT row_id, unnest(string_split(snpid, ':')) AS part FROM dummy_processed_gwas")
def q_split_explode(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "snpid").transform(composite([st.split_to_list("snpid", ":", "part"), st.unnest("part")])).select("row_id", "part")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' WHEN 'P' THEN 'partly' END AS status FROM orders")
def q_replace_strict(spark, sf):
    return table(spark, sf, "orders").transform(st.replace_values("o_orderstatus", "status", {"O": "open", "F": "done", "P": "partly"})).select("o_orderkey", "status")


@query("SELECT o_orderkey, printf('%.1f', CAST(o_totalprice AS DOUBLE)) AS price FROM orders")
def q_format_numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")).transform(st.format_numbers("price", ".1f"))


_STATUS = ("F", "O", "P")
_PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, " + ", ".join(f"""nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS "{s}\"""" for s in _STATUS) + " FROM orders GROUP BY 1")
def q_pivot(spark, sf):
    wide = _status_counts(spark, sf).transform(rsh.pivot("o_orderstatus", ["o_orderpriority"], ["n"]))
    return wide.select("o_orderpriority", *(F.col(s) if s in wide.columns else F.lit(None).cast("bigint").alias(s) for s in _STATUS))


@query("SELECT row_id, 'beta' AS variable, beta AS value FROM dummy_processed_gwas UNION ALL SELECT row_id, 'se', se FROM dummy_processed_gwas")
def q_unpivot(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "beta", "se").transform(rsh.unpivot(["row_id"]))


@query("SELECT 'n' AS index, " + ", ".join(f"""count(*) FILTER (l_returnflag = '{s}') AS "{s}\"""" for s in "ANR") + " FROM lineitem")
def q_transpose(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).transform(rsh.transpose("l_returnflag"))


# Joins and unions.


@query("SELECT row_id, d.study_id, s.trait FROM dummy_processed_gwas d JOIN study_info s USING (study_id)")
def q_join_inner(spark, sf):
    return jn.join_tables(table(spark, sf, "dummy_processed_gwas").select("row_id", "study_id"), table(spark, sf, "study_info").select("study_id", "trait"), "inner", ["study_id"], ["study_id"])


@query("SELECT row_id, d.study_id, CAST(d.release_day AS VARCHAR) AS release_day, CAST(s.release_day AS VARCHAR) AS release_day_right FROM dummy_processed_gwas d LEFT JOIN study_info s USING (study_id)")
def q_join_left(spark, sf):
    return jn.join_tables(table(spark, sf, "dummy_processed_gwas").select("row_id", "study_id", F.col("release_day").cast("string").alias("release_day")), table(spark, sf, "study_info").select("study_id", F.col("release_day").cast("string").alias("release_day")), "left", ["study_id"], ["study_id"])


@query("SELECT o_orderkey, m.rank FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2)) m(p, rank) ON o_orderpriority = p")
def q_join_memory(spark, sf):
    m = pd.DataFrame({"p": ["1-URGENT", "2-HIGH"], "rank": pd.Series([1, 2], dtype="int32")})
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").transform(jn.join_memory_table(m, ["o_orderpriority"], ["p"])).select("o_orderkey", "rank")


@query("SELECT g.gene_set_id, g.gene_symbol_id FROM gene_set_gene_symbol g JOIN gene_set s ON g.gene_set_id = s.id")
def q_allow_list(spark, sf):
    return jn.allow_list(table(spark, sf, "gene_set_gene_symbol"), table(spark, sf, "gene_set").select("id"), "gene_set_id", "id").select("gene_set_id", "gene_symbol_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_semi(spark, sf):
    return jn.semi_filter(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("SELECT s_name AS name, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier UNION ALL SELECT c_name, CAST(c_acctbal AS DOUBLE) FROM customer")
def q_concat(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return jn.concat_tables([a, b], casts={"balance": "double"})


_LISTS = """l AS (SELECT DISTINCT gene_symbol_id AS gene, 0 AS i, 'sets' AS s FROM gene_set_gene_symbol WHERE gene_symbol_id IS NOT NULL UNION ALL SELECT DISTINCT id, 1, 'symbols' FROM gene_symbol WHERE id IS NOT NULL)"""


def _lists(spark, sf):
    return {"sets": (table(spark, sf, "gene_set_gene_symbol"), "gene_symbol_id"), "symbols": (table(spark, sf, "gene_symbol"), "id")}


@query(f"WITH {_LISTS} SELECT gene, string_agg(s, ',' ORDER BY i) AS sources FROM l GROUP BY gene")
def q_combine_lists(spark, sf):
    return jn.combine_lists(_lists(spark, sf)).select("gene", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_LISTS}, c AS (SELECT gene, string_agg(s, '&' ORDER BY i) AS combination FROM l GROUP BY gene) SELECT combination, count(*) AS elements FROM c GROUP BY 1")
def q_set_combinations(spark, sf):
    return jn.set_combinations(_lists(spark, sf))


@query("""SELECT s.id, string_agg(DISTINCT y.symbol, ',' ORDER BY y.symbol) AS symbols FROM gene_set s JOIN gene_set_gene_symbol m ON m.gene_set_id = s.id JOIN gene_symbol y ON y.id = m.gene_symbol_id WHERE y.symbol IS NOT NULL GROUP BY s.id""")
def q_list_aggregation(spark, sf):
    names = {f"vl_{n}": table(spark, sf, n) for n in ("gene_set", "gene_set_gene_symbol", "gene_symbol")}
    return src.sql_over(spark, names, """SELECT s.id, array_join(sort_array(collect_set(y.symbol)), ',') AS symbols FROM vl_gene_set s JOIN vl_gene_set_gene_symbol m ON m.gene_set_id = s.id
    JOIN vl_gene_symbol y ON y.id = m.gene_symbol_id WHERE y.symbol IS NOT NULL GROUP BY s.id""")


# Harmonisation.


@query(f"""WITH {A}, {B}, j AS (SELECT b.*, a."EA" AS re, a."NEA" AS rn FROM b JOIN a ON a."CHR" = b."CHR" AND a."POS" = b."POS" AND ((a."EA" = b."EA" AND a."NEA" = b."NEA") OR (a."EA" = b."NEA" AND a."NEA" = b."EA")))
SELECT "CHR", "POS", re AS "EA", rn AS "NEA", round(CASE WHEN "EA" = re THEN "BETA" ELSE -"BETA" END, 6) AS "BETA" FROM j WHERE "EA" <> {REV.format('"NEA"')}""")
def q_harmonize_alleles(spark, sf):
    h = har.via_alleles(half(spark, sf, False), half(spark, sf, True))
    return rounded(h.select("CHR", "POS", "EA", "NEA", "BETA"), "BETA")


@query(f"""WITH {A}, {B}, j AS (SELECT b."rsID", b."EA" AS e, b."NEA" AS n, b."BETA", b."CHR" AS c, b."POS" AS p, a."CHR", a."POS", a."EA", a."NEA" FROM b JOIN a USING ("rsID"))
SELECT "rsID", "EA", "NEA", round(CASE WHEN e = "EA" THEN "BETA" ELSE -"BETA" END, 6) AS "BETA" FROM j WHERE c = "CHR" AND p = "POS" AND ((e = "EA" AND n = "NEA") OR (e = "NEA" AND n = "EA"))""")
def q_harmonize_rsid(spark, sf):
    h = har.via_rsid(half(spark, sf, False), half(spark, sf, True), palindromes="keep", validate=False)
    return rounded(h.select("rsID", "EA", "NEA", "BETA"), "BETA")


@query(f"""WITH {G} SELECT row_id, coalesce("EA" = {REV.format('"NEA"')}, false) AS palindromic FROM g""")
def q_palindrome(spark, sf):
    return gwas(spark, sf).select("row_id", F.coalesce(har.is_palindromic(), F.lit(False)).alias("palindromic"))


@query(f"""WITH {A}, {B}, j AS (SELECT a.*, CASE WHEN a."EA" = b."EA" THEN b."BETA" ELSE -b."BETA" END AS b2, b."SE" AS s2, a."EA" > a."NEA" AS ta, b."EA" > b."NEA" AS tb
FROM a JOIN b ON a."CHR" = b."CHR" AND a."POS" = b."POS" AND ((a."EA" = b."EA" AND a."NEA" = b."NEA") OR (a."EA" = b."NEA" AND a."NEA" = b."EA")))
SELECT "CHR", "POS", "EA", "NEA", "rsID", round(("BETA" / ("SE" * "SE") + b2 / (s2 * s2)) / (1 / ("SE" * "SE") + 1 / (s2 * s2)), 6) AS "BETA", round(sqrt(1 / (1 / ("SE" * "SE") + 1 / (s2 * s2))), 6) AS "SE",
CAST(ta <> tb AS INTEGER) AS n_flipped FROM j""")
def q_meta_analysis(spark, sf):
    return rounded(har.meta_analysis([half(spark, sf, True), half(spark, sf, False)]), "BETA", "SE")


@query(f"""WITH {A}, {B} SELECT a."rsID", a."EA", a."NEA" FROM a JOIN b USING ("rsID") WHERE (a."EA" = b."EA" AND a."NEA" = b."NEA") OR (a."EA" = b."NEA" AND a."NEA" = b."EA")
OR (a."EA" = {REV.format('b."EA"')} AND a."NEA" = {REV.format('b."NEA"')}) OR (a."EA" = {REV.format('b."NEA"')} AND a."NEA" = {REV.format('b."EA"')})""")
def q_compatible_variants(spark, sf):
    return har.compatible_variants(half(spark, sf, True), half(spark, sf, False))


_KEY = """(least({e}, {n}) || '_' || greatest({e}, {n}))"""


@query(f"""WITH {A}, {B}, k AS (SELECT a."CHR", a."POS", a."EA", a."NEA", min(b."rsID") AS "rsID", {_KEY.format(e='a."EA"', n='a."NEA"')} IN ('A_T', 'C_G') AS is_strand_ambiguous
FROM a JOIN b ON a."CHR" = b."CHR" AND a."POS" = b."POS" AND {_KEY.format(e='a."EA"', n='a."NEA"')} = {_KEY.format(e='b."EA"', n='b."NEA"')} GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY "CHR", "POS", "EA", "NEA") - 1 AS row_id FROM k""")
def q_variant_index(spark, sf):
    return variant_index(spark, sf)


def variant_index(spark, sf):
    a = half(spark, sf, True)
    template = a.select(F.col("CHR").alias("CHROM"), F.concat_ws(":", "CHR", "POS", "NEA", "EA").alias("ID"), F.col("NEA").alias("ALLELE0"), F.col("EA").alias("ALLELE1"))
    return jn.build_variant_index(template, half(spark, sf, False))


@query(f"""WITH {A}, {B} SELECT a."CHR", a."POS", a."EA", a."NEA", round(CASE WHEN b."EA" IS NULL THEN NULL WHEN b."EA" = a."EA" THEN b."BETA" ELSE -b."BETA" END, 5) AS "BETA"
FROM a LEFT JOIN b ON a."CHR" = b."CHR" AND a."POS" = b."POS" AND {_KEY.format(e='a."EA"', n='a."NEA"')} = {_KEY.format(e='b."EA"', n='b."NEA"')}""")
def q_align_index(spark, sf):
    index = jn.with_row_id(half(spark, sf, True).select("CHR", "POS", "EA", "NEA"), ["POS", "EA", "NEA"])
    aligned = jn.align_to_index(index, half(spark, sf, False)).select("row_id", F.round(F.nanvl(F.col("BETA").cast("double"), F.lit(None).cast("double")), 5).alias("BETA"))
    return index.join(aligned, "row_id").select("CHR", "POS", "EA", "NEA", "BETA")


@query(f"""WITH {A}, {B}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "rsID" ORDER BY "EA", "NEA", "BETA", "SE", "N") AS rn FROM b) WHERE rn = 1)
SELECT a."rsID", a."POS", round(CASE WHEN a."EA" = t."EA" AND a."NEA" = t."NEA" THEN t."BETA" / t."SE" WHEN a."EA" = t."NEA" AND a."NEA" = t."EA" THEN -t."BETA" / t."SE" END, 6) AS z FROM a LEFT JOIN t USING ("rsID")""")
def q_align_trait(spark, sf):
    return rounded(jn.align_trait(half(spark, sf, True).select("rsID", "POS", "EA", "NEA"), half(spark, sf, False)).select("rsID", "POS", "z"), "z")


@query(f"""WITH {A}, {B}, r AS (SELECT "CHR", "POS", {_KEY.format(e='"EA"', n='"NEA"')} AS k, min("rsID") AS "rsID" FROM b GROUP BY ALL)
SELECT a."CHR", a."POS", a."NEA" AS "REF", a."EA" AS "ALT", r."rsID" FROM a LEFT JOIN r ON a."CHR" = r."CHR" AND a."POS" = r."POS" AND {_KEY.format(e='a."EA"', n='a."NEA"')} = r.k""")
def q_attach_rsid(spark, sf):
    v = half(spark, sf, True).select("CHR", "POS", F.col("NEA").alias("REF"), F.col("EA").alias("ALT"))
    return jn.attach_rsid(v, half(spark, sf, False))


# Intervals. Ranges of one megabase around every 50th megabase stand for genes.


def _ranges(spark, sf):
    g = gwas(spark, sf).groupBy("CHR", F.floor(F.col("POS") / 5_000_000).alias("k")).agg(F.min("POS").alias("start"))
    return g.select(F.col("CHR").alias("chrom"), F.col("start").cast("bigint").alias("start"), (F.col("start") + 400_000).cast("bigint").alias("end"), F.concat_ws("_", "CHR", "k").alias("gene"))


_RANGES = f"""{G}, r AS (SELECT "CHR" AS chrom, min("POS") AS start, min("POS") + 400000 AS "end", concat_ws('_', "CHR", CAST("POS" // 5000000 AS BIGINT)) AS gene FROM g GROUP BY "CHR", "POS" // 5000000)"""


@query(f"""WITH {_RANGES} SELECT row_id, gene FROM g JOIN r ON "CHR" = chrom AND "POS" BETWEEN start - 50000 AND "end" + 50000""")
def q_range_join(spark, sf):
    return itv.points_in_ranges(gwas(spark, sf).select("row_id", "CHR", "POS"), _ranges(spark, sf), 50_000).select("row_id", "gene")


@query(f"""WITH {_RANGES} SELECT gene, count(*) AS n_variants, min("POS") AS first_pos, max("POS") AS last_pos FROM g JOIN r ON "CHR" = chrom AND "POS" BETWEEN start - 35000 AND "end" + 35000 GROUP BY gene""")
def q_annotate_genes(spark, sf):
    return itv.annotate_genes(gwas(spark, sf).select("CHR", "POS"), _ranges(spark, sf), 35_000)


@query(f"""WITH {_RANGES}, w AS (SELECT chrom, start - 3000000 AS s, "end" + 3000000 AS e, gene FROM r)
SELECT row_id, gene FROM (SELECT row_id, gene, row_number() OVER (PARTITION BY row_id ORDER BY least("POS" - s, e - "POS") DESC, s, e) AS rn FROM g JOIN w ON "CHR" = chrom AND "POS" BETWEEN s AND e) WHERE rn = 1""")
def q_best_range(spark, sf):
    wide = _ranges(spark, sf).withColumns({"start": F.col("start") - 3_000_000, "end": F.col("end") + 3_000_000})
    return itv.best_range(gwas(spark, sf).select("row_id", "CHR", "POS"), wide, ["row_id"], bin_size=5_000_000).select("row_id", "gene")


@query(f"""WITH {G} SELECT row_id, "CHR" = 7 AND "POS" BETWEEN 39000000 AND 61000000 AS cis FROM g""")
def q_cis_mask(spark, sf):
    return itv.cis_mask(gwas(spark, sf), (7, 40_000_000, 60_000_000)).select("row_id", "cis")


@query(f"""WITH {G}, s AS (SELECT "CHR", "POS", row_id, pow(10.0, -"MLOG10P") AS "P" FROM g WHERE "MLOG10P" >= 4 AND NOT isnan("MLOG10P")),
m AS (SELECT *, CASE WHEN "POS" - lag("POS") OVER (PARTITION BY "CHR" ORDER BY "POS") <= 500000 THEN 0 ELSE 1 END AS f FROM s),
l AS (SELECT *, sum(f) OVER (PARTITION BY "CHR" ORDER BY "POS" RANGE UNBOUNDED PRECEDING) AS locus FROM m)
SELECT "CHR", row_id, count AS locus_variants FROM (SELECT *, count(*) OVER (PARTITION BY "CHR", locus) AS count, row_number() OVER (PARTITION BY "CHR", locus ORDER BY "P", "POS", row_id) AS rn FROM l) WHERE rn = 1""")
def q_lead_variants(spark, sf):
    d = gwas(spark, sf).where("MLOG10P >= 4 and not isnan(MLOG10P)").select("CHR", "POS", "row_id", F.pow(F.lit(10.0), -F.col("MLOG10P")).alias("P"))
    return itv.lead_variants(d, threshold=1.0).select("CHR", "row_id", "locus_variants")


@query(f"""WITH {G}, m AS (SELECT "CHR", max("POS") AS len FROM g GROUP BY 1), o AS (SELECT "CHR", coalesce(sum(len) OVER (ORDER BY "CHR" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m)
SELECT row_id, CAST("POS" + off AS BIGINT) AS x, round(CASE WHEN pow(10.0, -"MLOG10P") > 0 THEN abs(log10(pow(10.0, -"MLOG10P"))) END, 9) AS mlog10p FROM g JOIN o USING ("CHR") WHERE NOT coalesce(isnan("MLOG10P"), false)""")
def q_manhattan(spark, sf):
    d = gwas(spark, sf)
    longest = itv.manhattan_positions(d.withColumn("P", F.pow(F.lit(10.0), -F.col("MLOG10P"))).select("row_id", "CHR", "POS", "P", F.isnan("MLOG10P").alias("nan")))
    return rounded(longest.where(~F.col("nan")).select("row_id", "x", F.abs("mlog10p").alias("mlog10p")), "mlog10p", digits=9)


# Aggregates.


@query(f"""WITH {_P}, m AS (SELECT study_id, 'c' || chr AS model, min(p) AS p FROM p JOIN dummy_processed_gwas USING (row_id) GROUP BY ALL)
SELECT study_id, string_agg(model, ',' ORDER BY model) AS models_used, count(p) AS n_models, round(0.5 - atan(avg(tan((0.5 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) * pi()))) / pi(), 6) AS acat_p
FROM m WHERE model NOT IN ('c1', 'c23') GROUP BY study_id""")
def q_acat(spark, sf):
    d = gwas(spark, sf).transform(flt.drop_nan("MLOG10P")).withColumn("p", F.pow(F.lit(10.0), -F.col("MLOG10P")))
    m = d.groupBy("study_id", F.concat(F.lit("c"), F.col("CHR").cast("string")).alias("model")).agg(F.min("p").alias("p"))
    return rounded(m.transform(agg.acat(["study_id"], "p", "model", ["c1", "c23"])), "acat_p")


@query("""WITH m AS (SELECT event_type, user_id, avg(value) AS mean FROM events GROUP BY ALL) SELECT user_id, event_type, round(mean / nullif(sum(mean) OVER (PARTITION BY user_id), 0), 6) AS specificity
FROM m WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 0)""")
def q_specificity_fraction(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("value").cast("double").alias("value"), "user_id", "event_id")
    return rounded(e.transform(agg.specificity_fraction("event_type", "value", "user_id", "event_id")), "specificity")


@query("""WITH s AS (SELECT event_type, user_id, avg(v) AS m, stddev_samp(v) AS sd, avg((v = 0)::INT) AS zero FROM (SELECT *, CASE WHEN value < 20 THEN 0 ELSE value END AS v FROM events) WHERE user_id IN (SELECT user_id FROM events WHERE value >= 20) GROUP BY ALL),
c AS (SELECT *, (sd + 1e-4) / (m + 1e-4) AS cv FROM s), r AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY zero RANGE UNBOUNDED PRECEDING) AS r1, count(*) OVER (PARTITION BY event_type ORDER BY cv NULLS FIRST RANGE UNBOUNDED PRECEDING) AS r2, count(*) OVER (PARTITION BY event_type) AS n FROM c),
x AS (SELECT *, 1 - (r1 + r2) / (2 * n) AS st FROM r) SELECT user_id, event_type, round(st - avg(st) OVER (PARTITION BY user_id), 6) AS specificity FROM x""")
def q_specificity_stability(spark, sf):
    v = F.col("value").cast("double")
    e = table(spark, sf, "events").select("event_type", F.when(v < 20, 0.0).otherwise(v).alias("value"), "user_id", "event_id")
    return rounded(e.transform(agg.specificity_stability("event_type", "value", "user_id", "event_id", validate=False)), "specificity")


@query("SELECT row_id, count(*) OVER (PARTITION BY study_id ORDER BY n RANGE UNBOUNDED PRECEDING) AS r FROM dummy_processed_gwas WHERE n IS NOT NULL")
def q_rank_max(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").where("n is not null").select("row_id", "study_id", "n")
    return agg.with_rank_max(d, ["study_id"], "n", "r").select("row_id", "r")


@query(f"""WITH c AS (SELECT snpid, sum(beta / (se * se)) / sum(1 / (se * se)) AS beta, sum(1 / se) / sum(1 / (se * se)) AS se, max(beta) - min(beta) AS beta_range, count(*) AS n_assays
FROM dummy_processed_gwas WHERE beta IS NOT NULL AND se > 0 GROUP BY snpid) SELECT snpid, round(beta, 6) AS beta, round(se, 6) AS se, round(beta_range, 9) AS beta_range, n_assays, round({tail_sql("(beta / se)")}, 6) AS p FROM c""")
def q_collapse(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").where("beta is not null and se > 0").select("snpid", "study_id", "beta", "se")
    c = d.transform(agg.collapse_assays({}, "snpid", "study_id", "beta", "se", "p"))
    return rounded(rounded(c.select("snpid", "beta", "se", "beta_range", "n_assays", "p"), "beta", "se", "p"), "beta_range", digits=9)


_STUDY_SETS = "d AS (SELECT DISTINCT study_id AS s, snpid AS i FROM dummy_processed_gwas WHERE study_id IS NOT NULL AND snpid IS NOT NULL)"


@query(f"""WITH {_STUDY_SETS}, n AS (SELECT s, count(*) AS n FROM d GROUP BY s), c AS (SELECT a.s AS set_1, b.s AS set_2, count(*) AS common FROM d a JOIN d b ON a.i = b.i AND a.s < b.s GROUP BY ALL),
e AS (SELECT x.s AS set_1, y.s AS set_2, x.n + y.n AS sizes FROM n x JOIN n y ON x.s < y.s), f AS (SELECT set_1, set_2, sizes, coalesce(c.common, 0) AS common FROM e LEFT JOIN c USING (set_1, set_2))
SELECT set_1, set_2, common, sizes - common AS joined, round(common / (sizes - common), 6) AS jaccard FROM f""")
def q_jaccard_pairs(spark, sf):
    return rounded(agg.jaccard_pairs(table(spark, sf, "dummy_processed_gwas"), "study_id", "snpid"), "jaccard")


_RG = "t AS (SELECT l_returnflag || l_linestatus AS p1, l_shipmode AS p2, round(avg(CAST(l_discount AS DOUBLE)), 6) AS rg, round(avg(CAST(l_tax AS DOUBLE)), 6) AS p FROM lineitem GROUP BY ALL)"


def _study_pairs(spark, sf):
    """rg-like pair table: pairs of studies by the correlation of their effects."""
    d = table(spark, sf, "dummy_processed_gwas").where("beta is not null").groupBy("study_id", "chr").agg(F.avg("beta").alias("b"))
    x, y = d.select(F.col("study_id").alias("p1"), "chr", F.col("b").alias("b1")), d.select(F.col("study_id").alias("p2"), "chr", F.col("b").alias("b2"))
    return x.join(y, "chr").where("p1 < p2").groupBy("p1", "p2").agg(F.round(F.avg(F.col("b1") * F.col("b2")) * 1e4, 4).alias("rg"), F.round(F.avg(F.abs(F.col("b1") - F.col("b2"))), 6).alias("p"))


_PAIRS = """d AS (SELECT study_id, chr, avg(beta) AS b FROM dummy_processed_gwas WHERE beta IS NOT NULL GROUP BY ALL),
t AS (SELECT x.study_id AS p1, y.study_id AS p2, round(avg(x.b * y.b) * 1e4, 4) AS rg, round(avg(abs(x.b - y.b)), 6) AS p FROM d x JOIN d y ON x.chr = y.chr AND x.study_id < y.study_id GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT p1, p2, rg FROM t UNION SELECT p2, p1, rg FROM t UNION SELECT n, n, 1.0 FROM (SELECT p1 AS n FROM t UNION SELECT p2 FROM t)")
def q_full_correlation(spark, sf):
    return agg.full_correlation_table(_study_pairs(spark, sf)).select("p1", "p2", "rg")


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs FROM t")
def q_pair_count(spark, sf):
    t = _study_pairs(spark, sf)
    return agg.unique_pair_count(t.unionByName(t.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "rg", "p")), "p1", "p2")


@query("""WITH m AS (SELECT DISTINCT l_shipdate AS d, l_linenumber AS k FROM lineitem) SELECT d, """ + ", ".join(f"""max((k = {i})::INT) AS "{i}\"""" for i in range(1, 8)) + " FROM m GROUP BY d")
def q_indicator_matrix(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("k"))
    return d.transform(rsh.indicator_matrix("d", "k", list(range(1, 8))))


@query("""SELECT CAST(least(floor(eaf / 0.05), 19) AS INTEGER) AS bin_x, CAST(least(floor(se / 0.01), 19) AS INTEGER) AS bin_y, round(avg(beta), 6) AS mean, count(beta) AS n FROM dummy_processed_gwas WHERE eaf BETWEEN 0 AND 1 AND se BETWEEN 0 AND 0.2 GROUP BY ALL""")
def q_binned_means(spark, sf):
    return rounded(agg.binned_means(table(spark, sf, "dummy_processed_gwas"), "eaf", "se", "beta", (0, 1), (0, 0.2), 20), "mean")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_quantity AS DOUBLE) / sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def q_row_normalised(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("q"))
    return rounded(agg.row_normalised(d, "l_orderkey", "q").drop("q"), "share")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM events GROUP BY ALL")
def q_windowed_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    w = windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "1 hour")
    return rounded(w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "total", digits=4)


# A p-value of |z| beyond 38 is 0 as a double, so the queries that go through p leave such rows out.
# Regressions. LD scores are made from positions; the early half of the studies is trait 1, the later half trait 2.

M_TOTAL, N_BLOCKS = 1_000_000.0, 20


def _context(spark, sf) -> tuple[DataFrame, int]:
    a = half(spark, sf, True).withColumns({"z_t": F.col("BETA") / F.col("SE"), "n_t": F.col("N")})
    h = har.via_alleles(half(spark, sf, False), a, palindromes="keep", extra=("z_t", "n_t"))
    j = h.select("CHR", "POS", "EA", "NEA", (F.col("BETA") / F.col("SE")).alias("z_p"), F.col("N").alias("n_p"), "z_t", "n_t")
    j = j.withColumn("ld", (1 + F.col("POS") % 97).cast("double"))
    d = jn.with_row_id(j, ["POS", "EA", "NEA"], name="ordinal")
    return d, d.count()


_CONTEXT = f"""{A}, {B}, j AS (SELECT a."CHR", a."POS", a."EA", a."NEA", a."BETA" / a."SE" AS z_t, a."N" AS n_t, CASE WHEN a."EA" = b."EA" THEN b."BETA" ELSE -b."BETA" END / b."SE" AS z_p, b."N" AS n_p, CAST(1 + a."POS" % 97 AS DOUBLE) AS ld
FROM a JOIN b ON a."CHR" = b."CHR" AND a."POS" = b."POS" AND ((a."EA" = b."EA" AND a."NEA" = b."NEA") OR (a."EA" = b."NEA" AND a."NEA" = b."EA"))),
o AS (SELECT *, row_number() OVER (ORDER BY "CHR", "POS", "EA", "NEA") - 1 AS ord, (SELECT count(*) FROM j) AS s FROM j),
k AS (SELECT *, least({N_BLOCKS - 1}, ((ord + 1) * {N_BLOCKS} + s - 2) // (s - 1) - 1) AS block FROM o)"""


@query(f"""WITH {_CONTEXT}, c AS (SELECT *, z_t * z_t AS chi FROM k WHERE z_t * z_t <= greatest(0.001 * n_t, 80)),
g AS (SELECT least(greatest({M_TOTAL} * (avg(chi) - 1) / avg(ld * n_t), 0), 1) AS tot, avg(n_t) AS nbar, avg(chi) AS mean_chi2, count(*) AS n_kept FROM c),
w AS (SELECT c.*, 1 / (2 * power(1 + tot * n_t / {M_TOTAL} * greatest(ld, 1), 2)) / greatest(ld, 1) AS w FROM c, g),
b5 AS (SELECT block, sum(w * ld * ld) AS a, sum(w * ld) AS b, sum(w) AS d, sum(w * ld * chi) AS e, sum(w * chi) AS f FROM w GROUP BY block),
t AS (SELECT sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(e) AS e, sum(f) AS f FROM b5),
l AS (SELECT (t.d * t.e - t.b * t.f) / (t.a * t.d - t.b * t.b) AS slope, (t.a * t.f - t.b * t.e) / (t.a * t.d - t.b * t.b) AS icpt,
((t.d - b5.d) * (t.e - b5.e) - (t.b - b5.b) * (t.f - b5.f)) / ((t.a - b5.a) * (t.d - b5.d) - power(t.b - b5.b, 2)) AS loo,
((t.a - b5.a) * (t.f - b5.f) - (t.b - b5.b) * (t.e - b5.e)) / ((t.a - b5.a) * (t.d - b5.d) - power(t.b - b5.b, 2)) AS iloo FROM b5, t)
SELECT round(sqrt(var_samp({N_BLOCKS} * icpt - {N_BLOCKS - 1} * iloo) / {N_BLOCKS}), 6) AS intercept_se, round(max(mean_chi2), 6) AS mean_chi2, round((SELECT median(chi) FROM c) / 0.4549364231195724, 6) AS lambda_gc, round(max(slope) * {M_TOTAL} / max(nbar), 6) AS h2, round(sqrt(var_samp({N_BLOCKS} * slope - {N_BLOCKS - 1} * loo)) * {M_TOTAL} / max(nbar) / sqrt({N_BLOCKS}), 6) AS h2_se, round(max(icpt), 6) AS intercept, max(n_kept) AS n_kept FROM l, g""")
def q_ldsc_h2(spark, sf):
    d, n = _context(spark, sf)
    t = d.select(F.lit("t").alias("trait"), "ordinal", "ld", (F.col("z_t") * F.col("z_t")).alias("chi2"), F.col("n_t").alias("n"))
    return rounded(reg.heritability(t, ["trait"], n, M_TOTAL, N_BLOCKS).select("h2", "h2_se", "intercept", "n_kept", "intercept_se", "mean_chi2", "lambda_gc"), "h2", "h2_se", "intercept", "intercept_se", "mean_chi2", "lambda_gc")


@query(f"""WITH {_CONTEXT}, c AS (SELECT *, z_t * z_t AS ct, z_p * z_p AS cp FROM k WHERE z_t * z_t <= greatest(0.001 * n_t, 80) AND z_p * z_p <= greatest(0.001 * n_p, 80)),
g AS (SELECT least(greatest({M_TOTAL} * (avg(ct) - 1) / avg(ld * n_t), 0), 1) AS tt, least(greatest({M_TOTAL} * (avg(cp) - 1) / avg(ld * n_p), 0), 1) AS tp, avg(n_t) AS nt, avg(n_p) AS np FROM c),
w AS (SELECT c.*, 1 / (2 * power(1 + tt * n_t / {M_TOTAL} * greatest(ld, 1), 2)) AS ht, 1 / (2 * power(1 + tp * n_p / {M_TOTAL} * greatest(ld, 1), 2)) AS hp, 1 / greatest(ld, 1) AS oc FROM c, g),
r AS (SELECT kind, block, sum(w * ld * ld) AS a, sum(w * ld) AS b, sum(w) AS d, sum(w * ld * y) AS e, sum(w * y) AS f FROM (
SELECT 't' AS kind, block, ht * oc AS w, ld, ct AS y FROM w UNION ALL SELECT 'p', block, hp * oc, ld, cp FROM w UNION ALL SELECT 'c', block, oc * power(sqrt(ht) + sqrt(hp), 2), ld, z_t * z_p FROM w) GROUP BY ALL),
s AS (SELECT kind, sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(e) AS e, sum(f) AS f FROM r GROUP BY kind),
v AS (SELECT kind, (d * e - b * f) / (a * d - b * b) AS slope FROM s),
lo AS (SELECT kind, block, ((s.d - r.d) * (s.e - r.e) - (s.b - r.b) * (s.f - r.f)) / ((s.a - r.a) * (s.d - r.d) - power(s.b - r.b, 2)) AS slope FROM r JOIN s USING (kind)),
u AS (SELECT block, max(slope) FILTER (kind = 'c') AS c, max(slope) FILTER (kind = 't') AS t, max(slope) FILTER (kind = 'p') AS p FROM lo GROUP BY block),
x AS (SELECT sqrt(var_pop(c / sqrt(t * p)) * {N_BLOCKS - 1}) AS rg_se FROM u),
y AS (SELECT max(slope) FILTER (kind = 'c') / sqrt(max(slope) FILTER (kind = 't') * max(slope) FILTER (kind = 'p')) AS rg FROM v)
SELECT round(max(rg), 6) AS rg, round(max(rg_se), 6) AS rg_se, round(max(rg / rg_se), 5) AS z, round(max({tail_sql('(rg / rg_se)')}), 6) AS p, round(max(slope) FILTER (kind = 'c') / sqrt(max(nt) * max(np)) * {M_TOTAL}, 6) AS gcov, round(max(slope) FILTER (kind = 't') / max(nt) * {M_TOTAL}, 6) AS h2_t, round(max(slope) FILTER (kind = 'p') / max(np) * {M_TOTAL}, 6) AS h2_p FROM v, g, x, y""")
def q_ldsc_rg(spark, sf):
    d, n = _context(spark, sf)
    r = reg.genetic_correlation(d.withColumn("pair", F.lit("t-p")), ["pair"], n, M_TOTAL, N_BLOCKS).select("gcov", "h2_t", "h2_p", "rg", "rg_se", "z", "p")
    return rounded(rounded(r, "gcov", "h2_t", "h2_p", "rg", "rg_se", "p"), "z", digits=5)


_S, _V, _I = [[0.4, 0.1], [0.1, 0.3]], [[1e-4, 2e-5, 1e-5], [2e-5, 8e-5, 1e-5], [1e-5, 1e-5, 9e-5]], [[1.02, 0.1], [0.1, 1.03]]


@query(f"""WITH {_CONTEXT} SELECT "CHR", "POS", "EA", "NEA", round(z_p / sqrt(0.3), 6) AS beta_f, round((z_t - 0.1 / 0.3 * z_p) / sqrt(0.4 - 0.01 / 0.3), 6) AS beta_r,
round(sqrt(power(1 / sqrt(0.3), 2) * 1.03 + power(z_p / (2 * sqrt(0.3) * 0.3), 2) * 9e-5), 6) AS se_f FROM j""")
def q_subtraction(spark, sf):
    d, _ = _context(spark, sf)
    x = d.select("CHR", "POS", "EA", "NEA", F.col("z_t").alias("beta1"), F.col("z_p").alias("beta2"), F.lit(1.0).alias("se1"), F.lit(1.0).alias("se2"), F.lit(0.3).alias("var_snp"))
    return rounded(reg.subtraction(x, _S, _V, _I).select("CHR", "POS", "EA", "NEA", "beta_f", "beta_r", "se_f"), "beta_f", "beta_r", "se_f")


@query(f"""WITH {A}, {B}, t AS (SELECT a."rsID" AS "SNP", a."EA" AS r1, a."NEA" AS r2, b."EA" AS e0, b."NEA" AS n0, b."BETA" / b."SE" AS z0, b."N" FROM b JOIN (SELECT "rsID", min("EA") AS "EA", min("NEA") AS "NEA" FROM a GROUP BY 1) a USING ("rsID")),
s AS (SELECT *, CASE WHEN e0 = r1 THEN z0 ELSE -z0 END AS z FROM t WHERE abs(z0) < 38 AND length(e0) = 1 AND length(n0) = 1 AND ((e0 = r1 AND n0 = r2) OR (e0 = r2 AND n0 = r1)))
SELECT "SNP", r1 AS "A1", r2 AS "A2", round(z, 5) AS "Z", "N" FROM s""")
def q_munge(spark, sf):
    a = half(spark, sf, True).groupBy(F.col("rsID").alias("SNP")).agg(F.min("EA").alias("A1"), F.min("NEA").alias("A2"))
    b = with_two_sided(half(spark, sf, False), "(BETA / SE)", "P")
    d = b.select(F.col("rsID").alias("SNP"), F.col("EA").alias("A1"), F.col("NEA").alias("A2"), F.col("BETA").alias("effect"), "P", "N")
    return rounded(reg.munge(d, a), "Z", digits=5)


@query(f"""WITH {A}, {B}, r AS (SELECT "rsID" AS "SNP", min("EA") AS r1, min("NEA") AS r2 FROM a GROUP BY 1), t AS (SELECT b."rsID" AS "SNP", r1, r2, b."EA" AS e0, b."NEA" AS n0, b."BETA" / b."SE" AS z0, b."N" FROM b JOIN r ON b."rsID" = r."SNP"),
z AS (SELECT *, CASE WHEN e0 = r1 THEN z0 ELSE -z0 END AS z FROM t WHERE abs(z0) < 38 AND ((e0 = r1 AND n0 = r2) OR (e0 = r2 AND n0 = r1)))
SELECT "SNP", r1 AS "A1", r2 AS "A2", round(z / sqrt("N" * 0.42), 7) AS beta, round(abs(1 / sqrt("N" * 0.42)), 7) AS se FROM z WHERE z <> 0""")
def q_standardise(spark, sf):
    a = half(spark, sf, True).groupBy(F.col("rsID").alias("SNP")).agg(F.min("EA").alias("A1"), F.min("NEA").alias("A2")).withColumn("MAF", F.lit(0.3))
    b = with_two_sided(half(spark, sf, False), "(BETA / SE)", "P")
    d = b.select(F.col("rsID").alias("SNP"), F.col("EA").alias("A1"), F.col("NEA").alias("A2"), F.col("BETA").alias("effect"), "P", "N")
    return rounded(reg.standardise(d, reg.filter_reference(a, 0.01)).select("SNP", "A1", "A2", "beta", "se"), "beta", "se", digits=7)


@query(f"""WITH {A}, {B} SELECT "rsID" AS "SNP", round(a."BETA", 6) AS "beta.early", round(a."SE", 6) AS "se.early", round(b."BETA", 6) AS "beta.late", round(b."SE", 6) AS "se.late" FROM a JOIN b USING ("rsID")""")
def q_merge_traits(spark, sf):
    parts = {n: half(spark, sf, e).select(F.col("rsID").alias("SNP"), F.round("BETA", 6).alias("beta"), F.round("SE", 6).alias("se")) for n, e in (("early", True), ("late", False))}
    return jn.merge_traits(parts)


@query(f"""WITH {_CONTEXT}, m AS (SELECT "CHR", CAST("CHR" * 10 AS DOUBLE) AS v FROM k GROUP BY 1) SELECT sum(v) AS v FROM m""")
def q_total_per_chromosome(spark, sf):
    d, _ = _context(spark, sf)
    return src.total_per_chromosome(d.select("CHR", (F.col("CHR") * 10.0).alias("v")), "v")


@query("SELECT row_id, CAST(CASE WHEN c = 'X' THEN '23' ELSE c END AS INTEGER) AS chrom, CAST(p AS INTEGER) AS start FROM (SELECT row_id, split_part(snpid, ':', 1) AS c, split_part(snpid, ':', 2) AS p FROM dummy_processed_gwas) WHERE (c = 'X' OR regexp_full_match(c, '[0-9]+')) AND regexp_full_match(p, '[0-9]+')")
def q_gene_coordinates(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").select("row_id", "snpid").transform(st.split_to_columns("snpid", ":", ["Gene CHROM", "Gene start"])).withColumn("Gene end", F.col("Gene start"))
    return itv.gene_coordinates(d).select("row_id", "chrom", "start")


@query()
def q_lcv_jackknife(spark, sf):
    """Leave-one-block-out moments of the latent causal variable model between the two halves."""
    d, n = _context(spark, sf)
    return spark.createDataFrame(causality.jackknife(d.select("ordinal", "ld", F.col("z_t").alias("z1"), F.col("z_p").alias("z2")), n, 20))


@query()
def q_multi_trait(spark, sf):
    """Genetic covariance, its sampling covariance and intercepts of the two halves, as (matrix, i, j, value)."""
    d, n = _context(spark, sf)
    wide = d.select("ordinal", "ld", F.col("z_t").alias("z.early"), F.col("n_t").alias("n.early"), F.col("z_p").alias("z.late"), F.col("n_p").alias("n.late"))
    s, v, i = reg.multi_trait(wide, ["early", "late"], n, M_TOTAL, N_BLOCKS)
    return spark.createDataFrame([(name, a, b, float(x)) for name, m in (("S", s), ("V", v), ("I", i)) for a, r in enumerate(m) for b, x in enumerate(r)], "matrix string, i int, j int, value double")


# Labelled arrays and downstream tables.


def _study_chr(spark, sf):
    """Mean effect per study and chromosome as a long array, and a table of the studies."""
    d = table(spark, sf, "dummy_processed_gwas").where("beta is not null")
    cells = d.groupBy("study_id", "chr").agg(F.round(F.avg("beta"), 12).alias("value"))
    labels = d.groupBy("study_id").agg(F.round(F.avg(F.abs("beta")), 7).alias("p"), F.round(F.avg("beta"), 7).alias("z"))
    return cells, labels


_CELLS = """cells AS (SELECT study_id, chr, round(avg(beta), 12) AS value FROM dummy_processed_gwas WHERE beta IS NOT NULL GROUP BY ALL),
labels AS (SELECT study_id, round(avg(abs(beta)), 7) AS p, round(avg(beta), 7) AS z FROM dummy_processed_gwas WHERE beta IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CELLS} SELECT c.* FROM cells c WHERE study_id IN (SELECT study_id FROM labels ORDER BY p, study_id LIMIT 8)")
def q_most_significant(spark, sf):
    cells, labels = _study_chr(spark, sf)
    return lab.most_significant(cells, labels, "study_id", "p", 8).select("study_id", "chr", "value")


@query(f"WITH {_CELLS} SELECT c.* FROM cells c WHERE study_id IN (SELECT study_id FROM labels WHERE p <= 0.8 / (SELECT count(*) FROM labels) AND z >= 0)")
def q_significance_filter(spark, sf):
    cells, labels = _study_chr(spark, sf)
    return lab.significance_filter(cells, labels, "study_id", "p", "z", 0.8).select("study_id", "chr", "value")


@query(f"""WITH {_CELLS} SELECT study_id, chr, value, trait FROM cells LEFT JOIN (SELECT study_id, min(trait) AS trait FROM study_info GROUP BY 1) USING (study_id)""")
def q_annotate(spark, sf):
    return lab.annotate(_study_chr(spark, sf)[0], "study_id", [table(spark, sf, "study_info").select("study_id", "trait")]).select("study_id", "chr", "value", "trait")


@query()
def q_cluster_order(spark, sf):
    """Studies in the order of average-linkage clustering of their mean effects by chromosome."""
    order = lab.cluster_order(_study_chr(spark, sf)[0].where("study_id is not null"), "study_id", "chr", "value")
    return spark.createDataFrame(list(enumerate(order)), "place int, study_id string")


@query("SELECT snpid AS \"rsID\", CAST(m // 1000000000 AS INTEGER) AS \"CHR\", CAST(m % 1000000000 AS INTEGER) AS \"POS\" FROM (SELECT snpid, min(CAST(chr AS BIGINT) * 1000000000 + pos) AS m FROM dummy_processed_gwas WHERE snpid IS NOT NULL GROUP BY 1)")
def q_snp_locations(spark, sf):
    return dn.snp_locations(gwas(spark, sf).withColumnRenamed("SNPID", "rsID"))


@query(f"""WITH {A} SELECT "rsID" AS "RSID", "CHR", "POS", "EA" AS "A1", "NEA" AS "A2", "N", round("BETA" / "SE", 6) AS "Z" FROM a""")
def q_z_table(spark, sf):
    return rounded(dn.z_table(half(spark, sf, True)), "Z")


@query(f"""WITH {_CONTEXT}, i AS (SELECT "CHR", sum(z_t * z_p) AS xy, sum(z_t * z_t) AS xx, sum(z_p * z_p) AS yy, count(*) AS n FROM k GROUP BY 1)
SELECT "CHR", round(xy / xx, 6) AS b, round(sqrt(greatest((yy - xy / xx * xy) / greatest(n - 1, 1), 1) / xx), 6) AS se, n FROM i""")
def q_causal_estimate(spark, sf):
    """Inverse-variance causal estimate of the early on the late half's z-scores, per chromosome."""
    d, _ = _context(spark, sf)
    iv = d.select("CHR", F.col("z_t").alias("beta_exposure"), F.col("z_p").alias("beta_outcome"), F.lit(1.0).alias("se_outcome"))
    return rounded(dn.inverse_variance_estimate(iv, ["CHR"]).select("CHR", "b", "se", "n"), "b", "se")


def queries() -> dict[str, Query]:
    from varloom.plans import more_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from varloom.plans import more_queries  # noqa: F401

    return dict(SQL)

"""More registered queries: sources and sinks written and read back, and the operators that `queries` leaves out."""

from __future__ import annotations

import gzip
import io
import sqlite3
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from varloom.operators import aggregate as agg
from varloom.operators import causality
from varloom.operators import downstream as dn
from varloom.operators import filters as flt
from varloom.operators import harmonize as har
from varloom.operators import intervals as itv
from varloom.operators import joins as jn
from varloom.operators import labelled as lab
from varloom.operators import project as prj
from varloom.operators import proteins as prot
from varloom.operators import regress as reg
from varloom.operators import rows
from varloom.operators import scalar as sca
from varloom.operators import strings as st
from varloom.operators import sumstats
from varloom.operators.pipe import composite, identity, observed
from varloom.plans import dag
from varloom.plans.queries import _CONTEXT, M_TOTAL, N_BLOCKS, SQL, A, G, _context, gwas, half, query, rounded
from varloom.session import table, work_path
from varloom.sources import tables as src

# Sources and sinks: a table is written in a format to the shared folder and read back through the format's reader.


def _nation(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


_NATION = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"
_ROWS = "SELECT row_id, study_id, beta, se FROM dummy_processed_gwas"


def _rows(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "study_id", "beta", "se")


@query("SELECT row_id, study_id, beta, se, ea FROM dummy_processed_gwas")
def q_text_round_trip(spark, sf):
    path = work_path(spark, "text")
    src.write(table(spark, sf, "dummy_processed_gwas").select("row_id", "study_id", "beta", "se", "ea"), path, src.TextOut("\t"))
    return src.scan(spark, path, src.ReadSpec(src.TextFormat("\t", ("", "NA"), {"row_id": "bigint", "beta": "double", "se": "double"})))


@query(_NATION)
def q_text_inferred(spark, sf):
    path = work_path(spark, "inferred")
    src.write(_nation(spark, sf), path, src.TextOut(",", one_file=True))
    return src.scan(spark, path, src.ReadSpec(src.TextFormat()))


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name FROM nation")
def q_text_skipped_rows(spark, sf):
    path = work_path(spark, "skipped")
    for i, r in enumerate(_nation(spark, sf).collect()):  # a file per nation
        src.put(f"{path}/{i}.csv", f"made by hand\n# note\nk,name\n{r['n_nationkey']},{r['n_name']}\n".encode())
    return src.scan(spark, path, src.ReadSpec(src.TextFormat(types={"k": "int"}, skip_rows=2)))


@query("SELECT row_id, study_id, beta FROM dummy_processed_gwas WHERE study_id IS NOT NULL AND beta IS NOT NULL")
def q_whitespace_round_trip(spark, sf):
    path = work_path(spark, "blank")
    dn.write_space_separated(_rows(spark, sf).where("study_id is not null and beta is not null").select("row_id", F.regexp_replace("study_id", " ", "_").alias("study_id"), "beta"), path)
    d = src.scan(spark, path, src.ReadSpec(src.WhitespaceFormat("#", ["row_id", "study_id", "beta"], {"row_id": "bigint", "beta": "double"})))
    return d.withColumn("study_id", F.regexp_replace("study_id", "_(?= )", " "))


@query(_ROWS)
def q_parquet_round_trip(spark, sf):
    path = work_path(spark, "parquet")
    src.write(_rows(spark, sf), path, src.ParquetOut("zstd", 3, ("beta", "se")))
    return src.scan(spark, path, src.ReadSpec(src.ParquetFormat()))


@query(_ROWS)
def q_sorted_round_trip(spark, sf):
    path = work_path(spark, "sorted")
    src.write_sorted(_rows(spark, sf), path, ["study_id", "row_id"])
    return spark.read.parquet(path)


@query("SELECT row_id, study_id, CAST(CAST(beta AS FLOAT) AS DOUBLE) AS beta FROM dummy_processed_gwas")
def q_byte_stream_split(spark, sf):
    path = work_path(spark, "split")
    src.write_byte_stream_split(_rows(spark, sf).select("row_id", "study_id", F.col("beta").cast("float").alias("beta")), path, ["beta"])
    return src.scan_byte_stream_split(spark, path).withColumn("beta", F.col("beta").cast("double"))


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def q_text_to_parquet(spark, sf):
    path, target = work_path(spark, "raw"), work_path(spark, "converted")
    src.write(_nation(spark, sf), path, src.TextOut("\t"))
    src.convert(spark, path, src.ReadSpec(src.TextFormat("\t")), target, ["n_name", "n_nationkey"], {"n_nationkey": "bigint"})
    return spark.read.parquet(target)


@query(_NATION)
def q_folder(spark, sf):
    path = work_path(spark, "folder")
    _nation(spark, sf).repartition(4).write.parquet(path)
    return src.scan_folder(spark, path, "part-*.parquet", src.ReadSpec(src.ParquetFormat()))


@query("SELECT trait, count(*) AS studies, string_agg(study_id, ',' ORDER BY study_id) AS ids FROM study_info GROUP BY trait")
def q_sqlite(spark, sf):
    """The fixed table of studies as a one-machine SQLite file, read by tasks in ranges of an integer key."""
    path = Path(tempfile.mkdtemp()) / f"varloom-{spark.sparkContext.applicationId}.db"  # the driver's own file, shipped to the executors
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE s (k INTEGER, study_id TEXT, trait TEXT)")
        con.executemany("INSERT INTO s VALUES (?, ?, ?)", [(i, r["study_id"], r["trait"]) for i, r in enumerate(table(spark, sf, "study_info").collect())])
    d = src.scan_sqlite(spark, str(path), "SELECT k, study_id, trait FROM s", "k", 4)
    return d.groupBy("trait").agg(F.count("*").alias("studies"), F.array_join(F.array_sort(F.collect_list("study_id")), ",").alias("ids"))


@query("""SELECT CAST(r_regionkey AS INTEGER) + 1 AS "CHR", 'rs' || r_regionkey || x AS "SNP", CAST(10 + length(r_name) + x AS BIGINT) AS "BP", r_regionkey + x / 4.0 AS "L2", r_regionkey * 100.0 + 7 AS "M_5_50" FROM region, range(0, 3) t(x)""")
def q_ld_scores(spark, sf):
    path = work_path(spark, "ld")
    for r in table(spark, sf, "region").collect():
        k, n = int(r["r_regionkey"]), len(r["r_name"])
        lines = "".join(f"{k + 1}\trs{k}{x}\t{10 + n + x}\t{k + x / 4}\n" for x in range(3))
        src.put(f"{path}/{k}.l2.ldscore.gz", gzip.compress(f"CHR\tSNP\tBP\tL2\n{lines}".encode()))
        src.put(f"{path}/{k}.l2.M_5_50", f"{k * 100} 7\n".encode())
    return src.ld_scores(spark, path)


@query(f"""WITH {G} SELECT DISTINCT "CHR", "POS", "NEA" AS "REF", "EA" AS "ALT", "EAF" AS "AF" FROM g WHERE length("EA") = 1 AND length("NEA") = 1 AND "EA" IN ('A', 'C', 'G', 'T') AND "EAF" BETWEEN 0.3 AND 0.7""")
def q_vcf(spark, sf):
    path = work_path(spark, "vcf")
    g = gwas(spark, sf).where("EA is not null and NEA is not null and EAF is not null and not isnan(EAF)").select("CHR", "POS", "EA", "NEA", "EAF").distinct()
    chrom = F.when(F.col("CHR") == 23, "chrX").otherwise(F.concat(F.lit("chr"), F.col("CHR").cast("string")))
    g.select(F.concat_ws("\t", chrom, "POS", F.lit("."), "NEA", "EA", F.lit("."), F.lit("."), F.concat(F.lit("AC=1;AF="), F.col("EAF").cast("string")))).write.text(path)
    return src.vcf_variants(spark, path, 0.3)


@query(f"""WITH {A} SELECT "CHR", "POS", "EA", "NEA", "rsID" FROM a""")
def q_membership(spark, sf):
    path = work_path(spark, "members")
    half(spark, sf, True).select(F.col("rsID").alias("rsid"), F.col("EA").alias("a1"), F.col("NEA").alias("a2"), F.col("CHR").alias("chrom"), F.col("POS").alias("pos")).write.option("header", True).option("sep", "\t").csv(path)
    return src.membership(spark, path)


@query("SELECT CAST(r_regionkey AS INTEGER) AS archive, CAST(1000 + length(r_name) AS BIGINT) AS n FROM region")
def q_first_sample_size(spark, sf):
    path = work_path(spark, "tars")
    for r in table(spark, sf, "region").collect():
        body, out = gzip.compress(("CHROM GENPOS N\n" + f"1 5 {1000 + len(r['r_name'])}\n" * 50_000).encode()), io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo("d/p.gz")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        src.put(f"{path}/{r['r_regionkey']}.tar", out.getvalue())
    return src.first_sample_size(spark, f"{path}/*.tar").select(F.regexp_extract("path", r"(\d+)\.tar$", 1).cast("int").alias("archive"), "n")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 5")
def q_catalog(spark, sf):
    """Datasets with declared inputs: two sources, a piped one, their join."""
    spec = src.ReadSpec(src.ParquetFormat())
    catalog = dag.Catalog([
        dag.source("nation", f"{sf}/nation.parquet", spec), dag.source("region", f"{sf}/region.parquet", spec),
        dag.piped("some", "nation", [flt.at_least("n_nationkey", 5), identity, prj.cast_column("n_nationkey", "int")]), dag.joined("both", "some", "region", "inner", ["n_regionkey"], ["r_regionkey"]),
    ])
    return catalog.run(spark, ["both"])["both"].select("n_nationkey", "n_name", "r_name")


# Projection, filters, rows, strings.


@query("SELECT row_id, beta FROM dummy_processed_gwas")
def q_identity(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(composite([identity, composite([]), prj.select_columns("row_id", "beta"), observed("rows")]))


@query("SELECT CAST(row_id AS INTEGER) AS row_id, CAST(n AS INTEGER) AS n, beta FROM dummy_processed_gwas")
def q_ints_to_int32(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "n", "beta").transform(prj.ints_to_int32())


@query("SELECT row_id, beta / nullif(se, 0) AS z, eaf * 2 AS eaf, eaf AS old_eaf FROM dummy_processed_gwas")
def q_with_expressions(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").select("row_id", "beta", "se", "eaf").transform(prj.with_expressions(z="beta / nullif(se, 0)", eaf=F.col("eaf") * 2, old_eaf="eaf"))
    return d.select("row_id", "z", "eaf", "old_eaf")


@query("SELECT row_id, eaf AS \"INFO\" FROM dummy_processed_gwas WHERE eaf >= 0.6 AND NOT isnan(eaf)")
def q_info_score(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", F.col("eaf").alias("INFO")).transform(flt.info_score(0.6))


@query("SELECT row_id, chr, pos FROM dummy_processed_gwas WHERE chr = 2 AND pos BETWEEN 1000000 AND 90000000")
def q_within(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").select("row_id", "chr", "pos").transform(flt.within(flt.Interval(2, 1_000_000, 90_000_000, closed=True), "chr", "pos"))


@query("SELECT event_id, round(log10(value + 1), 9) AS value FROM events")
def q_shifted_log_all(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("value")).transform(sca.shifted_log(10, exclude=["event_id"])), "value", digits=9)


@query(f"""WITH {G} SELECT row_id, "BETA", "SE", round(pow(10.0, -"MLOG10P"), 8) AS "P" FROM g WHERE NOT isnan("MLOG10P")""")
def q_if_needed(spark, sf):
    """What is there stays, what is missing is made."""
    d = gwas(spark, sf).transform(flt.drop_nan("MLOG10P")).withColumn("OR", F.lit(3.0))
    d = d.transform(composite([sca.beta_from_odds_ratio(if_needed=True), sca.p_from_mlog10p(if_needed=True), sca.p_from_mlog10p(if_needed=True), sca.se_from_p(if_needed=True), sca.p_from_beta_se_if_needed()]))
    return rounded(d.select("row_id", "BETA", "SE", "P"), "P", digits=8)


@query("SELECT row_id, beta - 1.95::DOUBLE * se AS lower, beta + 1.95::DOUBLE * se AS upper FROM dummy_processed_gwas")
def q_effect_interval(spark, sf):
    return table(spark, sf, "dummy_processed_gwas").transform(sca.effect_interval("beta", "se")).select("row_id", "lower", "upper")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def q_top_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").transform(rows.top_rows(25, "o_totalprice"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS n FROM lineitem")
def q_row_number(spark, sf):
    return table(spark, sf, "lineitem").transform(rows.row_number_within(["l_orderkey"], ["l_extendedprice", "l_linenumber"])).select("l_orderkey", "l_linenumber", F.col("n").cast("bigint").alias("n"))


@query(r"""SELECT c_custkey, regexp_replace(c_name, '0', 'x') AS once, TRY_CAST(nullif(regexp_extract(c_name, '#0*([0-9]+)', 1), '') AS INTEGER) AS number FROM customer""")
def q_patterns(spark, sf):
    d = table(spark, sf, "customer").transform(composite([st.replace_first("c_name", "once", "0", "x"), st.extract_pattern("c_name", "number", "#0*([0-9]+)", "int")]))
    return d.select("c_custkey", "once", "number")


@query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS words FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) > 0")
def q_clean_list(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.array_append(F.array_prepend(F.split("p_name", " "), F.lit("")), F.lit(None).cast("string")).alias("words"))
    return d.transform(st.clean_list("words")).where("words is not null").select("p_partkey", "words")


# Joins.


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey")
def q_join_right(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return jn.join_tables(o, table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "right", ["o_custkey"], ["c_custkey"]).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "c_mktsegment")


@query("SELECT coalesce(o_custkey, c_custkey) AS k, o_orderkey, c_mktsegment FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0) FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def q_join_full(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    return jn.join_tables(o, c, "full", ["o_custkey"], ["c_custkey"]).select(F.col("o_custkey").alias("k"), "o_orderkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def q_join_anti(spark, sf):
    return jn.join_tables(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey"), "left_anti", ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_mktsegment")


# Summary statistics as one ordered step.

_INDEL = """length("EA") = 1 AND length("NEA") = 1"""
_AMBIGUOUS = """(least("EA", "NEA") || greatest("EA", "NEA")) IN ('AT', 'CG')"""
_MHC38 = """("CHR" = 6 AND "POS" >= 25726063 AND "POS" < 33400644)"""


@query(f"""WITH {G}, {A} SELECT row_id FROM g WHERE ("CHR", "POS") IN (SELECT ("CHR", "POS") FROM a) AND {_INDEL} AND NOT {_AMBIGUOUS} AND NOT {_MHC38} AND "CHR" NOT IN (23, 24)
AND NOT (substr(CAST("STATUS" AS VARCHAR), 6, 1) = '8' OR substr(CAST("STATUS" AS VARCHAR), 7, 1) IN ('7', '8'))""")
def q_sumstats_steps(spark, sf):
    names = {"CHR": "chr", "POS": "pos", "EA": "EA", "NEA": "NEA", "STATUS": "status", "row_id": "row_id", "EAF": "eaf"}
    raw = table(spark, sf, "dummy_processed_gwas").withColumns({"EA": F.upper("ea"), "NEA": F.upper("nea")})
    steps = sumstats.Steps(half(spark, sf, True), True, True, "38", True, {6: "8", 7: "78"})
    return raw.transform(sumstats.create(names, steps)).select("row_id")


@query(f"""WITH {A}, f AS (SELECT * FROM a WHERE {_INDEL} AND NOT {_AMBIGUOUS} AND NOT ("CHR" = 6 AND "POS" >= 25000000 AND "POS" < 34000000))
SELECT "rsID", "CHR", "POS" FROM f QUALIFY count(*) OVER (PARTITION BY "rsID") = 1""")
def q_for_correlation(spark, sf):
    return sumstats.for_correlation(half(spark, sf, True)).select("rsID", "CHR", "POS")


# Many tables on one index: studies stand for proteins.


def _index(spark, sf):
    return jn.with_row_id(half(spark, sf, True).select("CHR", "POS", "EA", "NEA", "rsID"), ["POS", "EA", "NEA"])


def _regenie(spark, sf):
    return gwas(spark, sf).where("study_id is not null").select(F.col("study_id").alias("protein"), F.col("CHR").alias("CHROM"), F.col("POS").alias("GENPOS"), F.col("NEA").alias("ALLELE0"), F.col("EA").alias("ALLELE1"), "BETA", "SE", F.lit(30_000).alias("N"))


_SLIM = f"""{A}, {G}, i AS (SELECT *, row_number() OVER (ORDER BY "CHR", "POS", "EA", "NEA") - 1 AS row_id FROM a),
u AS (SELECT study_id AS protein, "CHR", "POS", least("EA", "NEA") AS lo, greatest("EA", "NEA") AS hi, "EA" AS e, "BETA" AS b, "SE" AS s FROM g WHERE study_id IS NOT NULL AND "EA" IS NOT NULL AND "NEA" IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY study_id, "CHR", "POS", lo, hi ORDER BY b NULLS FIRST, s NULLS FIRST, e) = 1),
slim AS (SELECT protein, row_id, i."CHR", i."POS", CAST(CASE WHEN "EA" = e THEN b ELSE -b END AS FLOAT) AS beta, CAST(s AS FLOAT) AS se FROM i JOIN u ON i."CHR" = u."CHR" AND i."POS" = u."POS" AND lo = least("EA", "NEA") AND hi = greatest("EA", "NEA"))"""


@query(f"""WITH {_SLIM} SELECT protein, row_id, round(CAST(coalesce(beta, 'nan'::FLOAT) AS DOUBLE), 6) AS beta, round(CAST(coalesce(se, 'nan'::FLOAT) AS DOUBLE), 6) AS se FROM slim""")
def q_slim_proteins(spark, sf):
    d = prot.slim(_index(spark, sf), _regenie(spark, sf))
    return d.select("protein", "row_id", F.round(F.col("BETA").cast("double"), 6).alias("beta"), F.round(F.col("SE").cast("double"), 6).alias("se"))


def _protein_context(spark, sf):
    return _index(spark, sf).withColumns({"ld": (1 + F.col("POS") % 97).cast("double"), "ordinal": F.col("row_id")})


def _coordinates(spark, sf):
    return _regenie(spark, sf).groupBy("protein").agg(F.lit(2).alias("chrom"), F.lit(50_000_000).alias("start"), F.lit(60_000_000).alias("end"))


_CHI = f"""{_SLIM}, c AS (SELECT protein, "CHR", "POS", power(CAST(beta AS DOUBLE) / CASE WHEN se > 0 THEN CAST(se AS DOUBLE) END, 2) AS chi FROM slim WHERE NOT isnan(beta) AND NOT isnan(se)),
v AS (SELECT 'all' AS variant_set, * FROM c UNION ALL SELECT 'cis_excluded', * FROM c WHERE NOT ("CHR" = 2 AND "POS" BETWEEN 49000000 AND 61000000))"""


@query(f"""WITH {_CHI} SELECT protein, variant_set, round(avg(chi), 6) AS mean_chi2, round(median(chi) / 0.4549364231195724, 6) AS lambda_gc, count(*) AS n_kept FROM v WHERE chi <= 80 AND isfinite(chi) GROUP BY ALL""")
def q_protein_heritability(spark, sf):
    aligned = prot.slim(_index(spark, sf), _regenie(spark, sf))
    h = prot.heritability(aligned, _protein_context(spark, sf), _coordinates(spark, sf), M_TOTAL, n_blocks=N_BLOCKS)
    return rounded(h.select("protein", "variant_set", "mean_chi2", "lambda_gc", "n_kept"), "mean_chi2", "lambda_gc")


@query()
def q_protein_correlation(spark, sf):
    """Every study's correlation with the early half, all in one regression."""
    aligned = prot.slim(_index(spark, sf), _regenie(spark, sf))
    trait = half(spark, sf, True).select("CHR", "POS", "EA", "NEA", (F.col("BETA") / F.col("SE")).alias("z_t"), F.col("N").alias("n_t"))
    context = _protein_context(spark, sf).join(trait, ["CHR", "POS", "EA", "NEA"])
    c = prot.correlation(aligned, context, _coordinates(spark, sf), M_TOTAL, n_blocks=N_BLOCKS)
    return rounded(c.select("protein", "variant_set", "gcov", "rg", "n_snps"), "gcov", "rg")


# Gene tables and reports.


@query("SELECT CAST(id AS VARCHAR) AS gene_id, CAST(id % 22 AS VARCHAR) AS chrom, id * 10 + 2.5 AS pos, (id % 1000) / 1000.0 AS p, coalesce(symbol, CAST(id AS VARCHAR)) AS name FROM gene_symbol WHERE (id % 1000) / 1000.0 < 0.01")
def q_gene_results(spark, sf):
    g = table(spark, sf, "gene_symbol")
    genes = g.select(F.col("id").alias("GENE"), (F.col("id") % 22).alias("CHR"), (F.col("id") * 10).alias("START"), (F.col("id") * 10 + 5).alias("STOP"), ((F.col("id") % 1000) / 1000.0).alias("P"))
    return dn.gene_results(genes, g.select(F.col("id").alias("gene_id"), F.col("symbol").alias("name")))


@query("""WITH l AS (SELECT symbol, CAST(id % 22 AS VARCHAR) AS chrom, id * 10 + 2.5 AS pos, CAST(id AS VARCHAR) AS gene_id FROM gene_symbol WHERE symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY chrom, pos, gene_id) = 1)
SELECT l.gene_id, s.symbol AS name, l.chrom, l.pos, (s.id % 100) / 100.0 AS p FROM gene_symbol s JOIN l USING (symbol) WHERE (s.id % 100) / 100.0 < 0.1""")
def q_gene_p_values(spark, sf):
    g = table(spark, sf, "gene_symbol")
    places = g.select(F.col("id").alias("gene_id"), F.col("symbol").alias("name"), (F.col("id") % 22).alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    return dn.gene_p_values(g.select("symbol", ((F.col("id") % 100) / 100.0).alias("p")), places, "symbol", "p", "name")


@query("SELECT event_type, event_id FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 5)")
def q_types_with_cells(spark, sf):
    return agg.types_with_cells(table(spark, sf, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", 5).select("event_type", "event_id")


@query("WITH t AS (SELECT study_id AS p1, chr AS p2, avg(eaf) AS p FROM dummy_processed_gwas GROUP BY ALL) SELECT p1, p2, p <= 0.05 / 3 AS significant FROM t")
def q_significant_pairs(spark, sf):
    t = table(spark, sf, "dummy_processed_gwas").groupBy(F.col("study_id").alias("p1"), F.col("chr").alias("p2")).agg(F.avg("eaf").alias("p"))
    return agg.significant_pairs(t, 3).select("p1", "p2", "significant")


@query("""WITH d AS (SELECT l_orderkey AS m, 'v' || l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, (min(l_partkey) % 97 + 1) / 100.0 AS p FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber),
x AS (SELECT v, min(p) AS pm FROM d GROUP BY v)
SELECT m AS "MODEL", max(v) FILTER (k = 1) AS "VARIABLE_a", max(v) FILTER (k = 2) AS "VARIABLE_b", round(max(log10(p) / log10(pm)) FILTER (k = 1), 6) AS ps_a, round(max(log10(p) / log10(pm)) FILTER (k = 2), 6) AS ps_b FROM d JOIN x USING (v) GROUP BY m""")
def q_conditional_pairs(spark, sf):
    d = table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("MODEL"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("VARIABLE"), F.col("l_linenumber").alias("ordinal"), ((F.col("l_partkey") % 97 + 1) / 100.0).alias("P"))
    m = d.groupBy("VARIABLE").agg(F.min("P").alias("P"))
    return rounded(agg.conditional_pairs(d, m).select("MODEL", "VARIABLE_a", "VARIABLE_b", "ps_a", "ps_b"), "ps_a", "ps_b")


@query("SELECT n_nationkey AS k, 'a' AS tissue, n_nationkey * 2 AS value FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey FROM nation")
def q_from_wide(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 2).alias("a"), F.col("n_regionkey").alias("b")).transform(lab.from_wide("k"))


@query()
def q_lcv_posterior(spark, sf):
    """Posterior of the causality proportion between the two halves, from leave-one-out moments."""
    d, n = _context(spark, sf)
    estimates = causality.jackknife(d.select("ordinal", "ld", F.col("z_t").alias("z1"), F.col("z_p").alias("z2")), n, 20)
    defined = not estimates.loc[estimates["left_out"] >= 0, ["rho", "kappa1", "kappa2"]].isna().any().any()
    return spark.createDataFrame([(k, float(v)) for k, v in causality.posterior(estimates).items()] if defined else [], "name string, value double")


@query(f"""WITH {_CONTEXT}, f AS (SELECT *, z_t * z_t AS chi FROM j WHERE z_t * z_t <= greatest(0.001 * n_t, 80)),
c AS (SELECT *, least({N_BLOCKS - 1}, ((ord + 1) * {N_BLOCKS} + s - 2) // (s - 1) - 1) AS block FROM (SELECT *, row_number() OVER (ORDER BY "CHR", "POS", "EA", "NEA") - 1 AS ord, (SELECT count(*) FROM f) AS s FROM f)),
g AS (SELECT least(greatest({M_TOTAL} * (avg(chi) - 1) / avg(ld * n_t), 0), 1) AS tot, avg(n_t) AS nbar FROM c),
w AS (SELECT c.*, 1 / (2 * power(1 + tot * n_t / {M_TOTAL} * greatest(ld, 1), 2)) / greatest(ld, 1) AS w FROM c, g),
b5 AS (SELECT block, sum(w * ld * ld) AS a, sum(w * ld) AS b, sum(w) AS d, sum(w * ld * chi) AS e, sum(w * chi) AS f FROM w GROUP BY block),
t AS (SELECT sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(e) AS e, sum(f) AS f FROM b5),
l AS (SELECT (t.d * t.e - t.b * t.f) / (t.a * t.d - t.b * t.b) AS slope, ((t.d - b5.d) * (t.e - b5.e) - (t.b - b5.b) * (t.f - b5.f)) / ((t.a - b5.a) * (t.d - b5.d) - power(t.b - b5.b, 2)) AS loo FROM b5, t)
SELECT round(max(slope) * {M_TOTAL} / max(nbar), 6) AS h2, round(sqrt(var_samp({N_BLOCKS} * slope - {N_BLOCKS - 1} * loo)) * {M_TOTAL} / max(nbar) / sqrt({N_BLOCKS}), 6) AS h2_se FROM l, g""")
def q_exact_h2(spark, sf):
    d, _ = _context(spark, sf)
    t = d.select("ordinal", "ld", (F.col("z_t") * F.col("z_t")).alias("chi2"), F.col("n_t").alias("n"))
    return rounded(reg.exact_heritability(t, M_TOTAL, N_BLOCKS).select("h2", "h2_se"), "h2", "h2_se")


_KEPT = "c AS (SELECT *, z_t * z_t AS ct, z_p * z_p AS cp FROM k WHERE"


@query(SQL["q_ldsc_rg"].replace(_KEPT, f"k2 AS (SELECT * REPLACE (z_t * sqrt(1 + ld / 20) AS z_t, z_p * sqrt(1 + ld / 20) AS z_p) FROM k), {_KEPT.replace('FROM k', 'FROM k2')}"))
def q_ldsc_rg_heritable(spark, sf):
    """Correlation of two traits whose effects grow with the LD score, so that both heritabilities are above 0."""
    d, n = _context(spark, sf)
    grown = F.sqrt(1 + F.col("ld") / 20)
    d = d.withColumns({"z_t": F.col("z_t") * grown, "z_p": F.col("z_p") * grown, "pair": F.lit("t-p")})
    r = reg.genetic_correlation(d, ["pair"], n, M_TOTAL, N_BLOCKS).select("gcov", "h2_t", "h2_p", "rg", "rg_se", "z", "p")
    return rounded(rounded(r, "gcov", "h2_t", "h2_p", "rg", "rg_se", "p"), "z", digits=5)


@query()
def q_partitioned_h2(spark, sf):
    """Coefficients of two annotations that part the LD scores by position."""
    d, n = _context(spark, sf)
    t = d.select(F.lit("t").alias("trait"), "ordinal", "ld", (F.col("z_t") * F.col("z_t")).alias("chi2"), F.col("n_t").alias("n"), F.when(F.col("POS") % 2 == 0, F.col("ld")).otherwise(0.0).alias("even"), F.when(F.col("POS") % 3 == 0, F.col("ld")).otherwise(1.0).alias("third"))
    return rounded(reg.partitioned(t, ["trait"], ["even", "third"], n, M_TOTAL, N_BLOCKS).drop("trait"), "coefficient", "coefficient_se", "z", "p", digits=9)


# Downstream tables.


@query("SELECT trait AS name, studies, p, round(abs(log10(p)), 9) AS mlog10p, row_number() OVER (ORDER BY p, name) - 1 AS n FROM (SELECT 'T ' || row_number() OVER (ORDER BY study_id) AS trait, 1 AS studies, 1.0::DOUBLE / (1 + row_number() OVER (ORDER BY study_id)) AS p FROM study_info)")
def q_enrichment_points(spark, sf):
    ids = sorted(r["study_id"] for r in table(spark, sf, "study_info").select("study_id").collect())  # 39 rows, fixed
    d = spark.createDataFrame([(f"t_{i + 1}", 1.0 / (i + 2)) for i in range(len(ids))], "Name string, Coefficient_P_value double")
    return rounded(dn.enrichment_points(d).select("name", F.lit(1).alias("studies"), "p", F.abs("mlog10p").alias("mlog10p"), "n"), "mlog10p", digits=9)


@query("""WITH t AS (SELECT snpid, min(pow(10.0, -mlog10p)) AS p FROM dummy_processed_gwas WHERE mlog10p < 300 AND snpid IS NOT NULL GROUP BY 1)
SELECT snpid, round(abs(log10(p)), 9) AS mlog10p, p <= 0.05 / (SELECT count(*) FROM t) AS passes FROM t ORDER BY p, snpid LIMIT 20""")
def q_top_bars(spark, sf):
    t = gwas(spark, sf).where("MLOG10P < 300 and SNPID is not null").groupBy(F.col("SNPID").alias("snpid")).agg(F.min(F.pow(F.lit(10.0), -F.col("MLOG10P"))).alias("p"))
    return rounded(dn.top_bars(t, 20, "p", "snpid").select("snpid", F.abs("mlog10p").alias("mlog10p"), "passes"), "mlog10p", digits=9)


@query(f"""WITH {A} SELECT "CHR", "POS", "EA", "NEA", CAST("POS" % 1000 AS BIGINT) AS ordinal FROM a WHERE "CHR" = 3""")
def q_align_to_matrix(spark, sf):
    h = half(spark, sf, True)
    return dn.align_to_matrix(h, h.where("CHR = 3").withColumn("ordinal", (F.col("POS") % 1000).cast("bigint"))).select("CHR", "POS", "EA", "NEA", "ordinal")


@query("SELECT row_id FROM dummy_processed_gwas WHERE NOT coalesce(eaf > 0.5 AND abs(beta) > 0.02, false)")
def q_consistent_variants(spark, sf):
    d = table(spark, sf, "dummy_processed_gwas").select(F.col("row_id").alias("ordinal"), F.col("eaf").alias("logLR"), F.col("beta").alias("z"))
    return dn.consistent_variants(d, d, 0.5, 0.02).select(F.col("ordinal").alias("row_id"))


@query("SELECT l_linenumber AS set, l_orderkey AS ordinal, CAST(max(l_discount) AS DOUBLE) AS alpha, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY ALL")
def q_credible_sets(spark, sf):
    m = table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_linenumber").alias("set"), F.col("l_orderkey").alias("ordinal")).agg(F.max("l_discount").cast("double").alias("alpha"))
    return dn.credible_sets(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), "o_orderstatus"), m.select("set", "ordinal"), m).select("set", "ordinal", "alpha", "o_orderstatus")


@query("SELECT row_id FROM dummy_processed_gwas WHERE beta > 0 AND eaf <= 0.3")
def q_steiger_kept(spark, sf):
    return dn.steiger_kept(table(spark, sf, "dummy_processed_gwas").select("row_id", (F.col("beta") > 0).alias("steiger_dir"), F.col("eaf").alias("steiger_pval")), 0.3).select("row_id")


@query("SELECT id, id % 22 AS chrom, id * 10 AS start, id * 10 + 25 AS end FROM gene_symbol WHERE id % 22 = 3 AND id * 10 + 25 >= 500 AND id * 10 <= 9000")
def q_overlapping_genes(spark, sf):
    g = table(spark, sf, "gene_symbol").select("id", (F.col("id") % 22).alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 25).alias("end"))
    return itv.overlapping(g, 3, 500, 9000)


@query("SELECT c_custkey, regexp_replace(c_name, '^Customer#', '') AS c_name FROM customer")
def q_remove_prefix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").transform(st.remove_prefix("c_name", "Customer#"))


@query("""WITH s AS (SELECT study_id, string_agg(DISTINCT trait, ',') AS t, count(*) AS matches FROM study_info GROUP BY study_id) SELECT study_id, matches FROM s""")
def q_exactly_one(spark, sf):
    """Every study named by the statistics' own table of studies is matched once."""
    s = table(spark, sf, "study_info").select("study_id", F.lit(None).cast("string").alias("trait"))
    return jn.exactly_one(s, table(spark, sf, "study_info").select("study_id", "trait"), ["study_id", "trait"]).select("study_id", "matches")


@query(f"""WITH {A}, s AS (SELECT 'chr' || chr AS chrom, pos - 1 AS start, snpid AS name FROM dummy_processed_gwas WHERE chr <= 22 AND length(ea) = 1 AND length(nea) = 1 GROUP BY ALL)
SELECT a."CHR", a."POS", a."EA", a."NEA", s.name AS "rsID" FROM a JOIN s ON s.chrom = 'chr' || a."CHR" AND s.start + 1 = a."POS" WHERE length("EA") = 1 AND length("NEA") = 1""")
def q_assign_rsids(spark, sf):
    t = table(spark, sf, "dummy_processed_gwas").where("chr <= 22")
    kind = F.when((F.length("ea") == 1) & (F.length("nea") == 1), "single").otherwise("other")
    snps = t.select(F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("chrom"), (F.col("pos") - 1).alias("chromStart"), F.col("snpid").alias("name"), kind.alias("class")).distinct()
    v = half(spark, sf, True).select("CHR", "POS", "EA", "NEA")
    return jn.assign_rsids(v, snps, {f"chr{c}": c for c in range(1, 23)}).select("CHR", "POS", "EA", "NEA", "rsID")


@query(f"""WITH {A} SELECT row_number() OVER (ORDER BY "CHR", "POS", "EA", "NEA") - 1 AS ordinal, "rsID", CAST("POS" % 7 AS DOUBLE) AS ld FROM a
WHERE NOT coalesce((least("EA", "NEA") || greatest("EA", "NEA")) IN ('AT', 'CG'), false) AND NOT ("CHR" = 6 AND "POS" BETWEEN 25726063 AND 33400644)""")
def q_ldsc_context(spark, sf):
    index = _index(spark, sf).withColumn("is_strand_ambiguous", har.is_ambiguous_snv())
    ld = half(spark, sf, True).groupBy(F.col("rsID").alias("SNP")).agg(F.max(F.col("POS") % 7).cast("double").alias("L2"))
    return reg.ldsc_context(index, ld).select("ordinal", "rsID", "ld")


@query("SELECT n_nationkey AS \"GENE\", n_regionkey * 2 AS b FROM nation")
def q_significant_columns(spark, sf):
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("GENE"), F.col("n_regionkey").alias("a"), (F.col("n_regionkey") * 2).alias("b"))
    return agg.significant_columns(spark.createDataFrame([("a", 0.04), ("b", 0.001)], "VARIABLE string, P double"), m)

"""Reading, writing, catalog and ingest."""

import gzip
import io
import sqlite3
import tarfile

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from varloom.plans.dag import Catalog, Dataset, joined, piped, source
from varloom.operators import filters as flt
from varloom.sources import archives
from varloom.sources import tables as src
from varloom.streaming.ingest import ingest_new_files


def test_text(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("junk\n#c\nx\ty\n1\tNA\n2\tb\n")
    spec = src.ReadSpec(src.TextFormat("\t", ("NA",), {"x": "int"}, skip_rows=2))
    d = src.scan(spark, str(p), spec)
    assert d.dtypes == [("x", "int"), ("y", "string")] and [tuple(r) for r in d.collect()] == [(1, None), (2, "b")]
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / f"many/{k}.tsv").write_text(f"junk{k}\n#c\nx\ty\n" + "".join(f"{10 * k + i}\tv\n" for i in range(5)))
    many = src.scan(spark, str(tmp_path / "many"), spec)
    assert sorted(r["x"] for r in many.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
    plain = src.scan(spark, str(tmp_path / "many/0.tsv"), src.ReadSpec(src.TextFormat("\t", skip_rows=2)))
    assert plain.dtypes == [("x", "int"), ("y", "string")] and plain.count() == 5
    src.convert(spark, str(p), spec, str(tmp_path / "o"), ["x"], {"x": "bigint"})
    assert src.scan(spark, str(tmp_path / "o"), src.ReadSpec(src.ParquetFormat())).dtypes == [("x", "bigint")]
    src.write(d, str(tmp_path / "c"), src.TextOut("\t", one_file=True))
    assert len(list((tmp_path / "c").glob("part*"))) == 1


def test_whitespace(spark, tmp_path):
    p = tmp_path / "a.txt.gz"
    with gzip.open(p, "wt") as f:
        f.write("# note\nA  B\tC\n 1 x  2.5\n\n3   y 4\n")
    d = src.scan(spark, str(p), src.ReadSpec(src.WhitespaceFormat("#", types={"A": "int", "C": "double"})))
    assert [tuple(r) for r in d.collect()] == [(1, "x", 2.5), (3, "y", 4.0)]
    q = tmp_path / "b.txt"
    q.write_text("A B\n1 2\n3\n")
    with pytest.raises(PySparkException):
        src.scan(spark, str(q), src.ReadSpec(src.WhitespaceFormat())).collect()
    q.write_text("A\n1\nx\n")
    with pytest.raises(PySparkException):
        src.scan(spark, str(q), src.ReadSpec(src.WhitespaceFormat(types={"A": "int"}))).collect()


def test_ld_scores_and_vcf(spark, tmp_path):
    for c in (1, 2):
        with gzip.open(tmp_path / f"{c}.l2.ldscore.gz", "wt") as f:
            f.write(f"CHR\tSNP\tBP\tL2\n{c}\trs{c}b\t20\t1.5\n{c}\trs{c}a\t10\t2.5\n")
        (tmp_path / f"{c}.l2.M_5_50").write_text(f"{c * 100} {c}\n")
    d = src.ld_scores(spark, str(tmp_path))
    assert [(r["SNP"], r["M_5_50"]) for r in d.collect()] == [("rs1a", 101.0), ("rs1b", 101.0), ("rs2a", 202.0), ("rs2b", 202.0)]
    assert src.total_per_chromosome(d).first()[0] == 303.0
    with pytest.raises(PySparkException):
        src.total_per_chromosome(d.withColumn("M_5_50", F.rand())).collect()
    (tmp_path / "2.l2.M_5_50").unlink()
    with pytest.raises(PySparkException):
        src.ld_scores(spark, str(tmp_path)).collect()
    v = tmp_path / "v.vcf"
    v.write_text("##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tG\t.\t.\tAC=1;AF=0.2\nchrX\t6\t.\tA\tGT\t.\t.\tAF=0.2\n2\t7\t.\tA\tC\t.\t.\tAF=0.001\n")
    assert [tuple(r) for r in src.vcf_variants(spark, str(v), 0.01).collect()] == [(1, 5, "A", "G", 0.2)]


def test_sqlite_and_markdown(spark, tmp_path):
    db = tmp_path / "x.db"
    con = sqlite3.connect(db)
    con.executescript("create table g(id int, s text); insert into g values (1,'b'),(1,'a'),(2,'c');")
    con.commit()
    con.close()
    d = src.scan_sqlite(spark, str(db), "select id, group_concat(s) as l from (select * from g order by s) group by id order by id")
    assert [tuple(r) for r in d.collect()] == [(1, "a,b"), (2, "c")]
    rows = src.scan_sqlite(spark, str(db), "select id, s from g", key="id", parts=2)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (1, "b"), (2, "c")]
    assert src.markdown(d.where("id = 2")) == "| id | l |\n| --- | --- |\n| 2 | c |\n"
    with pytest.raises(ValueError):
        src.markdown(d, most=1)


def test_byte_stream_split(spark, tmp_path):
    d = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") / 7).cast("float").alias("v"))
    src.write_byte_stream_split(d, str(tmp_path / "b"), ["v"])
    f = next((tmp_path / "b").glob("*.parquet"))
    meta = pq.ParquetFile(f).metadata.row_group(0)
    enc = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(2)}
    assert "BYTE_STREAM_SPLIT" in enc["v"] and "BYTE_STREAM_SPLIT" not in enc["k"]
    back = src.scan_byte_stream_split(spark, str(tmp_path / "b"))
    assert back.dtypes == d.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))


def test_sample_size_from_archive(spark, tmp_path):
    inner = gzip.compress(b"CHROM GENPOS N\n1 5 34000\n")
    with tarfile.open(tmp_path / "p.tar", "w") as t:
        info = tarfile.TarInfo("d/p.gz")
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    assert src.first_sample_size(spark, str(tmp_path / "p.tar")).first()["n"] == 34000


def test_archives(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("hello")
    z = archives.zip_folder(tmp_path / "d", tmp_path / "z.zip")
    assert (archives.unzip(z, tmp_path / "u") / "a.txt").read_text() == "hello"
    with pytest.raises(ValueError):
        archives.checked_copy(tmp_path / "d/a.txt", tmp_path / "c.txt", "0" * 32)
    assert not (tmp_path / "c.txt").exists()
    assert archives.promote(tmp_path / "d", "a.txt", tmp_path / "p.txt").read_text() == "hello"


def test_catalog(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,2\n2,30\n")
    spec = src.ReadSpec(src.TextFormat(types={"k": "int", "v": "int"}))
    store = tmp_path / "store"
    store.mkdir()

    def catalog(least=10):
        return Catalog([source("t", str(tmp_path / "t.csv"), spec), piped("big", "t", [flt.at_least("v", least)], keep=True), joined("both", "big", "t", "inner", ["k"], ["k"], keep=True)], str(store))

    c = catalog()
    assert c.run(spark, ["both"])["both"].count() == 1 and c.built == ["big", "both"]
    assert c.run(spark, ["both"])["both"].count() == 1 and c.built == []
    c.run(spark, ["both"], must_rebuild=["big"])
    assert c.built == ["big", "both"]
    c = catalog(least=1)
    assert c.run(spark, ["both"])["both"].count() == 2 and c.built == ["big", "both"]
    (tmp_path / "t.csv").write_text("k,v\n1,2\n2,30\n3,40\n")
    c.run(spark, ["both"])
    assert c.built == ["big", "both"]
    with pytest.raises(ValueError):
        Catalog([Dataset("a", lambda s, d: d["b"], ("b",)), Dataset("b", lambda s, d: d["a"], ("a",))]).order(["a"])
    with pytest.raises(KeyError):
        Catalog([Dataset("a", lambda s, d: d["t"])]).run(spark, ["a"])
    with pytest.raises(ValueError):
        c.add(Dataset("t", lambda s, d: d))


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "in"), "k int, v string", str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in/a.csv").write_text("1,x\n2,y\n")
    ingest_new_files(spark, *args)
    (tmp_path / "in/b.csv").write_text("3,z\n")
    ingest_new_files(spark, *args)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_registered_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p3_found", "q_meta_analysis"} <= set(q)

"""Reading and writing tables by a format kept with the data's description."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from varloom.operators.pipe import Pipe, identity
from varloom.session import broadcast_if_small


@dataclass(frozen=True)
class TextFormat:
    """Delimited text. skip_rows counts physical lines before every file's header; types override inference, which looks at the head only; a later value that does not fit raises."""

    separator: str = ","
    null_values: Sequence[str] = ("",)
    types: dict[str, str] = field(default_factory=dict)
    column_names: Sequence[str] | None = None
    has_header: bool = True
    skip_rows: int = 0
    comment: str | None = None


@dataclass(frozen=True)
class WhitespaceFormat:
    """Text separated by any white space."""

    comment: str | None = None
    column_names: Sequence[str] | None = None
    types: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ParquetFormat:
    """Parquet."""


@dataclass(frozen=True)
class ReadSpec:
    """The format a dataset is kept in."""

    format: TextFormat | WhitespaceFormat | ParquetFormat


def _nulls(c: str, values: Sequence[str]):
    return F.when(F.col(c).isin(list(values)), F.lit(None)).otherwise(F.col(c))


def scan(spark: SparkSession, path: str | Sequence[str], spec: ReadSpec) -> DataFrame:
    """Any supported format as a lazy DataFrame."""
    f = spec.format
    paths = [path] if isinstance(path, str) else list(path)
    if isinstance(f, ParquetFormat):
        return spark.read.parquet(*paths)
    if isinstance(f, WhitespaceFormat):
        return scan_whitespace(spark, paths, f)
    options = {"sep": f.separator, "mode": "FAILFAST", "nullValue": f.null_values[0] if f.null_values else ""} | ({"comment": f.comment} if f.comment else {})
    names, schema = _head_schema(spark, paths, f, options)
    if f.skip_rows:
        # a file's first rows are in the split that begins at 0 and are dropped there, batch by batch
        lines = spark.read.text(paths).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
        kept = lines.mapInArrow(_without_first(f.skip_rows + f.has_header), "value string").where(F.trim("value") != "")
        if f.comment:
            kept = kept.where(~F.startswith("value", F.lit(f.comment)))
        df = kept.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
    else:
        df = spark.read.options(**options).option("header", f.has_header).option("enforceSchema", False if f.has_header and not f.column_names else True).schema(schema).csv(paths)
    df = df.toDF(*names)
    for v in f.null_values[1:]:
        df = df.select(*(_nulls(c, [v]).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    return df.withColumns({c: F.col(c).cast(t) for c, t in f.types.items() if c in df.columns}) if f.types else df


#: Lines at the head of the first file from which names and types are taken.
HEAD_LINES = 1000


def _head_schema(spark: SparkSession, paths: Sequence[str], f: TextFormat, options: dict[str, str]) -> tuple[list[str], str]:
    """(column names, DDL) from the first HEAD_LINES lines; with given types all other columns are strings. The tables themselves are not read twice."""
    lines = [r[0] for r in spark.read.text(sorted(paths)[0] if len(paths) > 1 else paths[0]).limit(f.skip_rows + HEAD_LINES).collect()][f.skip_rows :]
    reader = spark.read.options(**options).option("header", f.has_header).option("inferSchema", not f.types)
    head = reader.csv(spark.sparkContext.parallelize(lines, 1))
    names = list(f.column_names) if f.column_names else head.columns
    return names, ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in zip(head.columns, (t for _, t in head.dtypes), strict=True))


def _without_first(n: int):
    """Drops the first n lines of every file from batches of (value, file, start)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[str, int] = {}
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            at = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False) == 0)
            codes = b.column(1).dictionary_encode()
            numbers = codes.indices.to_numpy(zero_copy_only=False)[at]
            for k, name in enumerate(codes.dictionary.to_pylist()):
                rows = at[numbers == k]
                before = seen.get(name, 0)
                keep[rows[: max(0, n - before)]] = False
                seen[name] = before + len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], ["value"])

    return run


def scan_whitespace(spark: SparkSession, paths: Sequence[str], f: WhitespaceFormat) -> DataFrame:
    """White-space separated lines, split by tasks. Without given names the first line that is no comment names the columns.

    A line with another number of fields raises; a value that does not fit its type raises.
    """
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    if f.comment:
        lines = lines.where(~F.startswith(F.ltrim("value"), F.lit(f.comment)))
    names = list(f.column_names) if f.column_names else re.split(r"\s+", lines.first()["value"].strip())
    parts = F.split(F.trim("value"), r"\s+")
    if not f.column_names:
        lines = lines.where(F.array_join(parts, " ") != " ".join(names))
    right = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))).cast("array<string>"))
    return lines.select(right.alias("p")).select(*(F.get("p", F.lit(i)).cast(f.types.get(n, "string")).alias(n) for i, n in enumerate(names)))


@dataclass(frozen=True)
class ParquetOut:
    """Codec, level and columns written without dictionary (so that their own encoding counts)."""

    compression: str = "zstd"
    level: int | None = None
    no_dictionary: Sequence[str] = ()
    partition_by: Sequence[str] = ()


@dataclass(frozen=True)
class TextOut:
    """Delimited text with a header; one_file brings everything into one part."""

    separator: str = ","
    header: bool = True
    one_file: bool = False


def write(df: DataFrame, path: str, out: ParquetOut | TextOut, mode: str = "error") -> None:
    """The single sink."""
    if isinstance(out, TextOut):
        (df.coalesce(1) if out.one_file else df).write.mode(mode).option("sep", out.separator).option("header", out.header).csv(path)
        return
    w = df.write.mode(mode).option("compression", out.compression)
    if out.level is not None:
        w = w.option("parquet.compression.codec.zstd.level", out.level)
    for c in out.no_dictionary:
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    if out.partition_by:
        w = w.partitionBy(*out.partition_by)
    w.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], out: ParquetOut = ParquetOut(), mode: str = "error") -> None:
    """Range-partitioned and sorted by the keys, so that row groups can be skipped by their statistics."""
    write(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, out, mode)


def write_byte_stream_split(df: DataFrame, path: str, float_columns: Sequence[str], level: int | None = None) -> None:
    """Parquet with byte-stream-split float columns, written by the tasks' Arrow writer, a file per partition into the folder `path` of a shared file system that Arrow knows."""
    names = df.columns

    def part(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        where, folder = open_path(path)
        where.create_dir(folder, recursive=True)
        out, n = None, 0
        ctx = TaskContext.get()
        final = f"{folder}/part-{ctx.partitionId():05d}.parquet"
        work = f"{folder}/_{ctx.partitionId():05d}.{ctx.taskAttemptId()}.tmp"  # readers pass over names with _
        for b in batches:
            if out is None:
                out = pq.ParquetWriter(work, b.schema, filesystem=where, compression="zstd", compression_level=level, use_dictionary=[c for c in names if c not in float_columns], use_byte_stream_split=list(float_columns))
            out.write_batch(b)
            n += b.num_rows
        if out is not None:
            out.close()
            where.move(work, final)  # a repeated attempt replaces the file by the same content
        yield pa.RecordBatch.from_pydict({"rows": [n]}, pa.schema([("rows", pa.int64())]))

    df.mapInArrow(part, "rows bigint").agg(F.sum("rows")).collect()


def scan_byte_stream_split(spark: SparkSession, path: str, rows_at_once: int = 65_536) -> DataFrame:
    """A folder of Parquet files with byte-stream-split columns, which the JVM's vectorised reader refuses: tasks read a file each by Arrow."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches):
        import pyarrow.parquet as pq

        for b in batches:
            for p in b.column(0).to_pylist():
                where, name = open_path(p)
                yield from pq.ParquetFile(name, filesystem=where).iter_batches(rows_at_once)

    import pyarrow.parquet as pq

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    one = files.first()
    if one is None:
        raise ValueError(f"no Parquet file in {path}")
    where, name = open_path(one["path"])
    kind = from_arrow_schema(pq.read_schema(name, filesystem=where))
    return files.repartition("path").mapInArrow(read, kind)


def open_path(path: str):
    """(file system, path within it) of a URL or plain path."""
    from pyarrow import fs

    plain = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(plain)


def put(path: str, content: bytes) -> str:
    """Writes one small file, made by the driver, to a shared file system."""
    where, name = open_path(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name, compression=None) as out:
        out.write(content)
    return path


def convert(spark: SparkSession, source: str, spec: ReadSpec, target: str, select: Sequence[str] | None = None, types: dict[str, str] | None = None, out: ParquetOut = ParquetOut(), mode: str = "error") -> None:
    """Text to Parquet with chosen columns and types."""
    df = scan(spark, source, spec)
    if select:
        df = df.select(*select)
    write(df.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()}), target, out, mode)


def scan_folder(spark: SparkSession, folder: str, glob: str, spec: ReadSpec) -> DataFrame:
    """All files of a folder that match, as one table."""
    if isinstance(spec.format, ParquetFormat):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(folder)
    if isinstance(spec.format, WhitespaceFormat):
        return scan_whitespace(spark, [f"{folder}/{glob}"], spec.format)
    return scan(spark, f"{folder}/{glob}", spec)


def sql_over(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """A user's SELECT over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def scan_sqlite(spark: SparkSession, path: str, query: str, key: str | None = None, parts: int = 8, schema: str | None = None) -> DataFrame:
    """A SELECT over an SQLite file, read by tasks: the file is shipped to the executors, and an integer column `key` of the
    result splits it into `parts` ranges (rows without a key go with the first). Types are those of the first 1,000 rows if no schema is given.
    """
    import os
    import sqlite3

    import pandas as pd
    from pyspark import SparkFiles

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        kind = schema or spark.createDataFrame(pd.read_sql_query(f"SELECT * FROM ({query}) LIMIT 1000", con)).schema
        low, high = con.execute(f'SELECT min("{key}"), max("{key}") FROM ({query})').fetchone() if key else (None, None)
    if low is None:
        ranges = [(None, None)]
    else:
        step = max(1, -(-(high - low + 1) // parts))
        ranges = [(a, a + step) for a in range(low, high + 1, step)]
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def read(frames):
        for f in frames:
            for a, b in zip(f["a"], f["b"], strict=True):
                where = "" if pd.isna(a) else f' WHERE ("{key}" >= {int(a)} AND "{key}" < {int(b)})' + (f' OR "{key}" IS NULL' if a == low else "")
                with sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True) as con:
                    yield from pd.read_sql_query(f"SELECT * FROM ({query}){where}", con, chunksize=50_000)

    return spark.createDataFrame(ranges, "a bigint, b bigint").repartition(len(ranges), "a").mapInPandas(read, kind)


def ld_scores(spark: SparkSession, folder: str, glob: str = "*.l2.ldscore.gz", sibling: str = ".l2.M_5_50") -> DataFrame:
    """Per-chromosome LD scores (CHR, SNP, BP, L2), each with the sum of the numbers in its sibling file as M_5_50; sorted. A missing sibling raises."""
    base = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.l2\.", 1)
    df = spark.read.option("sep", "\t").option("header", True).schema("CHR int, SNP string, BP bigint, L2 double").csv(f"{folder}/{glob}").withColumn("_f", base)
    m = spark.read.text(f"{folder}/*{sibling}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.l2\.", 1).alias("_f"), sum_of_numbers("value").alias("M_5_50"))
    j = df.join(broadcast_if_small(m), "_f", "left")
    checked = F.when(F.col("M_5_50").isNull(), F.raise_error(F.concat(F.lit("no sibling file for "), F.col("_f"))).cast("double")).otherwise(F.col("M_5_50"))
    return j.withColumn("M_5_50", checked).drop("_f").orderBy("CHR", "BP")


def sum_of_numbers(column: str):
    """Sum of the white-space separated numbers of a text."""
    return F.aggregate(F.transform(F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != ""), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)


def total_per_chromosome(df: DataFrame, column: str = "M_5_50") -> DataFrame:
    """Sum over chromosomes of a value that is the same within each; differing values raise."""
    g = df.groupBy("CHR").agg(F.count_distinct(column).alias("k"), F.max(column).alias("m"))
    return g.agg(F.sum(F.when(F.col("k") == 1, F.col("m")).otherwise(F.raise_error(F.lit("the value varies within a chromosome")).cast("double"))).alias(column))


def vcf_variants(spark: SparkSession, path: str, least_maf: float) -> DataFrame:
    """Biallelic single-base variants of a VCF with AF in [least, 1 - least]: CHR, POS, REF, ALT, AF. X, Y and MT are 23, 24 and 25; other names raise."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    p = F.split("value", "\t")
    chrom = F.regexp_replace(F.get(p, F.lit(0)), "^chr", "")
    code = F.when(chrom == "X", "23").when(chrom == "Y", "24").when(chrom.isin("MT", "M"), "25").otherwise(chrom).cast("int")
    af = F.regexp_extract(F.get(p, F.lit(7)), r"(?:^|;)AF=([0-9.eE+-]+)", 1)
    v = lines.select(code.alias("CHR"), F.get(p, F.lit(1)).cast("int").alias("POS"), F.get(p, F.lit(3)).alias("REF"), F.get(p, F.lit(4)).alias("ALT"), F.when(af != "", af).cast("double").alias("AF"))
    return v.where((F.length("REF") == 1) & (F.length("ALT") == 1) & F.col("ALT").isin("A", "C", "G", "T") & F.col("AF").between(least_maf, 1 - least_maf))


def membership(spark: SparkSession, path: str) -> DataFrame:
    """SNP list (rsid, a1, a2, chrom, pos) as CHR, POS, EA, NEA, rsID."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    return d.select(F.col("chrom").cast("int").alias("CHR"), F.col("pos").cast("int").alias("POS"), F.col("a1").alias("EA"), F.col("a2").alias("NEA"), F.col("rsid").alias("rsID"))


def first_sample_size(spark: SparkSession, path: str, column: str = "N") -> DataFrame:
    """(path, n) of tar archives of gzipped white-space tables, from the first member's first row; n is null where there is no such member.

    The listing names the files only; a task opens each by its path (any file system Arrow knows) and reads as far as
    the first member's head, some 64 KB, whatever the archive's size.
    """

    def heads(frames):
        import tarfile
        import zlib

        import pandas as pd
        for f in frames:
            out = []
            for p in f["path"]:
                n = None
                where, name = open_path(p)
                with where.open_input_file(name) as raw, tarfile.open(fileobj=raw, mode="r|", bufsize=16_384) as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(".gz"):
                            text = zlib.decompressobj(31).decompress(tar.extractfile(member).read(32_768)).decode(errors="replace")
                            head, row = (x.split() for x in text.split("\n")[:2])
                            n = int(float(row[head.index(column)]))
                            break
                out.append((p, n))
            yield pd.DataFrame({"path": pd.Series([x[0] for x in out], dtype=object), "n": pd.Series([x[1] for x in out], dtype="Int64")})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(heads, "path string, n bigint")


def markdown(df: DataFrame, most: int = 1000, pipe: Pipe = identity) -> str:
    """A small result as a Markdown table; more than `most` rows raise."""
    d = df.transform(pipe)
    rows = d.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows]
    lines = [d.columns, ["---"] * len(d.columns), *cells]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"



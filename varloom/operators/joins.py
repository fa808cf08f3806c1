"""Joins, unions and index building."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators.pipe import Pipe, identity
from varloom.operators.rows import unique_rows
from varloom.session import broadcast_if_small, cut


def join_tables(left: DataFrame, right: DataFrame, how: str, left_on: Sequence[str], right_on: Sequence[str], left_pipe: Pipe = identity, right_pipe: Pipe = identity, out_pipe: Pipe = identity, suffix: str = "_right") -> DataFrame:
    """Equi-join. The right keys are dropped (but for right and full joins, where the keys are merged); other clashing names get the suffix. Null keys match nothing."""
    a, b = left.transform(left_pipe), right.transform(right_pipe)
    rest = [c for c in b.columns if c not in right_on]
    taken = set(a.columns)
    renamed = {c: c + suffix if c in taken else c for c in rest}
    b = b.select(*(F.col(k).alias(f"_rk{i}") for i, k in enumerate(right_on)), *(F.col(c).alias(n) for c, n in renamed.items()))
    on = reduce(lambda x, y: x & y, [a[k] == b[f"_rk{i}"] for i, k in enumerate(left_on)])
    j = a.join(b, on, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return j.transform(out_pipe)
    keys = {k: f"_rk{i}" for i, k in enumerate(left_on)}
    merged = how in ("right", "right_outer", "full", "outer", "full_outer")
    cols = [F.coalesce(F.col(c), F.col(keys[c])).alias(c) if merged and c in keys else F.col(c) for c in a.columns]
    return j.select(*cols, *renamed.values()).transform(out_pipe)


def join_memory_table(table: pd.DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> Pipe:
    """Inner join with a table in the driver's memory; its rows decide whether it is broadcast."""

    def run(df: DataFrame) -> DataFrame:
        right = df.sparkSession.createDataFrame(table)
        return join_tables(df, broadcast_if_small(right, len(table)), "inner", left_on, right_on)

    return run


def allow_list(df: DataFrame, allowed: DataFrame, left_on: str = "ID", right_on: str = "ID") -> DataFrame:
    """Rows whose key is in the list, with the list's columns and multiplicity."""
    return join_tables(df, allowed, "inner", [left_on], [right_on])


def semi_filter(df: DataFrame, wanted: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows whose key occurs in the other table, once each."""
    return join_tables(df, wanted.select(right_on), "left_semi", [left_on], [right_on])


def concat_tables(tables: Sequence[DataFrame], pipes: Sequence[Pipe] | None = None, casts: dict[str, str] | None = None) -> DataFrame:
    """UNION ALL of tables with the same columns; other columns or types raise ValueError."""
    done = []
    for i, t in enumerate(tables):
        t = t.transform(pipes[i]) if pipes else t
        done.append(t.withColumns({c: F.col(c).cast(k) for c, k in (casts or {}).items() if c in t.columns}))
    for t in done[1:]:
        if sorted(t.dtypes) != sorted(done[0].dtypes):
            raise ValueError(f"tables differ: {sorted(set(t.dtypes) ^ set(done[0].dtypes))}")
    return reduce(DataFrame.unionByName, done)


def combine_lists(sources: dict[str, tuple[DataFrame, str]], key: str = "gene", name: str = "sources") -> DataFrame:
    """key -> names of the sources that hold it, in the sources' order. A key repeated in a source counts once."""
    rows = [t.select(F.col(c).alias(key)).where(F.col(key).isNotNull()).distinct().select(key, F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (s, (t, c)) in enumerate(sources.items())]
    grouped = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("l"))
    return grouped.select(key, F.col("l.s").alias(name))


def set_combinations(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """combination (names of sources) -> number of elements in exactly these: the counts behind an UpSet plot."""
    each = combine_lists(sources, "element")
    return each.groupBy(F.array_join("sources", "&").alias("combination")).agg(F.count(F.lit(1)).alias("elements"))


def allele_key(a: str, b: str) -> Column:
    """Key of an unordered pair of alleles; null if either is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("_", F.least(a, b), F.greatest(a, b)))


def attach_rsid(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Left join of variants (CHR, POS, REF, ALT) with rsIDs (CHR, POS, EA, NEA, rsID) whatever the allele order; of several rsIDs the smallest."""
    r = reference.select("CHR", "POS", allele_key("EA", "NEA").alias("key"), "rsID").where("key is not null")
    r = r.groupBy("CHR", "POS", "key").agg(F.min("rsID").alias("rsID"))
    return variants.withColumn("key", allele_key("REF", "ALT")).join(r, ["CHR", "POS", "key"], "left").drop("key")


def assign_rsids(variants: DataFrame, snps: DataFrame, chroms: dict[str, int]) -> DataFrame:
    """rsIDs by position from a SNP table (chrom, chromStart zero-based, name, class): single-base variants and class "single" only."""
    names = F.create_map(*(F.lit(x) for pair in chroms.items() for x in pair))
    s = snps.where((F.col("class") == "single") & F.col("chrom").isin(list(chroms)))
    s = s.select(names[F.col("chrom")].alias("CHR"), (F.col("chromStart") + 1).alias("POS"), F.col("name").alias("rsID"))
    return variants.where((F.length("EA") == 1) & (F.length("NEA") == 1)).join(s, ["CHR", "POS"])


def with_row_id(df: DataFrame, order: Sequence[str], within: str = "CHR", name: str = "row_id") -> DataFrame:
    """Explicit ordinal from 0 over (within, order), nulls first.

    Rows are range-sorted and numbered within their partition, shifted by the sizes of the
    partitions before, so no chromosome is one task. The order must be total for a repeatable
    result; equal rows share a partition. Partition sizes are one row per partition.
    """
    keys = [F.col(within).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return placed.withColumn("_r", own).join(offsets, "_part").withColumn(name, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_r", "_o", "_part")


def build_variant_index(template: DataFrame, membership: DataFrame) -> DataFrame:
    """Variant index with row_id: template (CHROM, ID "chrom:pos:...", ALLELE0, ALLELE1) joined to members (CHR, POS, EA, NEA, rsID).

    POS is the second part of ID; EA is the template's ALLELE1; repeated variants count once; palindromic variants are marked.
    """
    t = template.select(F.col("CHROM").cast("int").alias("CHR"), F.get(F.split("ID", ":"), F.lit(1)).cast("int").alias("POS"), F.col("ALLELE1").alias("EA"), F.col("ALLELE0").alias("NEA"))
    t = t.withColumn("key", allele_key("EA", "NEA")).transform(unique_rows(["CHR", "POS", "key"], "first", ["EA", "NEA"]))
    m = membership.select("CHR", "POS", allele_key("EA", "NEA").alias("key"), "rsID").groupBy("CHR", "POS", "key").agg(F.min("rsID").alias("rsID"))
    both = t.join(m, ["CHR", "POS", "key"]).withColumn("is_strand_ambiguous", F.col("key").isin("A_T", "C_G")).drop("key")
    return with_row_id(both, ["POS", "EA", "NEA"])


def align_to_index(index: DataFrame, table: DataFrame, payload: Sequence[str] = ("BETA", "SE")) -> DataFrame:
    """(row_id, payload) for every row of the index: BETA turned to the index's EA, NaN where the table has no such variant.

    table: CHR, POS, EA, NEA and the payload; of repeated variants the first by payload.
    """
    t = table.withColumn("key", allele_key("EA", "NEA")).select("CHR", "POS", "key", F.col("EA").alias("_ea"), *payload)
    t = t.transform(unique_rows(["CHR", "POS", "key"], "first", ["_ea", *payload]))
    j = index.withColumn("key", allele_key("EA", "NEA")).join(t, ["CHR", "POS", "key"], "left")
    sign = F.when(F.col("_ea") == F.col("EA"), 1.0).otherwise(-1.0)
    nan = F.lit(float("nan"))
    return j.select("row_id", *(F.coalesce(F.col(c) * sign if c == "BETA" else F.col(c), nan).cast("float").alias(c) for c in payload))


def align_trait(context: DataFrame, trait: DataFrame, least: int = 0) -> DataFrame:
    """context (row_id, rsID, EA, NEA) with the trait's z on the context's allele; null where absent or alleles differ.

    The trait is cut to the context's rsIDs first; of repeated rsIDs the first over all columns
    counts, whatever the input order. Fewer than `least` matches raise ValueError.
    """
    t = trait.select("rsID", F.col("EA").alias("tea"), F.col("NEA").alias("tnea"), "BETA", "SE", "N").join(context.select("rsID").distinct(), "rsID", "left_semi")
    t = t.transform(unique_rows(["rsID"], "first", ["tea", "tnea", "BETA", "SE", "N"]))
    j = context.join(t, "rsID", "left")
    z = F.when(F.col("SE") > 0, F.col("BETA") / F.when(F.col("SE") > 0, F.col("SE")))
    same = (F.col("EA") == F.col("tea")) & (F.col("NEA") == F.col("tnea"))
    turned = (F.col("EA") == F.col("tnea")) & (F.col("NEA") == F.col("tea"))
    out = j.withColumn("z", F.when(same, z).when(turned, -z)).drop("tea", "tnea", "BETA", "SE")
    if least:
        n = out.where("z is not null").count()
        if n < least:
            raise ValueError(f"{n} variants match; {least} are needed")
    return out


def merge_traits(tables: dict[str, DataFrame], keys: Sequence[str] = ("SNP",)) -> DataFrame:
    """Inner join of all tables on the keys: beta.<name>, se.<name>."""
    parts = [t.select(*keys, F.col("beta").alias(f"beta.{n}"), F.col("se").alias(f"se.{n}")) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, list(keys)), parts)


def exactly_one(specs: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches per spec: (keys, matches); every spec should have 1. Null parts of a spec match anything."""
    s = specs.withColumn("_id", F.monotonically_increasing_id())
    on = reduce(lambda a, b: a & b, [s[k].isNull() | (s[k] == table[k]) for k in keys])
    return broadcast_if_small(s).join(table, on, "right").where(F.col("_id").isNotNull()).groupBy("_id").agg(F.count(F.lit(1)).alias("matches")).join(s, "_id", "right").select(*keys, F.coalesce("matches", F.lit(0)).alias("matches"))

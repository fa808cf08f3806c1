"""Harmonising summary statistics with a reference: orientation, strand, palindromes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators.filters import Interval
from varloom.operators.filters import within as inside
from varloom.operators.pipe import Pipe, identity


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def is_palindromic(ea: str = "EA", nea: str = "NEA") -> Column:
    """EA is the reverse complement of NEA, for alleles of any length."""
    return F.col(ea) == reverse_complement(F.col(nea))


def is_ambiguous_snv(ea: str = "EA", nea: str = "NEA") -> Column:
    """Single-base A/T or C/G."""
    return F.concat_ws("", F.least(ea, nea), F.greatest(ea, nea)).isin("AT", "CG")


def matches(ea: str, nea: str, ref_ea: str, ref_nea: str) -> Column:
    return (F.col(ea) == F.col(ref_ea)) & (F.col(nea) == F.col(ref_nea))


def matches_flipped(ea: str, nea: str, ref_ea: str, ref_nea: str) -> Column:
    return (F.col(ea) == F.col(ref_nea)) & (F.col(nea) == F.col(ref_ea))


def flip(where: Column | None = None) -> Pipe:
    """Swaps EA and NEA, negates BETA (and Z), inverts OR, complements EAF, where the condition holds (else everywhere)."""
    cond = where if where is not None else F.lit(True)

    def run(df: DataFrame) -> DataFrame:
        new = {"EA": F.col("NEA"), "NEA": F.col("EA")}
        if "BETA" in df.columns:
            new["BETA"] = -F.col("BETA")
        if "Z" in df.columns:
            new["Z"] = -F.col("Z")
        if "OR" in df.columns:
            new["OR"] = 1 / F.when(F.col("OR") != 0, F.col("OR"))
        if "EAF" in df.columns:
            new["EAF"] = 1 - F.col("EAF")
        return df.withColumns({k: F.when(cond, v).otherwise(F.col(k)) for k, v in new.items()})

    return run


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises ValueError if a key occurs twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} repeat")


def unique_rows_or_raise(df: DataFrame, by: Sequence[str], kind: Column | None = None) -> DataFrame:
    """df, whose plan raises where a key of `by` occurs twice (twice for one value of the boolean `kind`, if given). Keys with a null are let through.

    The count runs over the partitioning that a join on `by` needs anyway.
    """
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w) if kind is None else F.greatest(F.count(F.when(kind, 1)).over(w), F.count(F.when(~kind, 1)).over(w))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    d = df.withColumn("_times", n)
    return d.where(F.when(whole & (F.col("_times") > 1), F.raise_error(F.lit(f"{', '.join(by)} repeat")).cast("boolean")).otherwise(F.lit(True))).drop("_times")


def _judge(df: DataFrame, ok: Column, strategy: str, what: str) -> DataFrame:
    if strategy == "raise":
        if n := df.where(~ok).count():
            raise ValueError(f"{n} rows with {what}")
        return df
    if strategy != "drop":
        raise ValueError(f"strategy is {strategy}")
    return df.where(ok)


def via_rsid(gwas: DataFrame, reference: DataFrame, palindromes: str = "drop", positions: str = "drop", alleles: str = "drop", validate: bool = True, gwas_pipe: Pipe = identity, ref_pipe: Pipe = identity) -> DataFrame:
    """Rows of gwas whose rsID the reference has, on the reference's alleles.

    palindromes: drop or keep; positions and alleles: drop or raise where they disagree.
    validate: an rsID that either table holds twice raises when the plan runs.
    """
    if palindromes not in ("drop", "keep"):
        raise ValueError("palindromes can be dropped or kept")
    g, r = gwas.transform(gwas_pipe), reference.transform(ref_pipe)
    columns = g.columns
    if validate:
        g, r = unique_rows_or_raise(g, ["rsID"]), unique_rows_or_raise(r.select("rsID", "CHR", "POS", "EA", "NEA"), ["rsID"])
    ref = r.select("rsID", *(F.col(c).alias(f"_ref_{c}") for c in ("CHR", "POS", "EA", "NEA")))
    j = g.join(ref, "rsID")
    if palindromes == "drop":
        j = j.where(~is_palindromic())
    j = _judge(j, (F.col("CHR") == F.col("_ref_CHR")) & (F.col("POS") == F.col("_ref_POS")), positions, "another position")
    same, turned = matches("EA", "NEA", "_ref_EA", "_ref_NEA"), matches_flipped("EA", "NEA", "_ref_EA", "_ref_NEA")
    j = _judge(j, same | turned, alleles, "other alleles")
    return j.transform(flip(turned & ~same)).select(*columns)


def via_alleles(gwas: DataFrame, reference: DataFrame, palindromes: str = "drop", chrom_range: Interval | None = None, validate: bool = True, extra: Sequence[str] = ("rsID",), gwas_pipe: Pipe = identity, ref_pipe: Pipe = identity) -> DataFrame:
    """Rows of gwas the reference has at the same place with the same alleles in either order, on the reference's orientation, with the reference's extra columns.

    One join on place and unordered alleles; a reference that lists a variant in both orders gives both rows.
    validate: a variant that either table holds twice in one order raises when the plan runs.
    """
    if palindromes not in ("drop", "keep"):
        raise ValueError("palindromes can be dropped or kept")
    g, r = gwas.transform(gwas_pipe), reference.transform(ref_pipe)
    if chrom_range:
        g = g.transform(inside(Interval(chrom_range.chrom, chrom_range.start, chrom_range.end, closed=True)))
    columns, extra = g.columns, [c for c in extra if c in r.columns]
    lo, hi = F.least("EA", "NEA"), F.greatest("EA", "NEA")
    ref = r.select("CHR", "POS", lo.alias("_lo"), hi.alias("_hi"), F.col("EA").alias("_ref_EA"), F.col("NEA").alias("_ref_NEA"), *(F.col(c).alias(f"_x_{c}") for c in extra))
    g, keys = g.withColumns({"_lo": lo, "_hi": hi}), ["CHR", "POS", "_lo", "_hi"]
    if validate:
        g, ref = unique_rows_or_raise(g, keys, F.col("EA") == F.col("_lo")), unique_rows_or_raise(ref, keys, F.col("_ref_EA") == F.col("_lo"))
    if palindromes == "drop":
        g = g.where(~is_palindromic())
    j = g.join(ref, keys)
    j = j.transform(flip(F.col("EA") != F.col("_ref_EA")))
    return j.select(*(c for c in columns if c not in extra), *(F.col(f"_x_{c}").alias(c) for c in extra))


def compatible_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """rsIDs of two tables whose alleles agree in one of the four orientation and strand readings."""
    y = b.select("rsID", F.col("EA").alias("ea2"), F.col("NEA").alias("nea2"))
    j = a.select("rsID", "EA", "NEA").join(y, "rsID")
    ec, nc = reverse_complement("ea2"), reverse_complement("nea2")
    e, n = F.col("EA"), F.col("NEA")
    ways = [(e == F.col("ea2")) & (n == F.col("nea2")), (e == F.col("nea2")) & (n == F.col("ea2")), (e == ec) & (n == nc), (e == nc) & (n == ec)]
    return j.where(reduce(lambda p, q: p | q, ways)).select("rsID", "EA", "NEA")


def meta_analysis(sources: Sequence[DataFrame], validate: bool = True, effective_n: Sequence[float] | None = None) -> DataFrame:
    """Inverse-variance fixed-effect meta-analysis of (CHR, POS, EA, NEA, BETA, SE [, rsID]) tables.

    All sources are turned to a common order of alleles and met in one aggregation, so there
    is one shuffle however many sources there are; variants in all sources stay, on the orientation of the first.
    Gives CHR, POS, EA, NEA, [rsID], BETA, SE, n_flipped and, where every source's effective sample size is
    given, their sum as N_EFF. Fewer than two sources raise ValueError. validate: a variant that one source holds twice, in
    either order, and a standard error not above 0 raise when the plan runs.
    """
    if len(sources) < 2:
        raise ValueError("a meta-analysis needs two sources")
    rows = []
    for i, s in enumerate(sources):
        se = F.col("SE").cast("double")
        if validate:
            se = F.when((se > 0) & ~F.isnan(se), se).otherwise(F.raise_error(F.lit("standard errors must be above 0")).cast("double"))
        turned = F.col("EA") > F.col("NEA")
        rs = F.col("rsID").cast("string") if i == 0 and "rsID" in s.columns else F.lit(None).cast("string")
        rows.append(s.select(
            "CHR", "POS", F.least("EA", "NEA").alias("lo"), F.greatest("EA", "NEA").alias("hi"), F.lit(i).alias("src"), turned.alias("turned"),
            F.when(turned, -F.col("BETA")).otherwise(F.col("BETA")).cast("double").alias("b"), se.alias("se"), rs.alias("rsID"),
        ))
    w = 1 / (F.col("se") * F.col("se"))
    first = F.max(F.when(F.col("src") == 0, F.col("turned").cast("int")))
    g = reduce(DataFrame.unionByName, rows).groupBy("CHR", "POS", "lo", "hi").agg(
        *(F.count(F.when(F.col("src") == i, 1)).alias(f"k{i}") for i in range(len(sources))), first.alias("t0"), F.max("rsID").alias("rsID"),
        F.sum(F.col("b") * w).alias("sbw"), F.sum(w).alias("sw"), F.sum(F.col("turned").cast("int")).alias("nt"),
    )
    times = [F.col(f"k{i}") for i in range(len(sources))]
    everywhere = F.least(*times) > 0
    g = g.where(F.when(F.greatest(*times) > 1, F.raise_error(F.concat(F.lit("a source holds a variant twice: "), F.concat_ws(":", "CHR", "POS", "lo", "hi"))).cast("boolean")).otherwise(everywhere) if validate else everywhere)
    t = F.col("t0") == 1
    out = g.select(
        "CHR", "POS", F.when(t, F.col("hi")).otherwise(F.col("lo")).alias("EA"), F.when(t, F.col("lo")).otherwise(F.col("hi")).alias("NEA"), "rsID",
        (F.when(t, -1.0).otherwise(1.0) * F.col("sbw") / F.col("sw")).alias("BETA"), F.sqrt(1 / F.col("sw")).alias("SE"),
        F.when(t, len(sources) - F.col("nt")).otherwise(F.col("nt")).cast("int").alias("n_flipped"),
    )
    if effective_n is not None:
        if len(effective_n) != len(sources):
            raise ValueError("every source needs an effective sample size")
        out = out.withColumn("N_EFF", F.lit(float(sum(effective_n))))
    return out if "rsID" in sources[0].columns else out.drop("rsID")

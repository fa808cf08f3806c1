"""Grouped statistics: combined p-values, specificity, collapse, set similarity, correlation tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions.normal import with_two_sided
from varloom.operators.pipe import Pipe

EPS = 2.220446049250313e-16


def acat_p(p: str) -> Column:
    """Cauchy combination of the p-values of a group; nulls do not count."""
    clipped = F.when(F.col(p).isNotNull(), F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS)))
    return 0.5 - F.atan(F.avg(F.tan((0.5 - clipped) * math.pi))) / math.pi


def acat(group_by: Sequence[str], p: str, model: str, excluded: Sequence[str] = ()) -> Pipe:
    """Per group: models_used (sorted, joined by commas), n_models (rows with a p-value), acat_p; sorted by group."""

    def run(df: DataFrame) -> DataFrame:
        kept = df.where(~F.col(model).isin(list(excluded))) if excluded else df
        out = kept.groupBy(*group_by).agg(F.array_join(F.sort_array(F.collect_list(model)), ",").alias("models_used"), F.count(p).alias("n_models"), acat_p(p).alias("acat_p"))
        return out.orderBy(*group_by)

    return run


def genes_with_counts(df: DataFrame, gene: str, count: str) -> DataFrame:
    """Rows of genes with at least one positive count."""
    good = df.groupBy(gene).agg(F.max(F.when(F.col(count) > 0, 1)).alias("_g")).where("_g = 1").select(gene)
    return df.join(good, gene, "left_semi")


def types_with_cells(df: DataFrame, cell_type: str, cell: str, least: int) -> DataFrame:
    """Rows of cell types with at least that many distinct cells."""
    good = df.groupBy(cell_type).agg(F.count_distinct(cell).alias("_n")).where(F.col("_n") >= least).select(cell_type)
    return df.join(good, cell_type, "left_semi")


def specificity_fraction(cell_type: str, count: str, gene: str, cell: str, min_cells: int = 0) -> Pipe:
    """(gene, type, specificity): mean count of the type over the sum of the types' means for the gene."""

    def run(df: DataFrame) -> DataFrame:
        d = genes_with_counts(types_with_cells(df, cell_type, cell, min_cells) if min_cells else df, gene, count)
        mean = d.groupBy(cell_type, gene).agg(F.avg(count).alias("mean"))
        total = F.sum("mean").over(Window.partitionBy(gene))
        return mean.select(gene, cell_type, F.when(total != 0, F.col("mean") / total).alias("specificity"))

    return run


def with_rank_max(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank within a group where ties get the largest rank; nulls rank first.

    Values are counted before anything is ordered, so the running count is over a group's distinct values.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])), F.sum("_m").over(w).alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, value])]
    return df.join(ranks, reduce(lambda x, y: x & y, on)).drop(*(f"_k{i}" for i in range(len(on))))


def check_not_sparse(df: DataFrame, cell: str, gene: str) -> None:
    """Raises ValueError unless every cell has a row for every gene."""
    a, b, c = df.agg(F.count_distinct(cell, gene), F.count_distinct(cell), F.count_distinct(gene)).first()
    if a != b * c:
        raise ValueError("counts are sparse; every cell needs a row for every gene")


def specificity_stability(cell_type: str, count: str, gene: str, cell: str, min_cells: int = 0, epsilon: float = 1e-4, validate: bool = True) -> Pipe:
    """(gene, type, stability difference): 1 - (rank of zero share + rank of variation) / 2n, less its mean over types."""

    def run(df: DataFrame) -> DataFrame:
        d = genes_with_counts(types_with_cells(df, cell_type, cell, min_cells) if min_cells else df, gene, count)
        if validate:
            check_not_sparse(d, cell, gene)
        g = d.groupBy(cell_type, gene).agg(F.avg(count).alias("m"), F.stddev_samp(count).alias("sd"), F.avg((F.col(count) == 0).cast("double")).alias("zero"))
        g = g.withColumn("cv", (F.col("sd") + epsilon) / (F.col("m") + epsilon))
        g = with_rank_max(with_rank_max(g, [cell_type], "zero", "_r1"), [cell_type], "cv", "_r2")
        n = F.count(F.lit(1)).over(Window.partitionBy(cell_type))
        g = g.withColumn("stability", 1 - (F.col("_r1") + F.col("_r2")) / (2 * n))
        return g.select(gene, cell_type, (F.col("stability") - F.avg("stability").over(Window.partitionBy(gene))).alias("specificity"))

    return run


def collapse_assays(groups: dict[str, str], assay: str = "oid", gene: str = "gene", effect: str = "rg", se: str = "rg_se", p: str = "rg_p", means: Sequence[str] = (), lows: Sequence[str] = (), extra_keys: Sequence[str] = ()) -> Pipe:
    """Assays of one protein as one row: inverse-variance mean, standard error under full correlation
    (sum of 1/se over sum of 1/se^2), spread and count, p anew; sorted by p."""

    def run(df: DataFrame) -> DataFrame:
        key = F.col(assay)
        if groups:
            key = F.coalesce(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))[F.col(assay)], F.col(assay))
        w = 1 / (F.col(se) * F.col(se))
        g = df.withColumn("_key", key).groupBy("_key", *extra_keys).agg(
            F.min_by(gene, assay).alias(gene), (F.sum(F.col(effect) * w) / F.sum(w)).alias(effect), (F.sum(1 / F.col(se)) / F.sum(w)).alias(se),
            (F.max(effect) - F.min(effect)).alias(f"{effect}_range"), F.count(F.lit(1)).alias("n_assays"),
            *(F.avg(c).alias(c) for c in means), *(F.min(c).alias(c) for c in lows),
        )
        return with_two_sided(g.withColumnRenamed("_key", assay), f"({effect} / {se})", p).orderBy(F.col(p).asc_nulls_last(), assay)

    return run


def jaccard_pairs(df: DataFrame, set_col: str, item: str) -> DataFrame:
    """All pairs of the sets given, with common, joined and jaccard, for a short list of sets (a report). Pairs without a common member have 0.

    Common members come from an equi-join on the item; the result has a row for every pair of sets; large
    collections belong to the similarity join with a threshold.
    """
    d = df.select(F.col(set_col).alias("s"), F.col(item).alias("i")).where("s is not null and i is not null").distinct()
    n = d.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    a, b = d.select(F.col("s").alias("set_1"), "i"), d.select(F.col("s").alias("set_2"), "i")
    common = a.join(b, "i").where("set_1 < set_2").groupBy("set_1", "set_2").agg(F.count(F.lit(1)).alias("common"))
    one, two = n.select(F.col("s").alias("set_1"), F.col("n").alias("n1")), n.select(F.col("s").alias("set_2"), F.col("n").alias("n2"))
    every = one.join(two, F.col("set_1") < F.col("set_2")).join(common, ["set_1", "set_2"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    joined = F.col("n1") + F.col("n2") - F.col("common")
    return every.select("set_1", "set_2", "common", joined.alias("joined"), (F.col("common") / joined).alias("jaccard"))


def full_correlation_table(df: DataFrame, a: str = "p1", b: str = "p2", rg: str = "rg", p: str = "p") -> DataFrame:
    """Both directions of every pair, and the diagonal with rg 1 and p NaN; one row per ordered pair."""
    pairs = df.select(a, b, rg, p)
    back = df.select(F.col(b).alias(a), F.col(a).alias(b), rg, p)
    names = pairs.select(F.explode(F.array(a, b)).alias(a)).distinct()
    diagonal = names.select(a, F.col(a).alias(b), F.lit(1.0).alias(rg), F.lit(float("nan")).alias(p))
    return pairs.unionByName(back).where(F.col(a) != F.col(b)).unionByName(diagonal).dropDuplicates([a, b])


def unique_pair_count(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of unordered pairs of different names."""
    return df.where(F.col(a) != F.col(b)).agg(F.count_distinct(F.least(a, b), F.greatest(a, b)).alias("pairs"))


def significant_pairs(df: DataFrame, n_pairs: int, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Marks p <= alpha / n_pairs."""
    return df.withColumn("significant", F.col(p) <= alpha / n_pairs)


def binned_means(df: DataFrame, x: str, y: str, value: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int) -> DataFrame:
    """Mean of value in equal-width two-dimensional bins (0-based; the upper edge belongs to the last bin)."""

    def at(c: str, r: tuple[float, float]) -> Column:
        return F.least(F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / bins)), F.lit(bins - 1)).cast("int")

    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(at(x, x_range).alias("bin_x"), at(y, y_range).alias("bin_y")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def row_normalised(df: DataFrame, key: str, value: str, name: str = "share") -> DataFrame:
    """value over its sum within the key."""
    totals = df.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("_t"))
    return df.join(totals, F.col(key).eqNullSafe(F.col("_k"))).withColumn(name, F.when(F.col("_t") != 0, F.col(value) / F.when(F.col("_t") != 0, F.col("_t")))).drop("_k", "_t")


def significant_columns(results: DataFrame, matrix: DataFrame, label: str = "VARIABLE", p: str = "P", alpha: float = 0.05, keep: Sequence[str] = ("GENE",)) -> DataFrame:
    """The matrix's key columns and those of its columns whose result passes p < alpha / n, by p. The names are a schema."""
    n = results.count()
    names = [r[0] for r in results.where(F.col(p) < alpha / max(n, 1)).orderBy(p, label).select(label).collect()]
    return matrix.select(*keep, *(c for c in names if c in matrix.columns))


def conditional_pairs(conditional: DataFrame, marginal: DataFrame) -> DataFrame:
    """Two rows per MODEL (VARIABLE, P; in order of `ordinal`) as one row with a/b columns and the proportional significance ps_a, ps_b."""
    d = conditional.join(marginal.select("VARIABLE", F.col("P").alias("P_marginal")), "VARIABLE", "left")
    place = F.row_number().over(Window.partitionBy("MODEL").orderBy("ordinal"))
    d = d.withColumn("_k", F.when(place == 1, "a").otherwise("b"))
    g = d.groupBy("MODEL").agg(*(F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}_{k}") for c in ("VARIABLE", "P", "P_marginal") for k in "ab"))
    return g.withColumns({f"ps_{k}": F.log10(f"P_{k}") / F.log10(f"P_marginal_{k}") for k in "ab"})


def forward_select(names: Sequence[str], share: dict[tuple[str, str], float], least: float = 0.5) -> list[str]:
    """Greedy choice in the given order: a name stays if with every name kept so far both keep at least that share of significance."""
    kept: list[str] = []
    for n in names:
        if all(share.get((n, k), 0) >= least and share.get((k, n), 0) >= least for k in kept):
            kept.append(n)
    return kept


def k_centre(names: Sequence[str], similarity: dict[tuple[str, str], float], start: Sequence[str], size: int, strategy: str = "max") -> list[str]:
    """Greedy varied choice from a short list: the next is the one with the least (max or mean) similarity to the chosen; ties go by name."""
    chosen, rest = list(start), sorted(set(names) - set(start))

    def near(n: str) -> float:
        s = [similarity.get((n, c), similarity.get((c, n), 0.0)) for c in chosen]
        return (max(s) if strategy == "max" else sum(s) / len(s)) if s else 0.0

    while rest and len(chosen) < size:
        best = min(rest, key=lambda n: (near(n), n))
        chosen.append(best)
        rest.remove(best)
    return chosen

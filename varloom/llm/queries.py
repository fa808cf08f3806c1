"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import contamination, diverse_subset, mojibake, overlap_join, packing, radix, soft_linkage
from varloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
SCOPES = {"study_id": "study_id", "chr": "chr", "all": None}
METRICS = ("chisq", "beta")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap_join.similar_pairs(table(spark, sf, "gene_set_gene_symbol"), "gene_set_id", "gene_symbol_id")
    return found.select(F.col("id1").alias("gene_set_id_1"), F.col("id2").alias("gene_set_id_2"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per set with its class and the class's number of links to other classes."""
    pairs, member = overlap_join.similar_classes(table(spark, sf, "gene_set_gene_symbol"), "gene_set_id", "gene_symbol_id")
    ends = pairs.select(F.explode(F.array("id1", "id2")).alias("rep"))
    links = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return member.join(links, "rep", "left").select(F.col("set_id").alias("gene_set_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p1_class_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of class representatives."""
    pairs, _ = overlap_join.similar_classes(table(spark, sf, "gene_set_gene_symbol"), "gene_set_id", "gene_symbol_id")
    return pairs.select(F.col("id1").alias("class_id_1"), F.col("id2").alias("class_id_2"), "overlap", F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return soft_linkage.link(table(spark, sf, "regenie_variants"), table(spark, sf, "dummy_processed_gwas")).select("snpid", "regenie_row")


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links with their confidence, the number of variants that competed and the solver's residual."""
    links = soft_linkage.link(table(spark, sf, "regenie_variants"), table(spark, sf, "dummy_processed_gwas"))
    return links.select("regenie_row", "snpid", F.round("confidence", 4).alias("confidence"), "candidates", F.round("residual", 4).alias("residual"))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    found = radix.percentiles(table(spark, sf, "dummy_processed_gwas"), SCOPES, METRICS, "release_day")
    return found.select("scope", F.col("key").alias("group_key"), "metric", "q", "total", "value")


def p4_day_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable result of every release_day."""
    counts = radix.day_counts(table(spark, sf, "dummy_processed_gwas"), SCOPES, METRICS, "release_day")
    return counts.select(F.col("part").alias("release_day"), "scope", F.col("key").alias("group_key"), "metric", "digit", "n")


def p4_merged_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles with their bounds from the merged day results alone."""
    found = radix.percentiles_from_counts(radix.day_counts(table(spark, sf, "dummy_processed_gwas"), SCOPES, METRICS, "release_day"))
    return found.select("scope", F.col("key").alias("group_key"), "metric", "q", "total", "lower", "upper", "value")


def p4_merged_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the merged day results' bounds hold the exact percentile and are as narrow as promised."""
    key = ["scope", "group_key", "metric", "q"]
    j = p4_merged_days(spark, sf).drop("value").join(p4_percentiles(spark, sf).select(*key, "value"), key)
    holds = F.col("value").between(F.col("lower"), F.col("upper")) & (F.col("upper") - F.col("lower") <= F.greatest(F.abs("lower"), F.abs("upper")) / 16 + 2e-309)  # about 0 the cell of denormal numbers is the bound
    return j.select(*key, "total", holds.alias("holds"))


def gene_set_content(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(id, group) of gene_set, with the collection's spelling made even, and (id, item) of its members."""
    group = F.upper(F.regexp_replace(F.trim("collection"), r"[\s_-]+", ""))
    return table(spark, sf, "gene_set").select("id", group.alias("group")), table(spark, sf, "gene_set_gene_symbol").select(F.col("gene_set_id").alias("id"), F.col("gene_symbol_id").alias("item"))


def p5_varied_sets(spark: SparkSession, sf: str) -> DataFrame:
    """500 gene sets that cover the collections and the content."""
    chosen = diverse_subset.select_varied(*gene_set_content(spark, sf), k=500)
    return chosen.select("place", F.col("id").alias("gene_set_id"), "tolerance", F.round("residual", 4).alias("residual"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its container of 2,048 tokens."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by the tokens left over in them."""
    used = p6_containers(spark, sf).where("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    return used.groupBy((packing.CAPACITY - F.col("used")).alias("tokens_left")).agg(F.count("*").alias("containers"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The longest verbatim match of every document and item, with its places."""
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return contamination.without_leaks(documents, contamination.leaks(documents, table(spark, sf, "eval_items"))).select("doc_id", "n_chars")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled documents with the chains that explain them and the restored text (null where characters are lost)."""
    return mojibake.garbled(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    names = [p1_found, p1_classes, p1_class_pairs, p2_found, p2_links, p4_percentiles, p4_day_counts, p4_merged_days, p4_merged_bounds, p5_varied_sets, p6_containers, p6_fill, p7_found, p7_matches, p7_clean_documents, p8_found, p8_restored]
    return {f.__name__: f for f in names}

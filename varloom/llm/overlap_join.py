"""All pairs of sets whose Jaccard similarity reaches a threshold, by a size-aware overlap join.

Two sets of sizes a and b reach the Jaccard threshold num/den exactly if they share at
least t(a, b) = ceil(num * (a + b) / (num + den)) members. Exact copies are first folded
into one representative. Then, by size:

* pairs of small sets (up to `small_max` members): every set lists its t-element subsets;
  two sets with a common listed subset are a pair, so a key's rows are never more work
  than the pairs they give;
* pairs with a large set: the large set scans the inverted lists of its rarest members,
  as many as any partner must hit (n - ceil(n * num / den) + 1). Lists are cut by size
  class, and length, position and a 256-bit signature bound are checked in the join
  condition, before a candidate row is made;

and the union is filtered by the final similarity.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.session import broadcast_if_small, cut

SIGNATURE_WORDS = 4
#: Sets that hold a member beyond which its inverted list is split, each part meeting every probe.
LIST_ROWS = 20_000


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Members two sets of sizes a and b must share for a Jaccard similarity of num/den."""
    return -(-num * (a + b) // (num + den))


def distinct_members(df: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """Distinct (set_id, item) without nulls. Repeated rows fold before the shuffle."""
    return df.select(F.col(set_col).alias("set_id"), F.col(item_col).alias("item")).where(F.col("set_id").isNotNull() & F.col("item").isNotNull()).distinct()


SIGNATURE = [f"s{w}" for w in range(SIGNATURE_WORDS)]


def ordered_sets(members: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(one row per set: set_id, n, toks (members from rare to common), signature words; frequency: item, freq). A set holds at most the vocabulary."""
    members = cut(members)
    frequency = cut(members.groupBy("item").agg(F.count("*").alias("freq")))
    bit = F.pmod(F.xxhash64("item"), F.lit(64 * SIGNATURE_WORDS)).cast("int")
    rows = members.withColumn("bit", bit).join(broadcast_if_small(frequency), "item")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)"))), F.lit(0)).alias(c) for w, c in enumerate(SIGNATURE)]
    sets = rows.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("freq", "item"))).alias("m"), *words)
    return sets.select("set_id", F.size("m").alias("n"), F.col("m.item").alias("toks"), *SIGNATURE).where(F.col("n") >= min_size), frequency


def fold_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct set, membership set_id -> rep). Sets are told apart by size and two 64-bit hashes."""
    keyed = cut(sets.select("*", F.xxhash64("toks").alias("h1"), F.xxhash64(F.lit(1), F.reverse("toks")).alias("h2")))
    first = keyed.groupBy("n", "h1", "h2").agg(F.min("set_id").alias("rep"))
    member = keyed.select("set_id", "n", "h1", "h2").join(first, ["n", "h1", "h2"]).select("set_id", "rep")
    member = cut(member)
    reps = keyed.join(member.where("set_id = rep").select("set_id"), "set_id", "left_semi").select("set_id", "n", "toks", *SIGNATURE)
    return cut(reps), member


def _subset_plan(spark, min_size: int, small_max: int, num: int, den: int) -> DataFrame:
    """For each small size the thresholds it meets and the subsets to list: bounded by small_max alone."""
    rows = []
    for a in range(min_size, small_max + 1):
        for t in sorted({least_overlap(a, b, num, den) for b in range(min_size, small_max + 1) if den * min(a, b) >= num * max(a, b)}):
            rows += [(a, t, list(c)) for c in itertools.combinations(range(1, a + 1), t)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))


def _t(a: Column, b: Column, num: int, den: int) -> Column:
    return F.ceil(F.lit(num) * (a + b) / F.lit(num + den) - F.lit(1e-9)).cast("int")


def small_pairs(reps: DataFrame, num: int, den: int, min_size: int, small_max: int) -> DataFrame:
    """Pairs of small sets by common threshold-sized subsets. Each pair comes from its first common subset only."""
    plan = _subset_plan(reps.sparkSession, min_size, small_max, num, den)
    small = reps.where(F.col("n") <= small_max)
    keys = small.join(F.broadcast(plan), "n").select("set_id", "n", "toks", "t", F.expr("transform(at, i -> element_at(toks, i))").alias("sub"))
    keys = keys.withColumn("h", F.xxhash64("t", "sub"))
    x = keys.select("t", "h", "sub", F.col("set_id").alias("id1"), F.col("n").alias("n1"), F.col("toks").alias("k1"))
    y = keys.select("t", "h", F.col("set_id").alias("id2"), F.col("n").alias("n2"), F.col("toks").alias("k2"))
    both = x.join(y, ["t", "h"]).where((F.col("id1") < F.col("id2")) & (_t(F.col("n1"), F.col("n2"), num, den) == F.col("t")))
    both = both.withColumn("common", F.array_intersect("k1", "k2")).where(F.slice("common", 1, F.col("t")) == F.col("sub"))
    return both.select("id1", "id2", F.size("common").alias("overlap"), "n1", "n2")


def large_pairs(reps: DataFrame, num: int, den: int, small_max: int, frequency: DataFrame) -> DataFrame:
    """Pairs with at least one large set, by scanning inverted lists of rare members. A list that could be longer than LIST_ROWS is split by set."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num))).cast("int")
    sig = SIGNATURE
    base = reps.select("set_id", "n", "toks", band.alias("band"), *sig)
    probe_len = F.col("n") - F.ceil(F.col("n") * num / F.lit(den) - F.lit(1e-9)).cast("int") + 1
    list_len = F.col("n") - F.ceil(F.col("n") * (2 * num) / F.lit(num + den) - F.lit(1e-9)).cast("int") + 1
    probe = base.where(F.col("n") > small_max).select("set_id", "n", *sig, F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.slice("toks", F.lit(1), probe_len).alias("pre"))
    probe = probe.select("set_id", "n", *sig, "band", F.posexplode("pre").alias("p", "tok"))
    lists = base.select("set_id", "n", *sig, "band", F.posexplode(F.slice("toks", F.lit(1), list_len)).alias("p", "tok"))
    long = cut(frequency.where(F.col("freq") > LIST_ROWS).select(F.col("item").alias("tok"), F.ceil(F.col("freq") / LIST_ROWS).cast("int").alias("ways")))
    count = long.count()
    if count:
        ways = broadcast_if_small(long, count)
        probe = probe.join(ways, "tok", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
        lists = lists.join(ways, "tok", "left").withColumn("part", F.pmod(F.xxhash64("set_id"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    else:
        probe, lists = (d.withColumn("part", F.lit(0)) for d in (probe, lists))
    y, x = probe.alias("y"), lists.alias("x")
    ny, nx = F.col("y.n"), F.col("x.n")
    need = F.ceil(F.lit(num) * (ny + nx) / F.lit(num + den) - F.lit(1e-9)).cast("int")
    apart = sum((F.bit_count(F.col(f"y.s{w}").bitwiseXOR(F.col(f"x.s{w}"))) for w in range(SIGNATURE_WORDS)), F.lit(0))
    condition = (
        (F.col("y.tok") == F.col("x.tok")) & (F.col("y.part") == F.col("x.part")) & (F.col("y.band") == F.col("x.band"))
        & ((nx < ny) | ((nx == ny) & (F.col("x.set_id") < F.col("y.set_id"))))
        & (nx * den >= ny * num)
        & (F.least(ny - F.col("y.p"), nx - F.col("x.p")) >= need)
        & (apart <= ny + nx - need * 2)
    )
    found = y.join(x, condition).select(F.least("y.set_id", "x.set_id").alias("id1"), F.greatest("y.set_id", "x.set_id").alias("id2")).distinct()
    a = reps.select(F.col("set_id").alias("id1"), F.col("n").alias("n1"), F.col("toks").alias("k1"))
    b = reps.select(F.col("set_id").alias("id2"), F.col("n").alias("n2"), F.col("toks").alias("k2"))
    return found.join(a, "id1").join(b, "id2").select("id1", "id2", F.size(F.array_intersect("k1", "k2")).alias("overlap"), "n1", "n2")


def similar_classes(df: DataFrame, set_col: str, item_col: str, num: int = 7, den: int = 10, min_size: int = 5, small_max: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives: id1 < id2, overlap, n1, n2, similarity; membership: set_id, rep).

    A class is a group of sets with exactly the same members. Null ids and members are
    left out, repeated rows count once, sets under min_size members take no part, ties in
    rarity are ordered by member. Extra columns are ignored; an empty table gives no pairs.
    """
    sets, frequency = ordered_sets(distinct_members(df, set_col, item_col), min_size)
    reps, member = fold_copies(sets)
    both = small_pairs(reps, num, den, min_size, small_max).unionByName(large_pairs(reps, num, den, small_max, frequency))
    union = F.col("n1") + F.col("n2") - F.col("overlap")
    pairs = both.where(F.col("overlap") * den >= union * num).withColumn("similarity", F.col("overlap") / union)
    return pairs, member


def similar_pairs(df: DataFrame, set_col: str, item_col: str, num: int = 7, den: int = 10, min_size: int = 5, small_max: int = 8) -> DataFrame:
    """Every pair (id1 < id2, overlap, similarity) of sets, copies expanded. Same rules as similar_classes."""
    pairs, member = similar_classes(df, set_col, item_col, num, den, min_size, small_max)
    a = member.select(F.col("rep").alias("id1"), F.col("set_id").alias("m1"))
    b = member.select(F.col("rep").alias("id2"), F.col("set_id").alias("m2"))
    across = pairs.join(a, "id1").join(b, "id2").select("m1", "m2", "similarity")
    within = a.join(b, F.col("id1") == F.col("id2")).where(F.col("m1") < F.col("m2")).select("m1", "m2", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"), "similarity")

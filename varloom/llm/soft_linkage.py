"""Matching records across sources without keys, by soft-logic linkage.

Records of a delivery (chromosome, position, two alleles, frequency) are tied to known
variants. Candidate pairs only share a chromosome and lie within `reach` bases; position,
alleles and frequency are soft evidence with truth values near(r, v), alike(r, v) and
often(r, v) in [0, 1]. Every pair has a truth value x of match(r, v), every variant a truth
value h of told(v), and weighted rules become hinge losses:

    near, alike, often          -> match(r, v)      w_similar * max(0, s - x)^2, s their weighted mean
    match(r, v)  -> near and alike and often        w_against * max(0, x - weakest of them)
    not match(r, v)                                 w_prior   * x
    match(r, v)                 -> told(v)          w_told    * max(0, x - h)
    told(v) and similar(r, v)   -> match(r, v)      w_trans   * max(0, h + s - 1 - x)
    not told(v)                                     w_rare    * h
    a record describes one variant                  sum over v of x <= 1 (hard)

The fifth rule carries a match from one record to the others that tell the same variant
(transitivity) through the variant, so its groundings grow with the records, not with
their pairs. The convex problem is solved by the alternating direction method of
multipliers on two levels. Pairs are split by their record's place (crowded places also by
record) into blocks; a task solves its blocks, rule by rule in closed form, for all their
pairs at once. Only variants told in several blocks couple them: each block keeps a copy of
their h, the copies are averaged and sent back until they agree. The values x are the
confidences; the record's best variant by x is the answer, which must then meet the limits
of the task's definition.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varloom.session import broadcast_if_small, cut

BIN = 128
#: Pairs a task solves at once, and pairs of one place beyond which the place is split by record.
AT_ONCE = 100_000
CROWDED = 20_000
PLACE = 4096
#: Chromosomes that are not known, as opposed to ones that have no variants.
UNKNOWN = ("", "na", "nan", ".", "none", "null")


@dataclass(frozen=True)
class Rules:
    """Weights of the rules and the solver's limits. `inner` steps bound a task's own solution, `rounds` the exchanges between tasks."""

    similar: float = 1.0
    against: float = 1.5
    prior: float = 0.1
    told: float = 0.2
    trans: float = 0.3
    rare: float = 0.05
    rounds: int = 60
    tolerance: float = 0.01
    inner: int = 2000
    inner_tolerance: float = 1e-3
    least_confidence: float = 0.5


def chromosome_code(c: Column) -> Column:
    """Chromosome as an integer: "chr07", " 7.0 " -> 7, X 23, Y 24, M 25; anything else null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"^chr(omosome)?[_ ]*", ""), r"\.0*$", "")
    t = F.regexp_replace(t, r"^0+(?=.)", "")
    t = F.when(t == "x", "23").when(t == "y", "24").when(t.isin("m", "mt"), "25").otherwise(t)
    return F.when(t.rlike("^[0-9]{1,4}$"), t).cast("int")


def allele(c: Column) -> Column:
    """Upper-cased allele; "-" is the empty allele."""
    t = F.upper(F.trim(c))
    return F.when(t.isin("-", ""), F.lit("")).otherwise(t)


COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reverse_complement(x: str) -> str:
    return x.translate(COMPLEMENT)[::-1]


def trimmed(a: str, b: str, suffix_first: bool) -> str:
    """The change a>b without the bases both share at the ends, one end before the other."""
    for end in ("suffix", "prefix") if suffix_first else ("prefix", "suffix"):
        k = len(os.path.commonprefix([a[::-1], b[::-1]] if end == "suffix" else [a, b]))
        a, b = (a[: len(a) - k], b[: len(b) - k]) if end == "suffix" else (a[k:], b[k:])
    return f"{a}>{b}"


@functools.lru_cache(100_000)
def allele_forms(a: str | None, b: str | None) -> tuple[str, ...]:
    """Ways to write the change a>b once shared bases are trimmed, from either end first."""
    if a is None or b is None or a == b:
        return ()
    return tuple(dict.fromkeys((trimmed(a, b, True), trimmed(a, b, False))))


@functools.lru_cache(100_000)
def strand_forms(a: str | None, b: str | None) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """On either strand: ways to write a>b, ways to write a alone, ways to write b alone."""
    ways = allele_forms(a, b)
    if a is not None and b is not None:
        ways += allele_forms(reverse_complement(a), reverse_complement(b))
    first = {w.partition(">")[0] for w in ways} | ({a, reverse_complement(a)} if a is not None else set())
    second = {w.partition(">")[2] for w in ways} | ({b, reverse_complement(b)} if b is not None else set())
    return tuple(dict.fromkeys(ways)), tuple(sorted(first)), tuple(sorted(second))


def _none(x) -> str | None:
    return x if isinstance(x, str) else None


def _with_record_forms(r: DataFrame) -> DataFrame:
    """Adds fwd and bwd, the ways to write a0>a1 and a1>a0."""

    def add(frames):
        for f in frames:
            pairs = [(_none(a), _none(b)) for a, b in zip(f["a0"], f["a1"], strict=True)]
            yield f.assign(fwd=[list(allele_forms(a, b)) for a, b in pairs], bwd=[list(allele_forms(b, a)) for a, b in pairs])

    schema = T.StructType([*r.schema.fields, *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("fwd", "bwd"))])
    return r.mapInPandas(add, schema)


def _with_variant_forms(v: DataFrame) -> DataFrame:
    """Adds ways, lows and highs of lo>hi on either strand."""

    def add(frames):
        for f in frames:
            forms = [strand_forms(_none(a), _none(b)) for a, b in zip(f["lo"], f["hi"], strict=True)]
            yield f.assign(**{c: [list(x[i]) for x in forms] for i, c in enumerate(("ways", "lows", "highs"))})

    schema = T.StructType([*v.schema.fields, *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("ways", "lows", "highs"))])
    return v.mapInPandas(add, schema)


def variants(df: DataFrame) -> DataFrame:
    """One row per snpid: chr, pos, lo, hi (alleles in text order), freq (usual frequency of hi).

    Rows are folded by fixed-width sums before the shuffle, so a variant that holds a third
    of the rows is no more than one row of every task.
    """
    ea, nea = allele(F.col("ea")), allele(F.col("nea"))
    known = ea.isNotNull() & nea.isNotNull()
    eaf = F.when(~F.isnan("eaf"), F.col("eaf"))
    f = F.when(known & (ea >= nea), eaf).when(known, 1 - eaf)
    rows = df.where(F.col("snpid").isNotNull()).select("snpid", F.col("chr").cast("int").alias("chr"), F.col("pos").cast("bigint").alias("pos"), F.when(known, F.least(ea, nea)).alias("lo"), F.when(known, F.greatest(ea, nea)).alias("hi"), f.alias("f"))
    ways = rows.groupBy("snpid", "chr", "pos", "lo", "hi").agg(F.count("*").alias("n"), F.sum("f").alias("sf"), F.count("f").alias("nf"))
    best = F.max(F.struct(F.col("lo").isNotNull().alias("k"), "n", "chr", "pos", "lo", "hi")).alias("m")
    one = ways.groupBy("snpid").agg(best, (F.try_divide(F.sum("sf"), F.sum("nf"))).alias("freq"))
    return one.select("snpid", "m.chr", "m.pos", "m.lo", "m.hi", "freq").where(F.col("chr").isNotNull() & F.col("pos").isNotNull())


def candidates(records: DataFrame, known: DataFrame, reach: int = 64) -> DataFrame:
    """Pairs on the same chromosome within `reach` bases, whatever their alleles and frequencies: regenie_row, snpid, file_name, c, g, shift (genpos - pos), alike (truth of the alleles: 1 agree, 0.8 unknown, 0 contradict), gap (frequency difference or null)."""
    chrom = F.lower(F.trim(F.coalesce(F.col("chrom").cast("string"), F.lit(""))))
    r = records.where(F.col("regenie_row").isNotNull() & F.col("genpos").isNotNull()).select(
        "regenie_row", "file_name", chromosome_code(F.col("chrom")).alias("c"), chrom.isin(*UNKNOWN).alias("lost"), F.col("genpos").cast("bigint").alias("g"),
        allele(F.col("allele0")).alias("a0"), allele(F.col("allele1")).alias("a1"), F.when(~F.isnan("a1freq"), F.col("a1freq")).alias("fr"),
    ).where(F.col("c").isNotNull() | F.col("lost"))
    r = _with_record_forms(r)
    r = r.withColumn("b", F.explode(F.array_distinct(F.array(F.floor((F.col("g") - reach) / BIN), F.floor((F.col("g") + reach) / BIN)))))
    v = _with_variant_forms(known).withColumn("vb", F.floor(F.col("pos") / BIN))
    near = F.abs(F.col("g") - F.col("pos")) <= reach
    pairs = r.join(v, (F.col("c") == F.col("chr")) & (F.col("b") == F.col("vb"))).where(near)
    if r.where("lost").limit(1).count():  # a null chromosome speaks for none: every chromosome is searched at that position
        pairs = pairs.unionByName(r.where("lost").join(v, F.col("b") == F.col("vb")).where(near))
    unknown_v = F.col("lo").isNull() | F.col("hi").isNull()
    both, none = F.col("a0").isNotNull() & F.col("a1").isNotNull(), F.col("a0").isNull() & F.col("a1").isNull()
    has = F.array_contains

    def oriented(forms: str, first: str, second: str) -> Column:
        single = F.when(F.col("a1").isNotNull(), has(second, F.col("a1"))).otherwise(has(first, F.col("a0")))
        return F.when(unknown_v | none, F.lit(True)).when(both, F.arrays_overlap(forms, "ways")).otherwise(single)

    pairs = pairs.withColumns({"same": oriented("fwd", "lows", "highs"), "turned": oriented("bwd", "highs", "lows")})
    agree = F.col("same") | F.col("turned")
    gap = F.least(F.when(F.col("same") | ~agree, F.abs(F.col("fr") - F.col("freq"))), F.when(F.col("turned") | ~agree, F.abs(F.col("fr") - (1 - F.col("freq")))))
    alike = F.when(~agree, 0.0).when(both & ~unknown_v, 1.0).otherwise(0.8)
    return pairs.select("regenie_row", "snpid", "file_name", F.coalesce("c", F.lit(0)).alias("c"), "g", (F.col("g") - F.col("pos")).alias("shift"), alike.alias("alike"), gap.alias("gap"))


def fits(window: int = 12, least_gap: float = 0.1) -> Column:
    """Whether a pair meets the definition's limits."""
    return (F.abs("shift") <= window) & (F.col("alike") > 0) & (F.col("gap").isNull() | (F.col("gap") < least_gap))


def evidence(pairs: DataFrame, window: int = 12, least_gap: float = 0.1) -> DataFrame:
    """Adds s, the weighted mean of the truth values, and weakest, the least of them.

    near: 1 at the place (half of it after the file's habitual shift), 0.6 at the window's end,
    falling to 0 at twice the window. often: 1 at equal frequencies, 0.6 at least_gap, 0 at
    twice least_gap; 0.8 if unknown. Unknown speaks neither for nor against.
    """
    habit = pairs.where(fits(window, least_gap)).groupBy("file_name", "shift").count().groupBy("file_name").agg(F.max_by("shift", F.struct("count", -F.abs("shift"))).alias("habit"))
    p = pairs.join(broadcast_if_small(habit.withColumnRenamed("file_name", "file")), F.col("file_name").eqNullSafe(F.col("file")), "left").drop("file")

    def truth(x: Column, limit: float) -> Column:
        return F.when(x < limit, 1 - 0.4 * x / limit).otherwise(F.greatest(F.lit(0.0), 0.4 * (2 - x / limit)))

    off = F.abs("shift")
    habitual = F.least((off + F.abs(F.col("shift") - F.coalesce("habit", F.lit(0)))) / 2, F.lit(float(window)))
    near = F.when(off <= window, truth(habitual, window + 1.0)).otherwise(truth(off.cast("double"), window + 1.0))
    often = F.when(F.col("gap").isNull(), 0.8).otherwise(truth(F.col("gap"), least_gap))
    p = p.withColumns({"near": near, "often": often})
    return p.withColumns({"s": 0.4 * F.col("near") + 0.3 * F.col("alike") + 0.3 * F.col("often"), "weakest": F.least("near", "alike", "often")}).drop("near", "often", "habit")


def settle(rec: np.ndarray, var: np.ndarray, s: np.ndarray, weakest: np.ndarray, share: np.ndarray, anchor: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, float]:
    """(x of every pair, h of every variant, residual) of one block of pairs.

    rec, var: codes from 0; share: part of the variant's own rule that falls to this block;
    anchor: value to which other blocks draw h (nan for none). Every rule moves its own
    copies from the consensus in closed form; copies are averaged.
    """
    n_r, n_v, m = int(rec.max()) + 1, int(var.max()) + 1, len(rec)
    per_r, per_v = np.bincount(rec, minlength=n_r)[rec], np.bincount(var, minlength=n_v)
    pulled = ~np.isnan(anchor)
    z, h = s.copy(), np.zeros(n_v)
    np.maximum.at(h, var, s)
    h = np.where(pulled, np.nan_to_num(anchor), h)
    uu, ut, ur, ue, uth, urh = (np.zeros(m) for _ in range(6))
    uo, w = np.zeros(n_v), 2 * rules.similar
    residual = 0.0
    for _ in range(rules.inner):
        hp = h[var]
        y = z - uu

        def unary(y, weight):
            y = y - weight
            return np.where(y >= s, y, (y + w * s) / (1 + w))

        free, held = unary(y, rules.prior), unary(y, rules.prior + rules.against)
        xu = np.clip(np.where(free <= weakest, free, np.maximum(held, weakest)), 0, 1)
        a, b = z - ut, hp - uth
        step = np.minimum(rules.told, np.maximum(a - b, 0) / 2)
        xt, ht = a - step, b + step
        a, b = z - ur, hp - urh
        step = np.minimum(rules.trans, np.maximum(b + s - 1 - a, 0) / 2)
        xr, hr = a + step, b - step
        y = z - ue
        xe = y - np.maximum(np.bincount(rec, y, n_r)[rec] - 1, 0) / per_r
        y = h - uo - rules.rare * share
        ho = np.clip(np.where(pulled, (y + np.nan_to_num(anchor)) / 2, y), 0, 1)
        new = np.clip((xu + uu + xt + ut + xr + ur + xe + ue) / 4, 0, 1)
        new_h = np.clip((np.bincount(var, ht + uth + hr + urh, n_v) + ho + uo) / (2 * per_v + 1), 0, 1)
        nh = new_h[var]
        residual = max(np.abs(new - z).max(), np.abs(new_h - h).max(), *(np.abs(c - new).max() for c in (xu, xt, xr, xe)), np.abs(ht - nh).max(), np.abs(hr - nh).max(), np.abs(ho - new_h).max())
        uu += xu - new
        ut += xt - new
        ur += xr - new
        ue += xe - new
        uth += ht - nh
        urh += hr - nh
        uo += ho - new_h
        z, h = new, new_h
        if residual < rules.inner_tolerance:
            break
    return z, h, float(residual)


def _solve_blocks(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Adds x and h to pairs with block, s, weakest, k (blocks that tell the variant) and anchor; blocks stay whole within a task."""

    def chunk(f: pd.DataFrame) -> pd.DataFrame:
        rec, _ = pd.factorize(f["regenie_row"])
        var, _ = pd.factorize(pd.MultiIndex.from_frame(f[["block", "snpid"]]))
        first = np.unique(var, return_index=True)[1]
        share, anchor = 1 / f["k"].to_numpy(float)[first], f["anchor"].to_numpy(float)[first]
        x, h, residual = settle(rec, var, f["s"].to_numpy(float), f["weakest"].to_numpy(float), share, anchor, rules)
        return f.assign(x=x, h=h[var], residual=residual)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for f in frames:
            held.append(f)
            rows += len(f)
            if rows >= AT_ONCE:
                whole = pd.concat(held, ignore_index=True)
                ready = whole["block"].to_numpy() != whole["block"].iloc[-1]
                if ready.any():
                    yield chunk(whole[ready].reset_index(drop=True))
                    whole = whole[~ready]
                held, rows = [whole], len(whole)
        if rows:
            yield chunk(pd.concat(held, ignore_index=True))

    fields = ("x", "h", "residual")
    schema = T.StructType([*pairs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in fields)])
    return pairs.repartition("block").sortWithinPartitions("block", "regenie_row").mapInPandas(run, schema)


def with_blocks(pairs: DataFrame) -> DataFrame:
    """Adds block, a hash of the record's place; a place with more than CROWDED pairs is split by record."""
    at = F.floor(F.col("g") / PLACE)
    counts = pairs.groupBy("c", at.alias("at")).count().where(F.col("count") > CROWDED)
    crowded = broadcast_if_small(counts.select(F.col("c").alias("cc"), F.col("at").alias("ca"), F.ceil(F.col("count") / CROWDED).alias("ways")))
    p = pairs.join(crowded, (F.col("c") == F.col("cc")) & (at == F.col("ca")), "left")
    return p.withColumn("block", F.xxhash64("c", at, F.pmod(F.xxhash64("regenie_row"), F.coalesce("ways", F.lit(1))))).drop("cc", "ca", "ways")


def solve(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds x, the truth value of match(regenie_row, snpid), and residual, how far the solution is from agreement, to pairs with columns s, weakest and block.

    Blocks that share no variant with others are settled in one pass. The others are solved as
    one block if a task can hold it (AT_ONCE pairs); beyond that they exchange the
    values of shared variants, one small aggregation a round, until they agree within the
    tolerance; if they don't in `rounds` rounds, the residual says so.
    """
    names = pairs.columns
    spread = pairs.groupBy("snpid", "block").agg(F.count("*").alias("n")).groupBy("snpid").agg(F.count("*").alias("k")).where("k > 1")
    p = pairs.join(broadcast_if_small(spread), "snpid", "left").withColumns({"k": F.coalesce("k", F.lit(1)), "anchor": F.lit(None).cast("double")})
    first = cut(_solve_blocks(p.select(*names, "k", "anchor"), rules))
    out = ("x", "residual")
    blocks = broadcast_if_small(cut(first.where("k > 1").select("block").distinct()))
    alone, coupled = first.join(blocks, "block", "left_anti").select(*names, *out), cut(first.join(blocks, "block", "left_semi"))
    pairs_left = coupled.count()
    if not pairs_left:
        return alone
    if pairs_left <= AT_ONCE:
        whole = coupled.select(*(F.lit(0).cast("bigint").alias("block") if c == "block" else F.col(c) for c in names), F.lit(1).cast("bigint").alias("k"), "anchor")
        return alone.unionByName(_solve_blocks(whole, rules).select(*names, *out))
    # a block's copies of the variants it shares: value h, dual u
    copies = coupled.where("k > 1").groupBy("block", "snpid").agg(F.first("h").alias("h")).withColumn("u", F.lit(0.0))
    coupled = coupled.select(*names, "k")
    solved, before, worst = None, None, 1.0
    for _ in range(rules.rounds):
        mean = copies.groupBy("snpid").agg(F.avg(F.col("h") + F.col("u")).alias("mean"))
        copies = cut(copies.join(mean, "snpid").select("block", "snpid", "h", "mean", (F.col("u") + F.col("h") - F.col("mean")).alias("u")))
        apart, total, n = copies.agg(F.max(F.abs(F.col("h") - F.col("mean"))), F.sum("mean"), F.count("*")).first()
        worst, before = max(apart, abs(total - before) / n if before is not None else 1.0), total
        if solved is not None and worst < rules.tolerance:
            break
        anchors = copies.select("block", "snpid", (F.col("mean") - F.col("u")).alias("anchor"))
        solved = cut(_solve_blocks(coupled.join(anchors, ["block", "snpid"], "left").select(*names, "k", "anchor"), rules))
        moved = solved.where("anchor is not null").groupBy("block", "snpid").agg(F.first("h").alias("h"))
        copies = moved.join(copies.drop("h", "mean"), ["block", "snpid"])
    return alone.unionByName(solved.select(*names, "x", F.greatest("residual", F.lit(float(worst))).alias("residual")))


def link(records: DataFrame, rows: DataFrame, rules: Rules = Rules(), window: int = 12, least_gap: float = 0.1, reach: int = 64) -> DataFrame:
    """(regenie_row, snpid, confidence, candidates, residual): at most one variant per record.

    A null attribute speaks neither for nor against; a null chromosome is searched on all of
    them, a record without position is tied to nothing, as nothing tells where to look. A record is tied if its
    values over all variants sum to least_confidence and the best one meets the definition's limits
    (window, least_gap); confidence is the best one's own value, candidates the number of variants
    that competed. Of values equal to three digits the smaller frequency difference, then the
    smaller shift, then the smaller snpid wins. Repeated rows of either table change nothing.
    Extra columns are ignored; empty tables give no rows.
    """
    known = variants(rows)
    pairs = evidence(cut(candidates(records.dropDuplicates(["regenie_row"]), known, reach)), window, least_gap)
    solved = solve(with_blocks(pairs), rules)
    per = Window.partitionBy("regenie_row")
    order = per.orderBy(F.round("x", 3).desc(), F.col("gap").asc_nulls_last(), F.abs("shift"), "snpid")
    # alike variants share a record's value, so the limit holds for their sum
    best = solved.withColumns({"rn": F.row_number().over(order), "shared": F.sum("x").over(per), "candidates": F.count("*").over(per)}).where((F.col("rn") == 1) & (F.col("shared") >= rules.least_confidence))
    return best.where(fits(window, least_gap)).select("regenie_row", "snpid", F.col("x").alias("confidence"), "candidates", "residual")

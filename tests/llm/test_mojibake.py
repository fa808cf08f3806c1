"""Garbled text: held-out sound documents are left alone, garbled ones are found and restored."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import mojibake as mj

CHAINS = {"cp1252": ("utf-8", "cp1252"), "latin-1": ("utf-8", "latin-1"), "mac_roman": ("utf-8", "mac_roman"), "cp437": ("utf-8", "cp437"), "cp850": ("utf-8", "cp850"), "cp1251": ("utf-8", "cp1251"), "mac as cp1252": ("mac_roman", "cp1252"), "cp1251 as cp1252": ("cp1251", "cp1252"), "koi8 as cp1251": ("koi8-r", "cp1251")}


def garble(text, written, read):
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def sound(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    d = spark.read.parquet(str(path)).select("doc_id", "text")
    bad = {r["doc_id"] for r in mj.garbled(d).collect()}
    return [(r["doc_id"], r["text"]) for r in d.orderBy("doc_id").collect() if r["text"] and r["doc_id"] not in bad]


def test_held_out(spark, sound):
    rng = random.Random(2)
    rng.shuffle(sound)
    half = len(sound) // 2
    model = mj.train(spark.createDataFrame(sound[:half], "doc_id bigint, text string"))
    held = sound[half:]
    clean = spark.createDataFrame(held, "doc_id bigint, text string")
    wrong = mj.garbled(clean, model=model).count()
    assert wrong <= 0.01 * len(held)
    cases = []
    for i, (_, t) in enumerate(held):
        name = sorted(CHAINS)[i % len(CHAINS)]
        try:
            g = garble(t, *CHAINS[name])
        except UnicodeEncodeError:
            continue
        if g != t and sum(c > "\x7f" for c in t) >= 3:
            cases.append((i, g, t))
    assert len(cases) > 60
    got = {r["doc_id"]: r["restored"] for r in mj.garbled(spark.createDataFrame([c[:2] for c in cases], "doc_id bigint, text string"), model=model).collect()}
    assert len(got) >= 0.95 * len(cases)
    assert sum(got.get(i) == t for i, _, t in cases) >= 0.75 * len(cases)


def test_double_and_lost(spark, sound):
    docs = [*sound, (10_001, "La médiane était élevée à l’hôpital"), (10_002, None), (10_003, ""), (10_004, "plain"), (10_005, "gr��ere"), (10_006, "é" * 60_000)]
    twice = garble(garble("La réplication a été décidée après l’été", "utf-8", "cp1252"), "utf-8", "cp1252")
    docs.append((10_007, twice))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("t", F.lit(1))
    got = {r["doc_id"]: r for r in mj.garbled(d).where("doc_id > 10000").collect()}
    assert {10_005, 10_007} <= set(got) and not {10_001, 10_002, 10_003, 10_004} & set(got)
    assert got[10_007]["restored"] == "La réplication a été décidée après l’été" and got[10_005]["restored"] is None and got[10_005]["lost"] == 2
    assert mj.garbled(d.limit(0)).count() == 0


def test_garbled_text_copied_to_a_third_of_the_rows(spark, sound):
    """Copies of a garbled text are no evidence that it is usual, whether exact or altered away from the garbling."""
    text = "Les résultats de la réplication étaient sûrs après l’été; où qu’il fût, le gène était lié à la fièvre."
    for written, read in (("mac_roman", "cp1252"), ("utf-8", "cp850")):
        bad = garble(text, written, read)
        n = len(sound) // 2
        once, docs = [(20_000, bad)], [(20_000 + i, bad if i % 2 else f"{bad} No {i}") for i in range(n)]
        one, got = ({r["doc_id"]: r["restored"] for r in mj.garbled(spark.createDataFrame(sound + more, "doc_id bigint, text string")).collect()} for more in (once, docs))
        assert set(range(20_000, 20_000 + n)) <= set(got) and got[20_001] == one[20_000]
        assert written != "utf-8" or got[20_001] == text
        assert len(got) <= n + 0.01 * len(sound)


def test_damaged_utf8(spark, sound):
    """A document whose only garbling lost a byte, had it replaced by a blank or was lower-cased counts and is mended."""
    cases = {
        30_001: ("The estimate was p = 4.7×10â»â·, and it survived.", "The estimate was p = 4.7×10⁻⁷, and it survived."),
        30_002: ("Le seuil était limité Ã  3 sujets.", "Le seuil était limité à  3 sujets."),
        30_003: ("The label â€œsparseâ€, but the rest is plain.", "The label “sparse”, but the rest is plain."),
    }
    usual = [(31_000 + i, f"Study {i} had p = {i}.5×10⁻⁷, and it was read.") for i in range(30)]
    model = mj.train(spark.createDataFrame([x for x in sound if "Ã" not in x[1]] + usual, "doc_id bigint, text string"))
    docs = [*((k, v[0]) for k, v in cases.items()), (30_010, "Le seuil était fixé à 3 sujets."), usual[0]]
    got = {r["doc_id"]: r["restored"] for r in mj.garbled(spark.createDataFrame(docs, "doc_id bigint, text string"), model=model).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_long_run_is_undone_to_the_full_depth():
    text = "привет\u00a0мир\u00a0" * 300
    twice = garble(garble(text, "utf-8", "latin-1"), "utf-8", "latin-1")
    three, two, one = (np.zeros(mj.SLOTS, np.float32) for _ in range(3))
    for table, seen in zip((three, two, one), mj.count_grams(Counter({("   ", text, "   "): 50})), strict=True):
        table[list(seen)] = list(seen.values())
    assert mj.Judge(mj.Model(three, two, one), mj.Limits()).document(twice).text == text

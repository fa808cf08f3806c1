"""Leak search against all runs of words."""

import random
import tracemalloc

import numpy as np

from varloom.llm import contamination
from varloom.llm.contamination import Passages, leaks, shard_matches, without_leaks, word_ids, words


def brute(docs, items, n):
    grams = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def make(rng, letters):
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 5, 8, 20])))) for i in range(30)]
    docs = []
    for d in range(60):
        w = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            p = words(rng.choice(items)[1])
            w[len(w) // 2 : len(w) // 2] = p[: rng.randint(0, len(p))]
        docs.append((d, " ,\n".join(w).upper() if rng.random() < 0.5 else "-".join(w)))
    return docs + [(100, None), (101, ""), (102, "é ß Ünï")], items + [(50, None), (51, "")]


def test_random(spark):
    rng = random.Random(5)
    for n, letters in ((5, "ab"), (5, "abcdefg"), (1, "abcdefghijklmnop"), (3, "aab")):
        docs, items = make(rng, letters)
        d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
        e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, passage string, text string")
        for shard in (30, 100_000):
            got = leaks(d, e, n, shard).collect()
            assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, n) and len(got) == len(brute(docs, items, n))
            text, passage = dict(docs), dict(items)
            for r in got[:25]:
                w, q = words(text[r["doc_id"]]), words(passage[r["item_id"]])
                assert r["words"] == longest(w, q)
                assert w[r["doc_word"] : r["doc_word"] + r["words"]] == q[r["item_word"] : r["item_word"] + r["words"]]
    clean = without_leaks(d, leaks(d, e, n))
    assert clean.count() == len(docs) - len({x for x, _ in brute(docs, items, n)})


def test_no_match_across_documents_or_items():
    items = Passages([(1, "a b c d".split()), (2, "e f g h".split())])
    known = items.known
    docs = [(1, word_ids("x a b".split(), known)), (2, word_ids("c d y".split(), known)), (3, word_ids("c d e f".split(), known))]
    assert len(shard_matches(docs, items, 3)) == 0
    assert len(shard_matches([(4, word_ids("b c d".split(), known))], items, 3)) == 1


def test_equal_words_in_bounded_memory():
    """A long run of one word meets a passage of that word: only starts that cannot be moved back are extended, in pieces."""
    items = Passages([(7, ["0"] * 100)])
    text = np.zeros(1_000_000, np.int32)
    tracemalloc.start()
    got = shard_matches([(1, text), (2, text[:20]), (3, text[:11])], items, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_numpy().tolist() == [[1, 7, 100, 0, 0], [2, 7, 20, 0, 0]] and peak < 1 << 30


def test_groups_of_passages(spark, monkeypatch):
    rng = random.Random(3)
    docs, items = make(rng, "abcdefg")
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    whole = sorted(map(tuple, leaks(d, e, 4).collect()))
    monkeypatch.setattr(contamination, "GROUP_CHARS", 150)
    monkeypatch.setattr(contamination, "PAIRS_AT_ONCE", 7)
    assert sorted(map(tuple, leaks(d, e, 4).collect())) == whole and {x[:2] for x in whole} == brute(docs, items, 4)


def test_empty_tables_and_long_text(spark):
    d = spark.createDataFrame([(1, "w " * 50_000 + "one two three four"), (1, "one two three")], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, "zero one two three four five")], "item_id bigint, passage string")
    assert sorted(tuple(r)[:3] for r in leaks(d, e, 3, 1000).collect()) == [(1, 7, 3), (1, 7, 4)]
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0
    assert words("Ab_c x²ⅳ") == ["ab", "c", "x²ⅳ"]

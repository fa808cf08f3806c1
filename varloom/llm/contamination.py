"""Evaluation texts inside training texts, by suffix arrays over shards of the corpus.

A shard is a run of documents of one task, about `shard_words` words. Its suffix array
(word suffixes sorted to a depth of `min_words`) is built by prefix doubling: ranks of
1, 2, 4 ... words, each the order of two shorter ranks. Every suffix of every test
passage is searched in it by binary search, level by level, and what is found is
extended word by word to the longest verbatim match. Suffixes with the same first words are
ordered by the word before them, so that only matches that cannot be extended backwards are
looked at, and they are looked at in pieces of bounded size. Test passages are a stated
query set, carried to all tasks as word numbers; more of them than GROUP_CHARS are searched
group by group. Documents are neither shuffled nor collected.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits (Unicode categories L and N).
WORD = re.compile(r"[^\W_]+")
#: Characters of test passages searched at a time.
GROUP_CHARS = 20_000_000
#: Pairs of starting places extended at a time.
PAIRS_AT_ONCE = 500_000


def words(text: str | None) -> list[str]:
    """Words of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def _depths(n: int) -> list[tuple[int, int]]:
    """(depth so far, offset) steps of prefix doubling that end at n words: 1, 2, 4, ... and a last overlapping step."""
    steps, d = [], 1
    while d < n:
        e = min(2 * d, n)
        steps.append((d, e - d))
        d = e
    return steps


class ShardIndex:
    """Suffix array of a shard to a depth of min_words, with the sorted rank pairs of each level for binary search."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, depth: int):
        """ids: word ids; doc: ascending document ordinal of each word. Suffixes too short for the depth within their document are left out."""
        n, self.depth = len(ids), depth
        self.levels: list[np.ndarray] = []
        end = np.searchsorted(doc, doc, side="right")  # first position after the word's document
        rank = ids.astype(np.int64)
        at = np.arange(n, dtype=np.int64)
        for d, step in _depths(depth):
            at = at[at + d + step <= end[at]]
            pair = (rank[at] << np.int64(32)) | rank[at + step]
            keys, inverse = np.unique(pair, return_inverse=True)
            self.levels.append(keys)
            rank = np.full(n, -1, np.int64)
            rank[at] = inverse
        # suffix array; suffixes alike to the depth are ordered by the word before them (0: none)
        keys = (rank[at] << np.int64(32)) | preceding(ids, doc)[at]
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = at[order], keys[order]

    def search(self, ids: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start positions of query suffixes that occur, with ranges [low, high) of the suffix array whose preceding word is another (or none)."""
        n = len(ids)
        end = np.searchsorted(item, item, side="right")
        rank = ids.astype(np.int64)
        at = np.flatnonzero(rank >= 0)
        for (d, step), keys in zip(_depths(self.depth), self.levels, strict=True):
            at = at[at + d + step <= end[at]]
            at = at[(rank[at] >= 0) & (rank[at + step] >= 0)]
            pair = (rank[at] << np.int64(32)) | rank[at + step]
            where = np.searchsorted(keys, pair)
            hit = np.zeros(len(at), bool)
            inside = where < len(keys)
            hit[inside] = keys[where[inside]] == pair[inside]
            at, where = at[hit], where[hit]
            rank = np.full(n, -1, np.int64)
            rank[at] = where
        base, before = rank[at] << np.int64(32), preceding(ids, item)[at]
        low, high = (np.searchsorted(self.keys, x) for x in (base, base + (np.int64(1) << np.int64(32))))
        same, after = (np.searchsorted(self.keys, base + before, side=side) for side in ("left", "right"))
        same, after = (np.where(before == 0, high, x) for x in (same, after))  # a passage's start matches after any word
        at, low, high = np.concatenate([at, at]), np.concatenate([low, after]), np.concatenate([same, high])
        some = high > low
        return at[some], low[some], high[some]


def preceding(ids: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Number of the word before each, counted from 1; 0 at a block's start."""
    out = np.zeros(len(ids), np.int64)
    out[1:] = np.where(block[1:] == block[:-1], ids[:-1].astype(np.int64) + 1, 0)
    return out


class Passages:
    """Test passages as word numbers: `known` numbers their words; ids, starts (one more than passages) and item ids. A word of no passage has the number len(known)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.known: dict[str, int] = {}
        number = self.known.setdefault
        self.ids = np.fromiter((number(x, len(self.known)) for _, w in items for x in w), np.int32)
        self.starts = np.concatenate(([0], np.cumsum([len(w) for _, w in items], dtype=np.int64))).astype(np.int64)
        self.item_ids = np.array([i for i, _ in items], np.int64)
        self.item = np.repeat(np.arange(len(items)), np.diff(self.starts))


def word_ids(w: list[str], known: dict[str, int]) -> np.ndarray:
    other = len(known)
    return np.fromiter((known.get(x, other) for x in w), np.int32, len(w))


COLUMNS = ("doc_id", "item_id", "words", "doc_word", "item_word")


def _longest(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Of every (document, item) the longest match; of equally long ones the first in the document, then in the item."""
    if not frames:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in COLUMNS})
    out = pd.concat(frames, ignore_index=True)
    return out.sort_values(list(COLUMNS), ascending=[True, True, False, True, True]).drop_duplicates(["d", "item_id"] if "d" in out else ["doc_id", "item_id"], ignore_index=True)


def shard_matches(docs: list[tuple[int, np.ndarray]], passages: Passages, min_words: int) -> pd.DataFrame:
    """Longest verbatim match of every (document, item) of a shard: doc_id, item_id, words, doc_word, item_word (start positions)."""
    if not docs or not passages.known:
        return _longest([])
    flat = np.concatenate([w for _, w in docs])
    doc = np.repeat(np.arange(len(docs)), [len(w) for _, w in docs])
    query, item = passages.ids, passages.item
    # a run that holds a word of no passage cannot match: such words end a run as a document's end does
    inside = flat != len(passages.known)
    first = np.flatnonzero(inside)
    if not len(first):
        return _longest([])
    block = np.cumsum(~inside)[first] + doc[first]  # grows at every left-out word and at every document's start
    ids = flat[first]
    index = ShardIndex(ids, block, min_words)
    at, low, high = index.search(query, item)
    ends = np.cumsum(high - low)
    starts = np.concatenate(([0], np.cumsum([len(w) for _, w in docs])))
    doc_ids = np.array([x for x, _ in docs], np.int64)
    best: list[pd.DataFrame] = []
    for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        k = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(ends[-1])))
        of = np.searchsorted(ends, k, side="right")
        q, p = at[of], index.order[high[of] - (ends[of] - k)]
        length = np.full(len(q), min_words, np.int64)
        live = np.arange(len(q))
        while len(live):
            a, b = q[live] + length[live], p[live] + length[live]
            ok = (a < len(query)) & (b < len(ids))
            live, a, b = live[ok], a[ok], b[ok]
            ok = (item[a] == item[q[live]]) & (block[b] == block[p[live]]) & (query[a] == ids[b])
            live = live[ok]
            length[live] += 1
        d, i = doc[first[p]], item[q]
        found = pd.DataFrame({"doc_id": doc_ids[d], "item_id": passages.item_ids[i], "words": length, "doc_word": first[p] - starts[d], "item_word": q - passages.starts[i], "d": d})
        best = [_longest([*best, found])]
    return _longest(best)[list(COLUMNS)]


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, shard_words: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """One row per (doc_id, item_id) with a common run of at least min_words words: words (longest run), doc_word, item_word.

    Null and empty texts and passages, and passages shorter than min_words, match nothing. A
    repeated doc_id may give a row for each of its rows. Texts longer than a shard make a shard of their own.
    Extra columns are ignored. Passages of more than GROUP_CHARS characters in all are searched
    in groups by item_id, each by a pass over the documents.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_CHARS))
    group = F.pmod(F.xxhash64("i"), F.lit(groups))
    source = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")

    def searched(g: int) -> DataFrame:
        queries = [(r["i"], w) for r in rows.where(group == g).collect() if len(w := words(r["p"])) >= min_words]
        carried = spark.sparkContext.broadcast(Passages(queries))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, held = [], 0
            passages = carried.value
            for f in frames:
                for d, t in zip(f["d"], f["t"], strict=True):
                    w = words(t)
                    if len(w) < min_words:
                        continue
                    shard.append((d, word_ids(w, passages.known)))
                    held += len(w)
                    if held >= shard_words:
                        yield shard_matches(shard, passages, min_words)
                        shard, held = [], 0
            if shard:
                yield shard_matches(shard, passages, min_words)

        return source.mapInPandas(search, "doc_id bigint, item_id bigint, words bigint, doc_word bigint, item_word bigint")

    return functools.reduce(DataFrame.unionByName, (searched(g) for g in range(groups)))


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage."""
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")

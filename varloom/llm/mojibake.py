"""Garbled text from wrong character encodings: found and, where possible, restored.

A smoothed character trigram model is trained on clean records, over the surroundings of
all characters beyond ASCII (windows). Every chain of "encode as it was read, decode as
it was written", up to three deep, is applied to a suspicious window and the result
scored by the model; of a document, the chains' gains in log-likelihood are summed and
the document counts as garbled if the likeliest chains gain more than a margin. Clean
records, on which the model is trained, are those in which a plainer first model, of
single characters by the kinds of their neighbours, sees nothing to gain (it is too plain
to learn a garbled phrase by heart), and which hold no run that is valid UTF-8 of more widely
used characters. Both models count texts with the same windows once, so copies of a text weigh no more than
the text. Model tables have a fixed size and are counted over all documents.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.session import cut

RUN = re.compile(r"[^\x00-\x7f]+")
#: Encodings a text may wrongly have been read in, and single-byte encodings it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "mac_roman", "cp866", "iso8859-15", "cp1254", "cp1253", "iso8859-5", "mac_cyrillic")
WRITTEN_AS = ("cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1250", "cp1253", "iso8859-5", "mac_cyrillic")
SLOTS = 1 << 20
LOST = "\ufffd"
CAPITALS = ("lower-cased", "capitals")
DAMAGED = "damaged utf-8"
#: Characters up to which a run's results are kept; longer ones are made anew, one at a time.
LONG = 2000
_DIGIT = str.maketrans("123456789", "000000000")
_SPACE = str.maketrans("\n\r\t", "   ")


@dataclass(frozen=True)
class Limits:
    """context: characters on either side of a run; clean, clean_short: gain by the plain model over which a record takes no part in the training (short: single-byte chains on one or two characters); surprise: log probability under which a character makes its window suspicious."""

    context: int = 3
    surprise: float = -6.0
    margin: float = 7.0
    clean: float = 3.0
    clean_short: float = 5.0
    depth: int = 3


def _encode(text: str, name: str) -> bytes | None:
    """Bytes of text in an encoding; for cp1252 the five bytes without a character are taken as the control characters of the same code."""
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        if name not in ("cp1252", "cp1250", "cp1254", "cp1253", "cp1251"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(name)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) <= 0x9F:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _decode(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _steps(run: str) -> dict[tuple[str, str], str]:
    """Results of one encode-decode step on a run that differ from it."""
    out = {}
    for read in READ_AS:
        raw = _encode(run, read)
        if raw is None:
            continue
        for written in ("utf-8", *(w for w in WRITTEN_AS if w != read)):
            text = _decode(raw, written)
            if text is not None and text != run and LOST not in text:
                out[read, written] = text
    return out


def chains(run: str, depth: int) -> Iterator[tuple[tuple, str]]:
    """(chain, result) of every chain that applies to a run. Legacy pairs stand alone or last; a run lower-cased after the damage is tried in capitals."""
    todo = [((), run, depth)]
    upper = "".join(ch.upper() if len(ch.upper()) == 1 else ch for ch in run)
    if upper != run:
        todo.append(((CAPITALS,), upper, 1))
    while todo:
        chain, text, left = todo.pop()
        for step, result in _steps(text).items():
            if chain[:1] == (CAPITALS,) and step[1] != "utf-8":
                continue
            whole = (*chain, step)
            yield whole, result
            if step[1] == "utf-8" and left > 1 and RUN.search(result):
                todo.append((whole, result, left - 1))


@functools.lru_cache(30_000)
def repairs(run: str, depth: int = 3) -> dict[tuple, str]:
    """Chain -> result; for runs short enough to be kept."""
    return dict(chains(run, depth))


@functools.lru_cache(None)
def fragile(name: str) -> tuple[int, ...]:
    """Continuation bytes of UTF-8 that an encoding reads as nothing, a control character, a blank or a soft hyphen, so that they are easily dropped or replaced later."""
    read = ((b, _decode(bytes([b]), name)) for b in range(0x80, 0xC0))
    return tuple(b for b, ch in read if ch is None or ch.isspace() or unicodedata.category(ch) in ("Cc", "Cf"))


def mended(run: str, name: str, seen: Callable[[str], float], lowered: bool = False) -> str | None:
    """The likeliest text by `seen` (log probability of a character) whose UTF-8, read in an encoding, is the run but for one fragile byte a character lost and, if lowered, for lower-casing; None if there is none."""

    def codes(ch: str) -> list[int]:
        raw = (_encode(c, name) for c in dict.fromkeys((ch, ch.upper() if lowered else ch)) if len(c) == 1)
        return [r[0] for r in raw if r]

    known = {ch: codes(ch) for ch in set(run)}
    bytes_of = [known[ch] for ch in run]
    n = len(run)
    best: list[tuple[float, int, str] | None] = [(0.0, 0, ""), *[None] * n]
    for i in range(n):
        if best[i] is None:
            continue
        for lead in bytes_of[i]:
            need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            for given in (need, need - 1) if need else ():
                if i + given >= n:
                    continue
                for rest in itertools.product(*bytes_of[i + 1 : i + 1 + given]):
                    tails = [rest] if given == need else [(*rest[:k], b, *rest[k:]) for k in range(need) for b in fragile(name)]
                    for tail in tails:
                        ch = _decode(bytes((lead, *tail)), "utf-8")
                        if ch is not None:
                            score, end = best[i][0] + seen(ch), i + 1 + given
                            if best[end] is None or score > best[end][0]:
                                best[end] = (score, i, ch)
    if best[n] is None:
        return None
    out, at = [], n
    while at:
        _, before, ch = best[at]
        out.append(ch)
        at = before
    return "".join(reversed(out))


def _slot3(a: int, b: int, c: int) -> int:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35 + ((a ^ c) >> 3) * 0x27D4EB2F) % SLOTS


def _slot2(a: int, b: int) -> int:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B + 0x165667B1) % SLOTS


def slices(text: str, context: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, window) of every run beyond ASCII; a window is the run with `context` characters on either side, blanks beyond the text's ends."""
    n = len(text)
    for m in RUN.finditer(text):
        s, e = m.span()
        if s >= context and e + context <= n:
            yield s, e, text[s - context : e + context]
        else:
            yield s, e, text[max(0, s - context) : s].rjust(context) + text[s:e] + text[e : e + context].ljust(context)


def parts(window: str, context: int) -> tuple[str, str, str]:
    """(left, run, right) of a window; digits and white space of the context are made alike."""
    left, right = (x.translate(_DIGIT).translate(_SPACE) for x in (window[:context], window[-context:]))
    return left, window[context:-context], right


def _fast(a: np.ndarray) -> array:
    """The same numbers where single elements are read quickly."""
    out = array("f")
    out.frombytes(np.ascontiguousarray(a, np.float32).tobytes())
    return out


class Model:
    """Interpolated character trigrams over hashed counts."""

    def __init__(self, three: np.ndarray, two: np.ndarray, one: np.ndarray):
        self.three, self.two, self.one = _fast(three), _fast(two), _fast(one)
        self.total = max(float(np.asarray(one).sum()), 1.0)
        self.known: dict[tuple[str, str, str], tuple[float, float]] = {}

    def char(self, a: int, b: int, c: int) -> float:
        ab, bc, abc = self.two[_slot2(a, b)], self.two[_slot2(b, c)], self.three[_slot3(a, b, c)]
        one_b, one_c = self.one[b % SLOTS], self.one[c % SLOTS]
        p = 1e-9 + 0.02 * one_c / self.total
        if one_b > 0:
            p = p * (1 - one_b / (one_b + 4)) + (bc / (one_b + 4) if bc <= one_b else 1 / (one_b + 4)) + p * 0.05
        if ab > 0:
            p = p * (1 - ab / (ab + 4)) + (min(abc, ab) / (ab + 4)) + p * 0.1
        return math.log(min(p, 1.0))

    def window(self, left: str, run: str, right: str) -> tuple[float, float]:
        """(log-likelihood of run and right after left, lowest of a character)."""
        key = (left, run, right)
        hit = self.known.get(key)
        if hit is None:
            codes = [ord(x) for x in left + run + right]
            n = len(left)
            if len(codes) > LONG:
                often = Counter(zip(codes[n - 2 :], codes[n - 1 :], codes[n:-1]))
                score = {abc: self.char(*abc) for abc in often}
                last = tuple(codes[-4:-1])
                low = min(v for abc, v in score.items() if abc != last or often[abc] > 1)
                return sum(score[abc] * k for abc, k in often.items()), low
            each = [self.char(codes[i - 2], codes[i - 1], codes[i]) for i in range(n, len(codes) - 1)]
            hit = (sum(each), min(each[: len(run) + 1], default=0.0))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = hit
        return hit


def count_grams(seen: Counter) -> tuple[Counter, Counter, Counter]:
    three, two, one = Counter(), Counter(), Counter()
    for (left, run, right), n in seen.items():
        codes = [ord(x) for x in left + run + right]
        for i in range(len(left), len(codes) - 1):
            a, b, c = codes[i - 2], codes[i - 1], codes[i]
            three[_slot3(a, b, c)] += n
            two[_slot2(a, b)] += n
            one[b % SLOTS] += n
    return three, two, one


@functools.lru_cache(70_000)
def kind(ch: str) -> int:
    """Kind of a neighbouring character: blank, lower, upper, digit, other; the same beyond ASCII."""
    if ch.isspace():
        return 0
    k = 1 if ch.islower() else 2 if ch.isupper() or ch.isalpha() else 3 if ch.isdigit() else 4
    return k if ch < "\x80" else k + 4


KINDS = 9
PLAIN_CODES = 1 << 16


class PlainModel:
    """Single characters by the kinds of their two neighbours: counts[left kind, right kind, code]."""

    def __init__(self, counts: np.ndarray):
        self.counts = _fast(counts.ravel())
        self.pair = counts.sum(axis=2).ravel().tolist()
        code = counts.sum(axis=(0, 1))
        self.total = max(float(code.sum()), 1.0)
        self.code = _fast(code)

    def score(self, left: str, run: str, right: str) -> float:
        text = left[-1:] + run + right[:1]
        kinds = [kind(ch) for ch in text]
        total = 0.0
        for i in range(1, len(text) - 1):
            c = ord(text[i]) % PLAIN_CODES
            pair = kinds[i - 1] * KINDS + kinds[i + 1]
            base = (self.code[c] + 0.01) / (self.total + 655.36)
            total += math.log((self.counts[pair * PLAIN_CODES + c] + 2 * base) / (self.pair[pair] + 2))
        return total

    def suspicious(self, left: str, run: str, right: str, limits: Limits) -> bool:
        """Whether some step makes the run likelier by more than the limit, or it holds what no sound text holds."""
        if LOST in run or any("\x80" <= ch <= "\x9f" for ch in run):
            return True
        own = self.score(left, run, right)
        for chain, result in repairs(run, 1).items():
            least = limits.clean if chain[-1][1] == "utf-8" or len(run) >= 3 else limits.clean_short
            if self.score(left, result, right) - own > least:
                return True
        return False


def count_plain(seen: Counter) -> Counter:
    """(left kind, right kind, code) as one number -> n."""
    out: Counter = Counter()
    for (left, run, right), n in seen.items():
        text = left[-1:] + run + right[:1]
        kinds = [kind(ch) for ch in text]
        for i in range(1, len(text) - 1):
            out[(kinds[i - 1] * KINDS + kinds[i + 1]) * PLAIN_CODES + ord(text[i]) % PLAIN_CODES] += n
    return out


def evident(run: str, spread: dict[str, tuple[int, int]]) -> bool:
    """Whether a run of several characters is, in some encoding, valid UTF-8 of characters that each occur in more different texts, or in more different windows, than its own rarest one. How often a text or window occurs doesn't matter."""
    if len(run) < 2:
        return False
    none = (0, 0)
    own = [min(x) for x in zip(*(spread.get(ch, none) for ch in run), strict=True)]
    for chain, result in repairs(run, 1).items():
        if len(chain) == 1 and chain[0][1] == "utf-8":
            new = [spread.get(ch, none) for ch in result if ch > "\x7f"]
            if new and any(min(x) > y for x, y in zip(zip(*new, strict=True), own, strict=True)):
                return True
    return False


@dataclass
class Finding:
    """gain: log-likelihood won by the accepted chains; lost: characters that failed to decode, and runs that are damaged UTF-8 but can't be mended; open: suspicious windows nothing explains."""

    gain: float
    chains: dict
    text: str | None
    lost: int
    open: int


class Judge:
    """Scores documents with a model."""

    def __init__(self, model: Model, limits: Limits):
        self.model, self.limits = model, limits
        self.sound: dict[str, bool] = {}
        self.gains: dict[tuple[str, str, str], dict[tuple, float]] = {}
        self.damaged: set[tuple[str, str, str]] = set()

    def _sound(self, window: str) -> bool:
        ok = self.sound.get(window)
        if ok is None:
            if len(self.sound) > 500_000:
                self.sound.clear()
            left, run, right = parts(window, self.limits.context)
            ok = self.sound[window] = LOST not in run and self.model.window(left, run, right)[1] >= self.limits.surprise
        return ok

    def _seen(self, ch: str) -> float:
        return math.log((self.model.one[ord(ch) % SLOTS] + 0.01) / self.model.total)

    def _gains(self, left: str, run: str, right: str) -> dict[tuple, float]:
        """Chains that make the window likelier. The result of a single-byte chain must itself look sound; UTF-8 is a check in itself."""
        key = (left, run, right)
        own = self.gains.get(key)
        if own is None:
            if len(self.gains) > 100_000:
                self.gains.clear()
                self.damaged.clear()
            own, score = {}, self.model.window(left, run, right)[0]
            depth = self.limits.depth
            for chain, result in repairs(run, depth).items() if len(run) <= LONG else chains(run, depth):
                new, low = self.model.window(left, result, right)
                if new > score and (low >= self.limits.surprise or all(step[1] in ("utf-8", CAPITALS[1]) for step in chain)):
                    own[chain] = new - score
            if not any(chain[0] != CAPITALS and chain[-1][1] == "utf-8" for chain in own):
                for name, lowered in itertools.product(READ_AS, (False, True)):
                    result = mended(run, name, self._seen, lowered)
                    if result is None or result == run:
                        continue
                    new, low = self.model.window(left, result, right)
                    if new - score > self.limits.margin:
                        if low >= self.limits.surprise:
                            own[(*(CAPITALS,) * lowered, (name, DAMAGED))] = new - score
                        else:
                            self.damaged.add(key)
            self.gains[key] = own
        return own

    def document(self, text: str | None) -> Finding | None:
        """What there is to gain in a text; None if nothing is suspicious."""
        if not text or text.isascii():
            return None
        odd = [(s, e, w) for s, e, w in slices(text, self.limits.context) if not self._sound(w)]
        if not odd:
            return None
        lost = sum(text[s:e].count(LOST) for s, e, _ in odd)
        totals: dict[tuple, float] = defaultdict(float)
        gains = []
        for _, _, w in odd:
            left, run, right = parts(w, self.limits.context)
            own = {} if LOST in run else self._gains(left, run, right)
            for chain, g in own.items():
                totals[chain] += g
            gains.append(own)
        used: Counter = Counter()
        gain, pieces, at, unexplained = 0.0, [], 0, 0
        for (s, e, w), own in zip(odd, gains, strict=True):
            if not own:
                unexplained += 1
                lost += parts(w, self.limits.context) in self.damaged
                continue
            # of the chains that help here, the one that helps the document most
            chain = max(own, key=lambda c: (round(totals[c], 6), -len(c), str(c)))
            gain += own[chain]
            used[chain] += 1
            if chain[-1][1] == DAMAGED:
                result = mended(text[s:e], chain[-1][0], self._seen, chain[0] == CAPITALS)
            else:
                run = text[s:e]
                result = repairs(run, self.limits.depth)[chain] if len(run) <= LONG else next(x for c, x in chains(run, self.limits.depth) if c == chain)
            pieces += [text[at:s], result]
            at = e
        return Finding(gain, dict(used), "".join([*pieces, text[at:]]), lost, unexplained)


def _texts(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))


def _collected(counts: DataFrame, keys: list[str]) -> pd.DataFrame:
    """Sums of slot counts: as many rows as there are slots at most."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("n")).toPandas()


def folded(documents: DataFrame, text: str, limits: Limits) -> DataFrame:
    """(key, w, n): the windows of every text beyond ASCII and how often it holds them; texts with the same windows are one row."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[bytes] = set()
        for f in frames:
            rows = []
            for t in f["t"]:
                if t.isascii():
                    continue
                own = sorted(Counter(w for _, _, w in slices(t, limits.context)).items())
                key = hashlib.blake2b(repr(own).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known.add(key)
                    rows.append((key, [w for w, _ in own], [n for _, n in own]))
            yield pd.DataFrame(rows, columns=["key", "w", "n"])

    return cut(_texts(documents, text).mapInPandas(windows, "key binary, w array<string>, n array<int>").dropDuplicates(["key"]))


def _seen(rows, context: int) -> Counter:
    """How often each (left, run, right) occurs in rows of (windows, times)."""
    raw: Counter = Counter()
    for ws, ns in rows:
        for w, n in zip(ws, ns, strict=True):
            raw[w] += int(n)
    seen: Counter = Counter()
    for w, n in raw.items():
        seen[parts(w, context)] += n
    return seen


def train_plain(texts: DataFrame, limits: Limits) -> np.ndarray:
    """Counts of the plain model over folded texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            total.update(count_plain(_seen(zip(f["w"], f["n"], strict=True), limits.context)))
        yield pd.DataFrame({"slot": pd.Series(total.keys(), dtype="int64"), "n": pd.Series(total.values(), dtype="int64")})

    got = _collected(texts.select("w", "n").mapInPandas(count, "slot bigint, n bigint"), ["slot"])
    out = np.zeros(KINDS * KINDS * PLAIN_CODES, np.float32)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out.reshape(KINDS, KINDS, PLAIN_CODES)


def spreads(texts: DataFrame, limits: Limits) -> dict[str, tuple[int, int]]:
    """In how many folded texts, and in how many different windows, each character occurs in a run: a row per character at most."""

    def frame(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"code": pd.Series(map(ord, total), dtype="int64"), "n": pd.Series(total.values(), dtype="int64")})

    def by_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            for ws in f["w"]:
                total.update({ch for w in ws for ch in w[limits.context : -limits.context]})
        yield frame(total)

    def different(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()
        for f in frames:
            new = {"".join(parts(w, limits.context)) for ws in f["w"] for w in ws} - known
            if len(known) > 500_000:
                known.clear()
            known |= new
            yield pd.DataFrame({"w": pd.Series(list(new), dtype=object)})

    def by_window(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            for w in f["w"]:
                total.update(set(w[limits.context : -limits.context]))
        yield frame(total)

    w, schema = texts.select("w"), "code bigint, n bigint"
    counts = w.mapInPandas(by_text, schema), w.mapInPandas(different, "w string").distinct().mapInPandas(by_window, schema)
    one, two = (dict(zip(got["code"], got["n"], strict=True)) for got in (_collected(c, ["code"]) for c in counts))
    return {chr(c): (int(n), int(two[c])) for c, n in one.items()}


def train(documents: DataFrame, text: str = "text", limits: Limits = Limits()) -> Model:
    """The trigram model of the clean records, counted over all of them, copies once."""
    sc = documents.sparkSession.sparkContext
    texts = folded(documents, text, limits)
    plain = train_plain(texts, limits)
    at = np.flatnonzero(plain)
    carried = sc.broadcast((at, plain.ravel()[at], spreads(texts, limits)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, values, spread = carried.value
        dense = np.zeros(KINDS * KINDS * PLAIN_CODES, np.float32)
        dense[slots] = values
        model = PlainModel(dense.reshape(KINDS, KINDS, PLAIN_CODES))
        known: dict[tuple[str, str, str], bool] = {}
        by_window: dict[str, bool] = {}

        def bad(w: str) -> bool:
            hit = by_window.get(w)
            if hit is None:
                if len(by_window) > 500_000:
                    by_window.clear()
                left, run, right = parts(w, limits.context)
                key = (left[-1:], run, right[:1])
                hit = known.get(key)
                if hit is None:
                    hit = known[key] = model.suspicious(*key, limits) or evident(run, spread)
                by_window[w] = hit
            return hit

        tables = (Counter(), Counter(), Counter())
        for f in frames:
            clean = [(ws, ns) for ws, ns in zip(f["w"], f["n"], strict=True) if not any(bad(w) for w in ws)]
            for total, new in zip(tables, count_grams(_seen(clean, limits.context)), strict=True):
                total.update(new)
        for k, total in enumerate(tables):
            yield pd.DataFrame({"grams": k, "slot": pd.Series(total.keys(), dtype="int64"), "n": pd.Series(total.values(), dtype="int64")})

    got = _collected(texts.select("w", "n").mapInPandas(count, "grams int, slot bigint, n bigint"), ["grams", "slot"])
    out = []
    for k in range(3):
        a, g = np.zeros(SLOTS, np.float32), got[got["grams"] == k]
        a[g["slot"].to_numpy(np.int64)] = g["n"].to_numpy()
        out.append(a)
    return Model(*out)


def garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), model: Model | None = None) -> DataFrame:
    """(doc_id, gain, lost, open, chains, restored) of the documents with garbled text.

    A document counts if its accepted chains gain more than the margin, or if characters were
    lost in decoding (U+FFFD, damaged UTF-8 that can't be mended), which no chain regains; then restored is null. `open` counts suspicious windows
    without an explanation. Null, empty and ASCII texts are never garbled. Repeated rows give a row each.
    The model is trained on the documents themselves unless one is given.
    """
    model = model or train(documents, text, limits)
    tables = [(np.flatnonzero(a), a[np.flatnonzero(a)]) for a in map(np.asarray, (model.three, model.two, model.one))]
    carried = documents.sparkSession.sparkContext.broadcast(tables)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = []
        for at, values in carried.value:
            a = np.zeros(SLOTS, np.float32)
            a[at] = values
            dense.append(a)
        j = Judge(Model(*dense), limits)
        for f in frames:
            rows = []
            for d, t in zip(f["d"], f["t"], strict=True):
                found = j.document(t)
                if found and (found.gain > limits.margin or found.lost):
                    chains = "; ".join(f"{' > '.join(f'{a} as {b}' for b, a in c)}: {n}" for c, n in sorted(found.chains.items(), key=lambda x: (-x[1], str(x[0]))))
                    rows.append((d, found.gain, found.lost, found.open, chains, found.text if found.gain > limits.margin else None))
            yield pd.DataFrame(rows, columns=["doc_id", "gain", "lost", "open", "chains", "restored"])

    source = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null and t <> ''")
    return source.mapInPandas(judge, "doc_id bigint, gain double, lost int, open int, chains string, restored string")

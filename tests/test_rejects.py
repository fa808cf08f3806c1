"""Reject loading against a reader written from the rules alone."""

import math
import random
import re

import pytest

from varloom.sources.rejects import loaded_rows, rejected_lines, split_lines

NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def expected(line):
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"(?:[^"]|"")*"', re.S).match(line, i)
            if not m or line[m.end() : m.end() + 1] not in ("", ","):
                return "quoting"
            fields.append(m.group()[1:-1].replace('""', '"'))
            i = m.end()
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != 12:
        return "column_count"
    for name, v in zip(("eaf", "beta", "se"), fields[5:8], strict=True):
        v = v.strip(" \t")
        if v in ("", "NA", "."):
            continue
        if not NUMBER.fullmatch(v) or not math.isfinite(float(v)):
            return "invalid_value"
        if (name == "eaf" and not 0 <= float(v) <= 1) or (name == "se" and float(v) <= 0):
            return "invalid_value"
    return None


GOOD = "1:5:A:G,1,5,A,G,0.5,-0.1,0.2,1.5,0.3,1000,1960099"


def line(**changes):
    names = ["snpid", "chr", "pos", "ea", "nea", "eaf", "beta", "se", "chisq", "mlog10p", "n", "status"]
    return ",".join(changes.get(n, v) for n, v in zip(names, GOOD.split(","), strict=True))


CASES = [
    GOOD, GOOD + "\r", GOOD + ",", GOOD + ",x", GOOD[:-8], "", " ", None, "EOF", '"', '""', "," * 11, "," * 12, "," * 10, line(eaf='"0.5"'), line(eaf='" 0.5 "'),
    line(eaf='"0.5" '), line(eaf='"0.5"x'), line(eaf='0".5'), line(nea='""G""'), line(snpid='"a ""b"" c"'), line(snpid='"a,b"'), line(eaf='"0.5'), line(status='"1960099'),
    line(eaf="1.01"), line(eaf="-0"), line(eaf="1"), line(se="0"), line(se="-1"), line(se="1e-400"), line(se="1e400"), line(beta="nan"), line(beta="inf"), line(beta="NA"), line(beta=" NA "), line(beta="na"),
    line(beta="."), line(beta=""), line(beta="  "), line(beta="+.5e-3"), line(beta="5."), line(beta="1_000"), line(beta="0x10"), line(beta="1e5"), line(beta="1e"), line(beta="--1"), line(beta="٣"), line(beta="−0.3"),
    line(beta="0.1\r"), line(chr="zz", pos="q", n="?"), line(ea="A\rB"), line(ea="é"), line(beta="1d"), line(beta="1f"), line(beta="Infinity"), line(snpid="#x"), line(snpid="'q'"), line(ea="\\"), line(ea='"\\"'),
]


def frame(spark, lines):
    rows = [(i, "f.csv" if i % 3 else "g.csv", i, t, "more") for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line_text string, reason string")


def test_cases(spark):
    got = {r["line_id"]: r["reason"] for r in split_lines(frame(spark, CASES)).collect()}
    assert {i: (CASES[i], r) for i, r in got.items()} == {i: (t, expected(t)) for i, t in enumerate(CASES)}


def test_random_lines(spark):
    rng = random.Random(7)
    bits = ['"', '""', ",", "0.5", "NA", " ", "\r", "x", ".", "-", "1e3", "A", "é", "_", "\v", "\f", "\n", "\0", "\t", "0x1", "inf", "nan", "\u00a0", "\ue000", "1", "e", "#", "'"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for _ in range(1500):
        f = GOOD.split(",")
        for _ in range(rng.randint(1, 2)):
            f[rng.randrange(12)] = "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
        lines.append(",".join(f))
    got = {r["line_id"]: r["reason"] for r in split_lines(frame(spark, lines)).collect()}
    wrong = [(t, got[i], expected(t)) for i, t in enumerate(lines) if got[i] != expected(t)]
    assert not wrong


def test_typed_rows(spark):
    d = frame(spark, [GOOD, line(chr="x1", beta="NA", n=" 7 "), line(eaf="9")])
    rows = {r["line_id"]: r for r in loaded_rows(d).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["snpid"], rows[0]["pos"], rows[0]["se"], rows[0]["status"]) == ("1:5:A:G", 5, 0.2, 1960099)
    assert rows[1]["chr"] is None and rows[1]["beta"] is None and rows[1]["n"] == 7
    raw = split_lines(d).where("reason is not null").first()
    assert raw["raw_text"] == line(eaf="9") and raw["snpid"] is None


def test_values_come_back_as_they_were(spark):
    """Line ends, zero bytes and private characters inside a field are data."""
    ids = ["rs\ue00d1", "rs\ue0001", "rs\ue00011", "a\rb", "a\nb", "a\0b", '"q,""\ue0000"', "\ue000\r\ue000"]
    rows = {r["line_id"]: r["snpid"] for r in split_lines(frame(spark, [line(snpid=x) for x in ids])).where("reason is null").collect()}
    assert rows == {i: x for i, x in enumerate([*ids[:6], 'q,"\ue0000', ids[7]])}


def test_reader_says_why(spark):
    lines = {line(eaf='"0.5'): "quoting", line(eaf='"0.5"x'): "quoting", GOOD + ",x": "column_count", GOOD[:-8]: "column_count", line(beta="q"): "invalid_value", line(nea='""G'): "quoting", GOOD: None, line(beta="nan"): None}
    got = {r["line_id"]: r["reader_reason"] for r in split_lines(frame(spark, lines)).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def test_long_line_and_empty_table(spark):
    long = line(snpid='"' + "y" * 3_000_000 + '"')
    assert [r["reason"] for r in split_lines(frame(spark, [long, GOOD, "z" * 3_000_000])).orderBy("line_id").collect()] == [None, None, "column_count"]
    assert rejected_lines(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 5])
def test_repeated_lines_stay(spark, copies):
    assert split_lines(frame(spark, [GOOD] * copies)).count() == copies

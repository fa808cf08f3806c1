"""Delimited lines that do not load: typed rows on one side, rejected lines with a reason on the other.

Workers read the lines with DuckDB's CSV reader and its reject tables, a scratch file of
many lines at a time, with an ordinal in front of every line and an end mark behind it.
The line-level errors of the reject table are joined back to the raw records by that
ordinal and give the reason: a quote error, or a record that ran over its end mark, is
`quoting`; missing or surplus columns are `column_count`; a failed cast is
`invalid_value`. A line that holds a quote is followed by a fence, a line that brings the
reader back to a record's start from any state, so that broken quoting never reaches the
next record.

An exact rule corrects the reader where it is known to be laxer or stricter: quotes inside
fields or beside blanks, `nan` and `1_000`, ` NA `, ranges. It looks at lines with quotes,
at failed casts and at loaded lines with unusual characters or values only; those are read
a second time as text. `reader_reason` keeps what the reader itself said, so the
differences can be counted.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.session import scratch_dir

#: A line whose fields are either without quotes or quoted as a whole.
QUOTING = r'(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*'
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
BLANKS = "' ' || chr(9)"
#: Characters that the reader may overlook or take for white space inside a number.
LAX = r"[_\x0b\x0c]|[^\x00-\x7f]"
#: From within a quoted value it ends the value and the record, from a record's start it is a record of its own.
FENCE = 'x"'
ESCAPE = "\ue000"
ESCAPES = ((ESCAPE, "0"), ("\r", "1"), ("\n", "2"), ("\0", "3"))


@dataclass(frozen=True)
class Field:
    """One field of a line. `check`: none, "number", "share" (0..1) or "positive"; unchecked fields that do not convert become null."""

    name: str
    sql_type: str
    check: str | None = None


GWAS_FIELDS = (
    Field("snpid", "VARCHAR"), Field("chr", "INTEGER"), Field("pos", "INTEGER"), Field("ea", "VARCHAR"), Field("nea", "VARCHAR"),
    Field("eaf", "DOUBLE", "share"), Field("beta", "DOUBLE", "number"), Field("se", "DOUBLE", "positive"),
    Field("chisq", "DOUBLE"), Field("mlog10p", "DOUBLE"), Field("n", "BIGINT"), Field("status", "INTEGER"),
)
MISSING = ("", "NA", ".")
_ARROW = {"VARCHAR": pa.string(), "INTEGER": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}
_SPARK = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double"}


def _bad(field: Field) -> str:
    """SQL that is true if the field's text is not acceptable."""
    text = f"trim(coalesce({field.name}, ''), {BLANKS})"
    missing = f"{text} IN ({', '.join(repr(x) for x in MISSING)})"
    value = f"TRY_CAST({text} AS DOUBLE)"
    wrong = f"NOT regexp_full_match({text}, '{NUMBER}') OR {value} IS NULL OR NOT isfinite({value})"
    if field.check == "share":
        wrong += f" OR {value} < 0 OR {value} > 1"
    elif field.check == "positive":
        wrong += f" OR {value} <= 0"
    return f"(NOT {missing} AND ({wrong}))"


def _typed(field: Field) -> str:
    text = f"trim({field.name}, {BLANKS})"
    value = field.name if field.sql_type == "VARCHAR" else f"CASE WHEN regexp_full_match({text}, '{NUMBER}') THEN TRY_CAST({text} AS {field.sql_type}) END"
    return f"CASE WHEN {text} IN ({', '.join(repr(x) for x in MISSING)}) THEN NULL ELSE {value} END AS {field.name}"


def _read(path: str, fields: tuple[Field, ...], types: bool, longest: int) -> str:
    """read_csv call over one scratch file, with reject tables; checked fields typed, or all fields as text."""
    columns = {"ord": "BIGINT"} | {f.name: f.sql_type if types and f.check else "VARCHAR" for f in fields} | {"line_end": "VARCHAR"}
    spec = ", ".join(f"'{k}': '{v}'" for k, v in columns.items())
    size = max(2_097_152, 4 * longest + 64)
    nulls = f"nullstr=[{', '.join(repr(x) for x in MISSING)}], " if types else ""
    return (
        f"read_csv('{path}', header=false, auto_detect=false, delim=',', quote='\"', escape='\"', new_line='\\n', columns={{{spec}}}, "
        f"max_line_size={size}, buffer_size={2 * size}, strict_mode=true, parallel=false, {nulls}store_rejects=true, rejects_limit=0, rejects_table='errors', rejects_scan='scans')"
    )


def _escaped(text: pa.Array) -> tuple[pa.Array, bool]:
    """Text without line ends and zero bytes, and whether it had to be changed: "\\ue000" starts an escape, itself included."""
    if not pc.any(pc.match_substring_regex(text, "[\\x00\\n\\r\ue000]")).as_py():
        return text, False
    for plain, code in ESCAPES:
        text = pc.replace_substring(text, plain, ESCAPE + code)
    return text, True


def _unescaped(column: str) -> str:
    """SQL that undoes _escaped; the escape itself comes last."""
    for plain, code in reversed(ESCAPES):
        column = f"replace({column}, '{ESCAPE}{code}', chr({ord(plain)}))"
    return column


def _write(path: str, order: pa.Array, text: pa.Array) -> None:
    """ord,text,~ per line, with a fence behind lines that hold a quote."""
    end = pc.if_else(pc.match_substring(text, '"'), f"~\n{FENCE}\n", "~\n")
    lines = pc.binary_join_element_wise(order.cast(pa.string()), text, end, ",").cast(pa.large_string())
    with open(path, "wb") as out:
        for chunk in lines.chunks if isinstance(lines, pa.ChunkedArray) else [lines]:
            offsets, data = chunk.buffers()[1:]
            first, last = (int.from_bytes(offsets[8 * k : 8 * k + 8], "little") for k in (chunk.offset, chunk.offset + len(chunk)))
            out.write(memoryview(data)[first:last] if data else b"")


def _part(con, lines: pa.Table, fields: tuple[Field, ...], folder: str) -> pa.Table:
    """(line_id, reason, reader_reason, raw_text, typed fields) of lines (line_id, line_text)."""
    text = pc.replace_substring_regex(pc.fill_null(lines["line_text"].combine_chunks(), ""), "\\r\\z", "")
    order = pa.array(range(len(text)), pa.int64())
    longest = pc.max(pc.binary_length(text)).as_py() or 0
    safe, changed = _escaped(text)
    path = os.path.join(folder, "part.csv")
    _write(path, order, safe)
    con.register("lines", pa.table({"ord": order, "line_id": lines["line_id"], "line_text": lines["line_text"], "text": text}))
    names = ", ".join(f.name for f in fields)
    checked = [f for f in fields if f.check]
    con.execute("DROP TABLE IF EXISTS errors; DROP TABLE IF EXISTS scans")
    con.execute(f"CREATE OR REPLACE TEMP TABLE loaded AS SELECT ord, {names} FROM {_read(path, fields, True, longest)}")
    # the reader's own verdict, and the exact rule of structure for lines that hold a quote or that the reader is silent about
    con.execute(
        f"""CREATE OR REPLACE TEMP TABLE verdict AS
        WITH e AS (SELECT TRY_CAST(regexp_extract(csv_line, '^([0-9]+),', 1) AS BIGINT) AS ord,
            min(CASE WHEN error_type = 'UNQUOTED VALUE' OR contains(csv_line, chr(10)) THEN 1 WHEN error_type = 'CAST' THEN 3 ELSE 2 END) AS code FROM errors GROUP BY ALL),
        r AS (SELECT l.ord, l.line_id, l.line_text, l.text, e.code, d.ord IS NOT NULL AS loaded, contains(l.text, '"') OR (e.code IS NULL AND d.ord IS NULL) AS look,
            d.ord IS NOT NULL AND ({" OR ".join(f"NOT isfinite(d.{f.name})" for f in checked)}) AS odd FROM lines l LEFT JOIN e USING (ord) LEFT JOIN loaded d USING (ord)),
        x AS (SELECT *, NOT look OR regexp_full_match(text, '{QUOTING}') AS sound,
            CASE WHEN look THEN 1 + len(regexp_replace(text, '(?s)"(?:[^"]|"")*"|[^,]', '', 'g')) END AS n FROM r)
        SELECT ord, line_id, line_text, CASE code WHEN 1 THEN 'quoting' WHEN 2 THEN 'column_count' WHEN 3 THEN 'invalid_value' END AS reader_reason,
            CASE WHEN NOT sound THEN 'quoting' WHEN look AND n <> {len(fields)} OR NOT look AND code < 3 THEN 'column_count' END AS broken,
            NOT loaded OR coalesce(odd, false) OR regexp_matches(text, '{LAX}') AS again FROM x"""
    )
    again = con.sql("SELECT ord FROM verdict WHERE broken IS NULL AND again ORDER BY ord").to_arrow_table()["ord"].combine_chunks()
    if len(again):
        _write(path, again, safe.take(again))
        con.execute("DROP TABLE IF EXISTS errors; DROP TABLE IF EXISTS scans")
        con.execute(f"CREATE OR REPLACE TEMP TABLE texts AS SELECT ord, {names} FROM {_read(path, fields, False, longest)}")
    else:
        con.execute(f"CREATE OR REPLACE TEMP TABLE texts (ord BIGINT, {', '.join(f.name + ' VARCHAR' for f in fields)})")

    def back(f: Field, typed: bool) -> str:
        return f"{_unescaped(f.name)} AS {f.name}" if changed and not (typed and f.check) else f.name

    ranges = {"share": "({0} < 0 OR {0} > 1)", "positive": "{0} <= 0"}
    outside = " OR ".join(ranges[f.check].format(f.name) for f in checked if f.check in ranges) or "false"
    bad = " OR ".join(_bad(f) for f in checked) or "false"
    out = con.sql(
        f"""WITH d AS (SELECT ord, {", ".join(back(f, True) for f in fields)} FROM loaded WHERE ord NOT IN (SELECT ord FROM texts)),
        t AS (SELECT ord, {", ".join(back(f, False) for f in fields)} FROM texts),
        v AS (SELECT ord, coalesce({outside}, false) AS bad, {", ".join(f.name if f.check else _typed(f) for f in fields)} FROM d
              UNION ALL SELECT ord, coalesce({bad}, false), {", ".join(_typed(f) for f in fields)} FROM t)
        SELECT s.line_id, coalesce(s.broken, CASE WHEN v.bad OR v.ord IS NULL THEN 'invalid_value' END) AS reason, s.reader_reason, CASE WHEN s.broken IS NOT NULL OR v.bad OR v.ord IS NULL THEN s.line_text END AS raw_text,
        {", ".join(f"CASE WHEN s.broken IS NULL AND NOT v.bad THEN v.{f.name} END AS {f.name}" for f in fields)} FROM verdict s LEFT JOIN v USING (ord) ORDER BY ord"""
    ).to_arrow_table()
    con.unregister("lines")
    return out


def split_lines(df: DataFrame, fields: tuple[Field, ...] = GWAS_FIELDS, line_id: str = "line_id", text: str = "line_text", lines_at_once: int = 32_768, bytes_at_once: int = 16 << 20) -> DataFrame:
    """One row per line: line_id, reason (null for a line that loads), reader_reason (what the CSV reader itself said), raw_text (the line if rejected) and the typed fields if it loads.

    No shuffle: lines stay in the partition they were read in and are read `lines_at_once` or
    about `bytes_at_once` at a time, so one very large file is spread over all tasks.
    A null or empty line has one field: `column_count`.
    Extra columns of df are ignored. An empty table gives an empty result.
    """
    schema = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), ("reader_reason", pa.string()), ("raw_text", pa.string()), *((f.name, _ARROW[f.sql_type]) for f in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        folder = scratch_dir()

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _part(con, pa.Table.from_batches(held), fields, folder).cast(schema).to_batches()

        try:
            held: list[pa.RecordBatch] = []
            rows = size = 0
            for batch in batches:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if rows >= lines_at_once or size >= bytes_at_once:
                    yield from done(held)
                    held, rows, size = [], 0, 0
            if rows:
                yield from done(held)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    source = df.select(F.col(line_id).cast("bigint").alias("line_id"), F.col(text).cast("string").alias("line_text"))
    ddl = "line_id bigint, reason string, reader_reason string, raw_text string, " + ", ".join(f"{f.name} {_SPARK[f.sql_type]}" for f in fields)
    return source.mapInArrow(read, ddl)


def rejected_lines(df: DataFrame, **options) -> DataFrame:
    """line_id and reason of the lines that do not load."""
    return split_lines(df, **options).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_rows(df: DataFrame, **options) -> DataFrame:
    """The typed rows of the lines that load."""
    return split_lines(df, **options).where(F.col("reason").isNull()).drop("reason", "reader_reason", "raw_text")

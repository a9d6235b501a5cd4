"""Rows that fail to parse: load the valid lines of raw feeds, set the others apart with a reason.

Method. The lines of every file arrive as rows (file, line number, format, line). Workers take them
in bounded blocks (one Arrow batch), write the CSV lines of each file in a block as one scratch
file of the task and let DuckDB read them, file by file in one statement, with ``store_rejects``. Each record is preceded by its row number
in the block, so line-level errors of the reject table are joined to the raw record exactly, and so are the
loaded rows. Records that an unfinished quote of an earlier record of their file swallowed show up in neither; they are
read again, each alone. An exact check of what loaded follows (quoting by RFC 4180, id, embedding).
JSON lines of the same block are read strictly by RFC 8259.

There is no shuffle: one narrow pass whatever the number of files or the size of one file.

Defined results
---------------
* null, blank and ``#`` lines: neither loaded nor rejected.
* unknown or null format: rejected, ``unknown_format``.
* repeated lines: every row is judged by itself; repeated rows give repeated results.
* very long lines: read whole (the reader's line limit follows the longest line of the block).
* empty table: empty result with the full schema.
* extra columns, also such named like the result's: not carried; the result has fixed columns and is
  joined back by raw_id.
"""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import written

EMBEDDING_WIDTH = 16
ID_PATTERN = re.compile(r"[A-Za-z0-9._:\-]{1,64}")
TRIM = " \t\r\n"
#: A record of exactly four fields, quoted as RFC 4180 has it.
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
RECORD = re.compile(_FIELD + (r"," + _FIELD) * 3)
#: Stand-ins for line breaks and for the mark itself, so that every record is one physical line.
_ESC = {"\x1a": "\x1a0", "\n": "\x1a1", "\r": "\x1a2", "\x00": "\x1a3"}
_UNESC = {v: k for k, v in _ESC.items()}

OUT = T.StructType(
    [
        T.StructField("raw_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("observation_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.StringType()),
    ]
)


class _Int(float):
    """A JSON integer that keeps its spelling."""

    def __new__(cls, text: str):
        try:
            self = super().__new__(cls, text)
        except (ValueError, OverflowError):
            self = super().__new__(cls, "inf")
        self.text = text
        return self


class Bad(Exception):
    def __init__(self, reason: str, detail: str = ""):
        super().__init__(reason)
        self.reason, self.detail = reason, detail


def _constant(name: str):
    raise Bad("invalid_json", f"{name} is no JSON value")


def _parse(text: str):
    try:
        return json.loads(text, parse_int=_Int, parse_float=float, parse_constant=_constant)
    except Bad:
        raise
    except RecursionError:
        raise Bad("invalid_json", "nested too deeply") from None
    except ValueError as error:
        raise Bad("invalid_json", str(error)[:200]) from None


def _vector(value) -> list[float] | None:
    """The numbers of an embedding; None where it is missing."""
    if value is None or value == []:
        return None
    if not isinstance(value, list):
        raise Bad("embedding_not_a_list", type(value).__name__)
    if len(value) != EMBEDDING_WIDTH:
        raise Bad("embedding_width", str(len(value)))
    out = []
    for x in value:
        if not isinstance(x, float) or not math.isfinite(x):
            raise Bad("embedding_value", repr(x)[:80])
        out.append(float(x))
    return out


def _checked(ident: str, text, vector, metadata) -> tuple:
    if not ID_PATTERN.fullmatch(ident):
        raise Bad("observation_id", ident[:80])
    if vector is None and (text is None or text == ""):
        raise Bad("no_content", "neither text nor embedding")
    return ident, text, vector, metadata


def _json_line(line: str, line_no) -> tuple:
    value = _parse(line)
    if not isinstance(value, dict):
        raise Bad("not_an_object", type(value).__name__)
    if "observation_id" in value:
        ident = value["observation_id"]
        if isinstance(ident, _Int):
            ident = ident.text
        if not isinstance(ident, str):
            raise Bad("observation_id", "neither string nor integer")
    elif line_no is None:
        raise Bad("observation_id", "absent, and the line has no number")
    else:
        ident = f"obs-{line_no}"
    text = value.get("text")
    meta = value.get("metadata")
    return _checked(
        ident,
        text if text is None or isinstance(text, str) else _plain(text),
        _vector(value.get("embedding")),
        None if meta is None else _plain(meta),
    )


def _plain(value) -> str:
    """A JSON value as text, without blanks; integers are written as integers."""
    return json.dumps(_whole(value), ensure_ascii=False, separators=(",", ":"))


def _whole(value):
    if isinstance(value, _Int):
        return int(value.text) if len(value.text) < 4000 else value.text
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def _csv_fields(fields: list, line: str) -> tuple:
    """The exact check of a record that the reader loaded."""
    if not RECORD.fullmatch(line):
        raise Bad("csv_quoting", "quote or line break outside a quoted field")
    ident, text, vector, metadata = fields
    return _checked(
        ident or "",
        text,
        None if vector in (None, "", "null") else _vector(_parse(vector)),
        metadata or None,
    )


def _escape(line: str) -> str:
    if any(c in line for c in _ESC):
        return "".join(_ESC.get(c, c) for c in line)
    return line


def _sound(value):
    """Lone surrogates, which JSON escapes can spell, can't be stored as UTF-8: the replacement mark stands for them."""
    return value.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else value


def _unescape(value):
    if isinstance(value, str) and "\x1a" in value:
        return re.sub("\x1a[0-3]", lambda m: _UNESC[m[0]], value)
    return value


def _read_csv(con, lines: dict[int, str], files: dict[int, str]) -> tuple[dict[int, list], dict[int, tuple[str, str]]]:
    """Loaded fields and rejects of the records, by row number; a swallowed record is in neither. files: the file of each record."""
    width = max(len(x.encode("utf-8", "surrogatepass")) for x in lines.values()) + 64
    by_file: dict[str, list[str]] = {}
    for i, x in lines.items():
        by_file.setdefault(files[i], []).append(f"{i},{x}\n")
    with tempfile.TemporaryDirectory() as scratch:  # of this task alone, gone when it ends
        paths = []
        for k, records in enumerate(by_file.values()):
            paths.append(os.path.join(scratch, f"{k}.csv"))
            with open(paths[-1], "w", encoding="utf-8", errors="replace", newline="") as out:
                out.writelines(records)
        rows = con.execute(
            f"""SELECT * FROM read_csv({paths}, header=false, auto_detect=false, delim=',', quote='"',
                escape='"', columns={{'n': 'BIGINT', 'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR', 'd': 'VARCHAR'}},
                nullstr='\x1aNULL', strict_mode=true, null_padding=false, store_rejects=true, rejects_limit=0,
                parallel=false, new_line='\\n', max_line_size={max(2_097_152, 2 * width)},
                buffer_size={max(4_194_304, 4 * width)})"""
        ).fetchall()
        errors = con.execute("SELECT csv_line, error_type::VARCHAR, error_message FROM reject_errors ORDER BY file_id, line, byte_position").fetchall()
        con.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
    loaded = {r[0]: list(r[1:]) for r in rows if r[0] in lines and not any(isinstance(v, str) and "\n" in v for v in r[1:])}
    rejected: dict[int, tuple[str, str]] = {}
    for csv_line, kind, message in errors:
        head = re.match(r"(\d+),", csv_line or "")
        if head and int(head[1]) in lines and int(head[1]) not in loaded:
            rejected.setdefault(int(head[1]), (kind, (message or "").split("\n")[0][:200]))
    return loaded, rejected


_KINDS = {
    "MISSING COLUMNS": "csv_missing_columns",
    "TOO MANY COLUMNS": "csv_too_many_columns",
    "UNQUOTED VALUE": "csv_quoting",
    "UNTERMINATED QUOTES": "csv_unterminated_quote",
    "LINE SIZE OVER MAXIMUM": "csv_line_size",
    "INVALID ENCODING": "csv_encoding",
    "INVALID STATE": "csv_quoting",
}


def _csv_block(lines: dict[int, str], files: dict[int, str]) -> dict[int, object]:
    """Fields of each record of a block, or Bad with the reader's reason."""
    import duckdb

    con = duckdb.connect()
    try:
        con.execute("SET threads=1")
        # an odd number of quotes can't be framed: such a record would swallow those after it
        found: dict[int, object] = {i: Bad("csv_unterminated_quote", "odd number of quotes") for i, x in lines.items() if x.count('"') % 2}
        ready = {i: _escape(x) for i, x in lines.items() if i not in found}
        loaded, rejected = _read_csv(con, ready, files) if ready else ({}, {})
        for i in [i for i in ready if i not in loaded and i not in rejected]:
            one_loaded, one_rejected = _read_csv(con, {i: ready[i]}, files)
            loaded |= one_loaded
            rejected[i] = one_rejected.get(i, ("INVALID STATE", "record can't be framed"))
        for i in ready:
            if i in loaded:
                found[i] = [_unescape(v) for v in loaded[i]]
            else:
                kind, message = rejected[i]
                found[i] = Bad(_KINDS.get(kind, "csv_error"), message)
        return found
    finally:
        con.close()


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    lines = [None if not isinstance(x, str) else x.strip(TRIM) for x in pdf["raw_line"]]
    todo = [i for i, x in enumerate(lines) if x and x[0] != "#"]
    formats = pdf["fmt"].tolist()
    numbers = [None if pd.isna(x) else int(x) for x in pdf["line_no"]]
    ids = [None if pd.isna(x) else int(x) for x in pdf["raw_id"]]
    csv = {i: lines[i] for i in todo if formats[i] == "csv"}
    files = {i: str(name) for i, name in enumerate(pdf["batch_file"])}
    fields = _csv_block(csv, files) if csv else {}
    for i in todo:
        try:
            if formats[i] == "jsonl":
                got = _json_line(lines[i], numbers[i])
            elif formats[i] == "csv":
                if isinstance(fields[i], Bad):
                    raise fields[i]
                got = _csv_fields(fields[i], lines[i])
            else:
                raise Bad("unknown_format", str(formats[i])[:40])
            out.append((ids[i], "loaded", None, None, got[0], _sound(got[1]), got[2], _sound(got[3])))
        except Bad as bad:
            out.append((ids[i], "rejected", bad.reason, _sound(bad.detail), None, None, None, None))
    return pd.DataFrame(out, columns=OUT.names, dtype=object)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = _block(pdf)
        if len(got):
            got["raw_id"] = got["raw_id"].astype("Int64")
            yield got


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row for each line that loads or fails: status, reason, detail and the typed observation.

    ``lines`` needs raw_id, batch_file, line_no, fmt and raw_line; a null file is one of its own.
    """
    return lines.select("raw_id", "batch_file", F.col("line_no").cast("int").alias("line_no"), "fmt", "raw_line").mapInPandas(_blocks, OUT)


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects): the typed observations, and the rejected lines with their raw record."""
    parsed = written(parse_lines(lines), "parsed")  # once for both
    good = parsed.where("status = 'loaded'").select("raw_id", "observation_id", "text", "embedding", "metadata")
    bad = parsed.where("status = 'rejected'").select("raw_id", "reason", "detail")
    raw = lines.select("raw_id", "batch_file", "line_no", "fmt", "raw_line", "received_at")
    return good, bad.join(raw, "raw_id")

"""Sources: observations from JSONL, code streams from JSON, plain JSONL rows.

JSONL files are read in splits, by as many tasks as they have blocks. A line's number is its place in its split, counted by
the task that parses it, plus the lines of the splits before, which a first pass counts (one row for each split).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import strip
from tessera.session import ship, written

SPLIT = ["path", "start"]
_PARSED = "path string, start bigint, at bigint, bad boolean, observation_id string, embedding array<double>, text string, metadata string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): the physical lines; start is where a line's split begins in its file."""
    return spark.read.text(str(path)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _offsets(lines: DataFrame) -> DataFrame:
    """(path, start, in_file, in_all): the lines before a split in its file, and in all files."""
    n = lines.groupBy(*SPLIT).agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each split
    return written(n.select(*SPLIT, before(Window.partitionBy("path").orderBy("start")).alias("in_file"), before(Window.orderBy(*SPLIT)).alias("in_all")), "splits")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The splits of a partition come one after another, each in order."""
    split, at = None, 0
    names = [c.split()[0] for c in _PARSED.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string())
    for batch in batches:
        out = []
        for path, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, start) != split:
                split, at = (path, start), 0
            at += 1
            line = line.strip()
            if not line or line[0] == "#":
                continue
            try:
                data = json.loads(line)
            except ValueError:
                out.append((path, start, at, True, None, [], None, None))
                continue
            name = str(data["observation_id"]) if "observation_id" in data else None
            vector = [float(x) for x in data.get("embedding") or []]
            out.append((path, start, at, False, name, vector, data.get("text"), json.dumps(data.get("metadata") or {})))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def load_observations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ord, observation_id, embedding, text, metadata) of a JSONL file, or of all files of a folder.

    ord is the physical line number, over all files in the order of their paths. Blank and ``#`` lines are skipped; a line that is no
    JSON is an error naming path and line; a row without observation_id is called ``obs-<line of its file>``; no row at all is an error. (For feeds with
    broken lines use ``tessera.sources.rejects``, which sets them apart instead.)
    """
    ship(spark)
    lines = _lines(spark, path)
    text = strip(F.col("line"))
    if lines.where((text != "") & ~F.startswith(text, F.lit("#"))).isEmpty():
        raise ValueError(f"no observations in {path}")
    rows = lines.mapInArrow(_parse, _PARSED).join(_offsets(lines), SPLIT)
    number = F.col("in_file") + F.col("at")
    blame = F.raise_error(F.format_string("%s:%d invalid JSON", "path", number)).cast("string")
    name = F.when(F.col("bad"), blame).otherwise(F.coalesce("observation_id", F.concat(F.lit("obs-"), number)))
    return rows.select((F.col("in_all") + F.col("at")).alias("ord"), name.alias("observation_id"), "embedding", "text", "metadata")


def iter_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The objects of a JSONL file as rows; blank lines are skipped, nothing else is."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(str(path))


def load_stream(spark: SparkSession, path: str) -> DataFrame:
    """(pos, code) from a JSON list, or an object with ``codes``; anything else is an error. Numbers are cut to whole ones, true is 1.

    One JSON document can't be split: a file is one row (below 2 GB); longer streams belong into a table.
    """
    wrong = 'stream file must be a JSON list or {"codes": [...]}'
    whole = spark.read.text(str(path), wholetext=True)
    given = whole.select(F.coalesce(F.from_json("value", "struct<codes:array<string>>")["codes"], F.from_json("value", "array<string>")).alias("codes"))
    if given.where("codes is not null").isEmpty():
        raise ValueError(wrong)
    item = F.trim("item")
    number = F.when(item == "true", 1).when(item == "false", 0).when(item.rlike(r"^[+-]?\d+$"), item.cast("int")).otherwise(item.cast("double").cast("int"))
    number = F.when(F.col("item").isNull(), F.raise_error(F.lit("a code is null")).cast("int")).otherwise(number)
    return given.select(F.posexplode("codes").alias("pos", "item")).select(F.col("pos").cast("bigint").alias("pos"), number.alias("code"))

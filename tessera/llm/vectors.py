"""Vectors of the two tables that hold them, as unit vectors in numpy.

Usable: exactly ``WIDTH`` elements, none null, NaN or infinite, not all zero. Usable rows with one non-null
observation_id are one observation, known by its smallest ord; rows with one symbol_id are one symbol.
Records with the same 16-bit unit vector are copies: searches see one of them, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import forget, table, written

WIDTH = 64
KINDS = ("observation", "symbol")
SCALE = 32767.0


def raw_vectors(spark, sf_dir: str) -> DataFrame:
    """(kind int, id bigint, key string, v array<double>) of both tables; key says which rows are one record."""
    seen = table(spark, sf_dir, "observations").select(F.lit(0).alias("kind"), F.col("ord").alias("id"), F.col("observation_id").alias("key"), F.col("embedding").alias("v"))
    symbols = table(spark, sf_dir, "symbols").select(F.lit(1).alias("kind"), F.col("symbol_id").alias("id"), F.col("symbol_id").cast("string").alias("key"), F.col("proto_embedding").alias("v"))
    return seen.unionByName(symbols)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and their unit vectors (float64)."""
    n = len(column)
    flat = column.flatten().cast(pa.float64())  # without the lists that are null
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) if n else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    whole = np.flatnonzero(size == WIDTH)
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    rows = values[(start[whole, None] + np.arange(WIDTH)).ravel()].reshape(-1, WIDTH) if len(whole) else np.zeros((0, WIDTH))
    with np.errstate(all="ignore"):
        top = np.abs(rows).max(axis=1, initial=0.0)
        good = np.isfinite(rows).all(axis=1) & (top > 0)
        rows = rows[good] / top[good, None]  # so that squares neither overflow nor vanish
        rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
    return whole[good], rows


def pack(rows: np.ndarray) -> pa.Array:
    """Unit vectors as 16-bit numbers: 128 bytes each, cosines are exact to about 1e-5."""
    data = np.ascontiguousarray(np.rint(rows * SCALE).astype(np.int16))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (2 * WIDTH)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [np.zeros((0, WIDTH), dtype=np.int16)]
    for part in parts:
        _, offsets, data = part.buffers()
        if len(part):
            first = np.frombuffer(offsets, dtype=np.int32)[part.offset]
            rows.append(np.frombuffer(data, dtype=np.int16, count=len(part) * WIDTH, offset=int(first)).reshape(-1, WIDTH))
    return np.concatenate(rows).astype(np.float32) / np.float32(SCALE)


def true_cells(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true cells; few are, so eight are looked at at once."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.ravel().view(np.uint64) != 0)
    cells = ((words << 3)[:, None] + np.arange(8)).ravel()
    return cells[mask.ravel()[cells]]


def records(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable vectors of (kind, id, key, v) as written tables: (kind, id, q) of distinct ones, (kind, id, rep) of their copies.

    q is the 16-bit unit vector. Of records with the same q the smallest id stands for all; the others are its copies,
    however many they are, and are brought back by id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column(3))
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), batch.column(2).take(keep), pack(rows)], names=["kind", "id", "key", "q"])

    usable = written(vectors.select("kind", "id", "key", "v").mapInArrow(run, "kind int, id bigint, key string, q binary"), "usable", tidy=True)
    again = written(usable.where("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1").select("kind", "key"), "repeats", tidy=True)
    first = usable.join(again, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.min(F.struct("id", "q")).alias("r")).select("kind", "r.id", "r.q")
    known = usable.join(again, ["kind", "key"], "left_anti").select("kind", "id", "q").unionByName(first)
    marks = known.select("kind", "id", F.unhex(F.md5("q")).alias("mark"))
    alike = marks.groupBy("kind", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("kind", "mark", "rep")
    copies = written(marks.join(written(alike, "alike", tidy=True), ["kind", "mark"]).where("id > rep").select("kind", "id", "rep"), "copies", tidy=True)
    rows = written(known.join(copies.select("kind", "id"), ["kind", "id"], "left_anti"), "records", tidy=True)
    for step in (usable, again):
        forget(step)
    return rows, copies


def smallest_copies(copies: DataFrame, most: int) -> DataFrame:
    """(kind, rep, n, smallest): how many copies a vector has, and the ``most`` smallest ids of them; by hash buckets first, as one vector may have a third of all rows."""
    some = Window.partitionBy("kind", "rep", F.pmod("id", F.lit(64))).orderBy("id")
    last = Window.partitionBy("kind", "rep").orderBy("id")
    few = copies.withColumn("r", F.row_number().over(some)).where(F.col("r") <= most).withColumn("r", F.row_number().over(last)).where(F.col("r") <= most)
    few = few.groupBy("kind", "rep").agg(F.sort_array(F.collect_list("id")).alias("smallest"))
    return copies.groupBy("kind", "rep").agg(F.count("*").alias("n")).join(few, ["kind", "rep"])

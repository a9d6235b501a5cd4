"""The k most similar other vectors of every vector.

Method. Cross-polytope hashing: three rounds of random signs and fast Hadamard transforms rotate the unit vectors; the
nearest signed axes of the first ``m`` coordinates are a vector's buckets. Each of several rotations is a table;
a vector enters the buckets of its ``PROBES`` nearest axes, so two vectors meet in a table if any of their probes
agree. The candidates of a bucket are ranked exactly (to 1e-5; 16-bit components) by blocked matrix products,
each product serving both sides.

Scale. ``m`` grows with the number of vectors so that a bucket keeps its size; once all signed
axes are in use a second rotation divides the buckets further, with one or two probes, whichever takes fewer entries. More buckets part more
neighbours, so the number of tables grows with them until two vectors of the cosine asked for meet with the chance asked for, whatever the
size (``Layout``). Searches for close pairs only (``close_pairs``) ask for the least cosine and a chance of ``SURE``, in small buckets; searches for the
k nearest ask for the cosine at which the last of them is to be expected (``far_cosine``), and ``LEVEL``. Copies of a vector are set aside first and brought
back by id, so a third of all rows in one direction is one row here. Bucket sizes are counted first; a bucket much above the mean is divided into blocks, and all pairs
of blocks are ranked in tasks of their own: nothing is capped and no candidate of such a bucket is lost.

Accuracy. What is lost are neighbours that share no probe. Neighbours above cosine 0.85 are found almost
surely; for vectors without any near neighbour the fifth nearest lies at about 0.45, and some of those are
missed, at most about 1 - ``LEVEL`` of them at any size. ``recall`` measures both against brute force (README has figures).

Defined results
---------------
* unusable vectors take no part; repeated rows are one record (see ``vectors``).
* ties: any of the equal neighbours, with the smaller id first. * fewer than k others: as many as there are.
* identical vectors under different ids are neighbours with cosine 1; of more than k copies of a vector each has the k of the smallest ids.
* empty tables: empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vectors import WIDTH, records, smallest_copies, true_cells, unpack
from tessera.session import written

K = 5
TABLES = 2
PROBES = 2
LEVEL = 0.75
SURE = 0.9999
BUCKET_ROWS = 25_000
CLOSE_ROWS = 4_000
BLOCK_ROWS = 60_000
#: Rows that one task of the ranking is meant to hold.
TASK_ROWS = 250_000
SEED = 20_240_117
#: Candidates held before they are merged into the lists, and rows sent at a time.
HELD = 40_000
#: No more than this is a cosine of 16-bit vectors off: two rounding errors of half a step over at most 8 in absolute sum.
ERROR = 2.5e-4


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, width = rows.shape
    step = 1
    while step < width:
        rows = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / math.sqrt(width)


@functools.cache
def _rotation(turn: int) -> np.ndarray:
    """What three rounds of random signs and Hadamard transforms do to the unit axes: the rotation as a matrix."""
    rows = np.eye(WIDTH)
    for signs in np.random.default_rng(SEED + turn).choice(np.array([-1.0, 1.0]), size=(3, WIDTH)):
        rows = _hadamard(rows * signs)
    return rows


def rotate(rows: np.ndarray, turn: int) -> np.ndarray:
    """Pseudo-random rotation number ``turn``, for many rows at once as one product."""
    return rows @ _rotation(turn)


def axes(rows: np.ndarray, turn: int, m: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 0..m-1 positive, m..2m-1 negative."""
    turned = rotate(rows, turn)[:, :m]
    both = np.concatenate([turned, -turned], axis=1)
    probes = min(probes, 2 * m)
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1), 1)


def far_cosine(rows: int, k: int = K) -> float:
    """The cosine at which the k-th nearest of so many vectors is to be expected, spread evenly; less 0.08, as those of a table are not."""
    return max(0.4, math.sqrt(1 - min(1.0, k / max(rows, 1)) ** (2 / (WIDTH - 1))) - 0.08)


class Layout:
    """The buckets of the tables of one kind, by the number of its vectors and the chance two of cosine ``far`` are to meet with."""

    def __init__(self, kind: int, rows: int, far: float | None = None, level: float = LEVEL, bucket_rows: int = BUCKET_ROWS):
        self.kind, self.far = kind, far_cosine(rows) if far is None else far
        want = max(1.0, rows * PROBES / bucket_rows)
        self.m = min(WIDTH, max(2, 2 ** math.ceil(math.log2(want) - 1)))
        self.sub = max(0, math.ceil(math.log2(max(1.0, want / (2 * self.m))) - 1e-9))
        choices = []
        for self.fine in (1, 2) if self.sub else (1,):
            met = min(max(self.meeting(), 1e-3), 1 - 1e-4)
            self.tables = max(TABLES, math.ceil(math.log(1 - level) / math.log(1 - met)))
            choices.append((self.tables * self.fine, self.fine, self.tables))
        _, self.fine, self.tables = min(choices)

    def meeting(self, cos: float | None = None, pairs: int = 8000, tables: int = 4) -> float:
        """The chance that two vectors of a cosine meet in one table: the mean of a few tables, over random pairs."""
        cos = self.far if cos is None else cos
        rng = np.random.default_rng(SEED)
        a, b = rng.normal(size=(2, pairs, WIDTH))
        a /= np.sqrt((a * a).sum(axis=1))[:, None]
        b -= (a * b).sum(axis=1)[:, None] * a
        b = cos * a + math.sqrt(1 - cos * cos) * b / np.sqrt((b * b).sum(axis=1))[:, None]
        return float(np.mean([(self.table(a, t)[:, :, None] == self.table(b, t)[:, None, :]).any(axis=(1, 2)).mean() for t in range(tables)]))

    def table(self, rows: np.ndarray, t: int) -> np.ndarray:
        """Bucket numbers in table t, PROBES times ``fine`` for each row."""
        near = axes(rows, 2 * t, self.m, PROBES).astype(np.int64)
        if self.sub:
            fine = axes(rows, 2 * t + 1, min(2 ** (self.sub - 1), WIDTH), self.fine)
            near = ((near[:, :, None] << 20) + fine[:, None, :]).reshape(len(rows), -1)
        else:
            near = near << 20
        return (((self.kind << 16) + t) << 40) + near

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """Bucket numbers of each row in all tables."""
        return np.concatenate([self.table(rows, t) for t in range(self.tables)], axis=1)


def entries(layouts: dict[int, Layout], kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every bucket a row enters, by row."""
    row, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        numbers = layouts[kind].buckets(rows[own])
        row.append(np.repeat(own, numbers.shape[1]))
        bucket.append(numbers.ravel())
    row, bucket = np.concatenate(row), np.concatenate(bucket)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def top_pairs(rows: np.ndarray, k: int, side: np.ndarray | None = None, least: float = -2.0, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of the k nearest others of each row (-1 and -2 where there are fewer).

    With ``side`` only rows of different sides are compared, with ``least`` only neighbours above it are kept.
    """
    n = len(rows)
    best, where = np.full((n, k), -2.0, dtype=np.float32), np.full((n, k), -1, dtype=np.int64)
    floor = np.full(n, least, dtype=np.float32)

    def merge(at: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        touched = np.zeros(n, dtype=bool)
        touched[at] = True
        some = np.flatnonzero(touched)
        r = np.concatenate([np.repeat(some, k), at])
        o = np.concatenate([where[some].ravel(), other])
        v = np.concatenate([best[some].ravel(), value])
        key = (r << 33) + ((2.0 - v) * 2**30).astype(np.int64)  # by row, then by cosine falling
        order = np.argsort(key)
        take = order[(np.searchsorted(key[order], some << 33)[:, None] + np.arange(k)).ravel()]
        best[some], where[some] = v[take].reshape(-1, k), o[take].reshape(-1, k)
        floor[some] = np.maximum(best[some, -1], np.float32(least))

    def survivors(c: np.ndarray, limit: np.ndarray, rows_at: int, cols_at: int) -> None:
        if (limit == -2).any() and c.shape[1] > 4 * k:  # nothing known yet: the k-th largest here is a first bound
            bound = np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k]
            hit = true_cells(c >= np.maximum(limit, bound)[:, None])
        else:
            hit = true_cells(c > limit[:, None])
        take(c, hit, rows_at, cols_at, False)

    def take(c: np.ndarray, hit: np.ndarray, rows_at: int, cols_at: int, across: bool) -> None:
        if len(hit):
            value = c.ravel()[hit]
            real = value > -1.5
            i, j = np.divmod(hit[real], c.shape[1])
            pending.append((j + cols_at, i + rows_at, value[real]) if across else (i + rows_at, j + cols_at, value[real]))

    def flush(above: int = 0) -> None:
        if sum(len(p[0]) for p in pending) > above:
            merge(*(np.concatenate(x) for x in zip(*pending)))
            pending.clear()

    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    starts = list(range(0, n, block))
    for gap in range(len(starts)):  # diagonal blocks first, they give every row a bound
        for a in range(len(starts) - gap):
            lo, hi = starts[a], starts[a + gap]
            c = rows[lo : lo + block] @ rows[hi : hi + block].T
            if gap == 0:
                np.fill_diagonal(c, -2.0)
            if side is not None:
                c[side[lo : lo + block, None] == side[None, hi : hi + block]] = -2.0
            survivors(c, floor[lo : lo + block], lo, hi)
            flush(gap and HELD)  # bounds may lag behind by what is held
            if gap:
                limit = floor[hi : hi + block]
                if (limit == -2).any():
                    survivors(np.ascontiguousarray(c.T), limit, hi, lo)
                    flush()
                else:
                    take(c, true_cells(c > limit), lo, hi, True)
    flush()
    return where, best


def neighbour_lists(rows: DataFrame, layouts: dict[int, Layout], least: float = -2.0, k: int = K) -> DataFrame:
    """(kind, id, other, cos): of each vector in each bucket its k nearest there, down to cosine ``least``.

    rows: (kind int, id bigint, q binary) as of ``records``, distinct.
    """

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bucket = entries(layouts, batch.column(0).to_numpy(), unpack(batch.column(1)))
            name, n = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["bucket", "n"])

    sizes = rows.select("kind", "q").mapInArrow(loads, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    tally = written(sizes, "bucket-sizes")
    total = tally.agg(F.sum("n")).first()[0] or 0
    # only buckets far above the mean, at most one for BLOCK_ROWS entries
    blocks = {r["bucket"]: -(-r["n"] // (BLOCK_ROWS // 2)) for r in tally.where(F.col("n") > BLOCK_ROWS).collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, bucket = entries(layouts, kinds, unpack(batch.column(2)))
            part, side = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int8)
            if blocks:
                hot = np.isin(bucket, list(blocks))
                extra = [(row[~hot], bucket[~hot], part[~hot], side[~hot])]
                for name, n in blocks.items():
                    own = row[bucket == name]
                    mine = (ids[own] * 2_654_435_761 % 4_294_967_296) % n
                    for other in range(n):
                        low, high = np.minimum(mine, other), np.maximum(mine, other)
                        extra.append((own, np.full(len(own), name), low * n + high, (mine > other).astype(np.int8)))
                row, bucket, part, side = (np.concatenate(x) for x in zip(*extra))
            for lo in range(0, len(row), HELD):
                own = pa.array(row[lo : lo + HELD])
                columns = [pa.array(x[lo : lo + HELD]) for x in (bucket, part, side)]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k).take(own) for k in range(3))], names=["bucket", "part", "side", "kind", "id", "q"])

    def ranked(group: pa.Table) -> pa.Table:
        ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        x, side = unpack(group.column("q"))[first], side[first]
        where, cos = top_pairs(x, k, side if side.any() else None, least)
        a, j = np.nonzero((where >= 0) & (cos >= least))
        kind = np.full(len(a), group.column("kind")[0].as_py(), dtype=np.int32)
        return pa.table({"kind": kind, "id": ids[a], "other": ids[where[a, j]], "cos": cos[a, j]})

    # a part of two different blocks compares across them; a part of one block within it
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    spreaded = rows.select("kind", "id", "q").mapInArrow(spread, "bucket bigint, part bigint, side tinyint, kind int, id bigint, q binary").repartition(tasks, "bucket", "part")
    return spreaded.groupBy("bucket", "part").applyInArrow(ranked, "kind int, id bigint, other bigint, cos float")


def with_copies(lists: DataFrame, copies: DataFrame, k: int = K) -> DataFrame:
    """The lists of the vectors that were searched, with and for their copies (kind, id, rep)."""
    group = written(smallest_copies(copies, k).select("kind", "rep", "n", F.concat(F.array("rep"), "smallest").alias("mates")), "mates")
    mates = group.select("kind", F.col("rep").alias("other"), "mates")
    wide = lists.join(mates, ["kind", "other"], "left").select("kind", "id", F.explode(F.coalesce("mates", F.array("other"))).alias("other"), "cos")
    # those with fewer than k copies take over what their vector has found
    few = copies.join(group.where(F.col("n") < k).select("kind", "rep"), ["kind", "rep"])
    taken = wide.withColumnRenamed("id", "rep").join(few, ["kind", "rep"]).select("kind", "id", "other", "cos")
    alike = copies.unionByName(group.select("kind", F.col("rep").alias("id"), "rep")).join(group.select("kind", "rep", "mates"), ["kind", "rep"])
    alike = alike.select("kind", "id", F.explode("mates").alias("other"), F.lit(1.0).cast("float").alias("cos")).where("id != other")
    return wide.unionByName(taken).unionByName(alike)


def _layouts(rows: DataFrame, scale: int = 1, **options) -> dict[int, Layout]:
    sizes = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}  # as many rows as kinds
    return {kind: Layout(kind, n * scale, **options) for kind, n in sizes.items()}


def _best(lists: DataFrame, k: int) -> DataFrame:
    # one shuffle: a partition of (kind, id) serves both the grouping and the ranks
    once = lists.repartition("kind", "id").groupBy("kind", "id", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("cos"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int = K, scale: int = 1) -> DataFrame:
    """(kind, id, other, cos, rank): the k most similar other vectors of every vector. scale: the layout of a table so many times as large."""
    rows, copies = records(vectors)
    return _best(with_copies(neighbour_lists(rows, _layouts(rows, scale), k=k), copies, k), k)


def exact_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (kind, a, b) with the cosine of the full vectors; only vectors that occur in pairs are read on."""
    asked = pairs.select("kind", F.col("a").alias("id")).union(pairs.select("kind", F.col("b").alias("id"))).distinct()
    rows = vectors.join(written(asked, "asked"), ["kind", "id"], "left_semi").groupBy("kind", "id").agg(F.first("v").alias("v"))
    rows = written(rows, "pair-vectors")
    both = pairs.join(rows.select("kind", F.col("id").alias("a"), F.col("v").alias("va")), ["kind", "a"]).join(rows.select("kind", F.col("id").alias("b"), F.col("v").alias("vb")), ["kind", "b"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return both.select("kind", "a", "b", (dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb"))).alias("cos"))


def close_pairs(vectors: DataFrame, least: float = 0.99, k: int = K) -> DataFrame:
    """(kind, a, b), a < b: pairs of at least that cosine of which one is among the k nearest of the other.

    Pairs within the rounding error of the bound are decided by the full vectors.
    """
    rows, copies = records(vectors)
    layouts = _layouts(rows, far=least, level=SURE, bucket_rows=CLOSE_ROWS)  # whatever is nearer than a pair asked for has at least its cosine
    near = _best(with_copies(neighbour_lists(rows, layouts, least - ERROR, k), copies, k), k)
    pairs = near.groupBy("kind", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cos").alias("cos"))
    pairs = written(pairs, "close")
    doubtful = pairs.where(F.col("cos") < least + ERROR).select("kind", "a", "b")
    sure = pairs.where(F.col("cos") >= least + ERROR).select("kind", "a", "b")
    return sure.unionByName(exact_cosine(doubtful, vectors).where(F.col("cos") >= least).select("kind", "a", "b"))

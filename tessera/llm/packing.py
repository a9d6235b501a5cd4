"""Filling containers of fixed capacity with items of varying length.

Method. Hierarchical multi-length packing. Items longer than the capacity are cut into full pieces and a rest; every
other item stays whole. (1) Pieces are routed to the smallest of several context-size tiers that holds them. (2) Each tier is
packed, the longest first: a piece opens a window of its tier's size, and the gap is filled from the shorter
tiers, by one or two pieces that fill it exactly; a window that can't be filled exactly is left as it is, so that no short piece is
wasted on it. (3) Windows are combined into containers by their used lengths, the longest first: gaps of long windows are
filled from the windows of shorter tiers, exactly where one or two windows do, else with the largest that fits. (4) Containers are dealt to step groups
in snake order of their fill, so that all groups carry about the same number of tokens.

Only lengths matter for the plan, so it is made on counts: at most ``capacity`` distinct lengths, whatever the
number of items. The plan (patterns of windows and of containers with multiplicities, at most a few per length) is applied to
the pieces by their rank among the pieces of equal length; ranks are counted in hash buckets of the item id,
so that a length shared by a third of all items is no hot group.

Defined results
---------------
* length 0 (null and empty texts): the item takes no space; piece 0 with null container, offset and group.
* null or negative length: as 0. * repeated rows: every row is an item of its own.
* null ids are items like others. * empty table: empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

CAPACITY = 2048
TIERS = (512, 1024, 2048)
GROUP = 8


Patterns = list[tuple[int, list[int]]]


def windows(counts: np.ndarray, tiers: tuple[int, ...]) -> Patterns:
    """Windows (multiplicity, piece lengths) of all tiers that use up counts[length] pieces of every length."""
    left = counts.astype(np.int64).copy()
    out: Patterns = []
    bounds = sorted(tiers, reverse=True)
    for tier, shorter in zip(bounds, [*bounds[1:], 0]):
        for length in range(tier, shorter, -1):
            while left[length]:
                out.append(_take(left, [length, *_exact(left, tier - length, shorter)]))
    return out


def containers(counts: np.ndarray) -> Patterns:
    """Containers (multiplicity, window lengths) that use up counts[length] windows of every length."""
    left = counts.astype(np.int64).copy()
    out: Patterns = []
    for length in range(len(counts) - 1, 0, -1):
        while left[length]:
            need, pieces, gap = {length: 1}, [length], len(counts) - 1 - length
            while gap > 0 and (fill := _fill(left, need, gap)):
                for x in fill:
                    pieces.append(x)
                    need[x] = need.get(x, 0) + 1
                    gap -= x
            out.append(_take(left, pieces))
    return out


def _take(left: np.ndarray, pieces: list[int]) -> tuple[int, list[int]]:
    """The pattern as often as there are pieces for it."""
    need = Counter(pieces)
    times = min(int(left[x]) // n for x, n in need.items())
    for x, n in need.items():
        left[x] -= times * n
    return times, pieces


def _exact(left: np.ndarray, gap: int, most: int) -> list[int]:
    """One or two pieces of length ``most`` or less that fill a gap, if there are any."""
    if 0 < gap <= most and left[gap]:
        return [gap]
    there = left[: gap + 1] > 0
    there[0] = False
    there[most + 1 :] = False
    pair = there & there[::-1]
    if gap % 2 == 0 and left[gap // 2] < 2:
        pair[gap // 2] = False
    found = np.flatnonzero(pair)
    return [int(found[-1]), gap - int(found[-1])] if len(found) else []


def _fill(left: np.ndarray, need: dict[int, int], gap: int) -> list[int]:
    """Windows for a gap: one that fits exactly, two that do, or the largest that fits."""
    free = left[: gap + 1].copy()
    for x, n in need.items():
        if x <= gap:
            free[x] -= n
    found = np.flatnonzero(free[1:] > 0)
    return _exact(free, gap, gap) or ([int(found[-1]) + 1] if len(found) else [])


def _runs(patterns: Patterns, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first number of the pattern, offset): which pieces, by rank among those of one length, go where."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and offset of the pattern that holds a piece."""
    at = np.searchsorted((runs[:, 0] << 44) + runs[:, 1], (length << 44) + rank, side="right") - 1
    return runs[at, 2] + rank - runs[at, 1], runs[at, 3]


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """(id, piece, size, tier, container_id, offset, step_group) of every piece of every item."""
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    tiers = tuple(sorted({*(t for t in tiers if t < capacity), capacity}))
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    full = F.floor(F.col("n") / capacity).cast("int")
    sizes = F.when(F.col("n") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), full), F.array(F.col("n") % capacity)), lambda x: x > 0)
    )
    pieces = items.select(F.col(id_col).alias("item"), size.alias("n")).select("item", F.posexplode(sizes).alias("piece", "size"))
    pieces = written(pieces, "pieces")

    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.where("size > 0").groupBy("size").count().collect():  # at most ``capacity`` rows
        counts[row["size"]] = row["count"]
    made = windows(counts, tiers)
    made.sort(key=lambda p: sum(p[1]))  # windows of one length are numbered together
    used = np.zeros(capacity + 1, dtype=np.int64)
    for times, lengths in made:
        used[sum(lengths)] += times
    patterns = containers(used)
    patterns.sort(key=lambda p: -sum(p[1]))
    total = sum(times for times, _ in patterns)
    groups = max(1, -(-total // group))
    to_window, to_container = _runs(made, capacity), _runs(patterns, capacity)
    first_window = np.cumsum(used) - used  # of each length
    bounds = np.array(tiers, dtype=np.int64)

    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)))
    own = placed.where("size > 0").groupBy("size", "bucket").count()
    before = own.select("size", "bucket", (F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("item", "piece")) - 1
    ranked = placed.withColumn("rank", rank.cast("bigint")).join(before, ["size", "bucket"], "left").select("item", "piece", "size", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            none = lengths == 0
            order = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            container, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            some = np.flatnonzero(~none)
            window, within = _place(to_window, lengths[some], order[some])
            used_length = np.searchsorted(first_window, window, side="right") - 1
            container[some], offset[some] = _place(to_container, used_length, window - first_window[used_length])
            offset[some] += within
            turn, place_in = container // groups, container % groups
            step = np.where(turn % 2 == 0, place_in, groups - 1 - place_in)
            tier = bounds[np.searchsorted(bounds, lengths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tier), pa.array(container, mask=none), pa.array(offset, mask=none), pa.array(step, mask=none)],
                names=[id_col, "piece", size_col, "tier", "container_id", "offset", "step_group"],
            )

    return ranked.mapInArrow(place, f"{id_col} {kind}, piece int, {size_col} bigint, tier bigint, container_id bigint, offset bigint, step_group bigint")

"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles.

Method. Bottom-up leaf peeling: a node without open children is peeled and sends what lies below it, the
subtree size and the list of its descendants, to its parent, which opens up when its last
child is peeled. Reverse peel order then assigns root, depth and path from the top. Nodes that are never
peeled contain cycles; everything that hangs on them reaches no root either.

Lists are sent as slices: reverse peel order also gives every node its place in an order in which each subtree stands
together (a node, then its children's subtrees one after another), so that a list is a place and a length, whatever its
size, and lists and paths are spelt out only as rows leave, a batch at a time.

Maps are independent of each other. Maps of at most ``in_task_rows`` nodes are peeled inside tasks, many maps
in one task. In a larger map all nodes climb together, 2^k levels in round k: subtree sizes are sent to the ancestor
2^k above, roots and depths come back from it, so a chain of n nodes takes log2(n) rounds of joins over written tables, not n. Its
trees are then small enough for tasks, or have their paths put together by the same doubling. Both ways give the same rows.

Defined results
---------------
* a node with a null parent, or whose parent has no row, is a root (depth 0, path of itself alone).
* a node that is its own ancestor, or hangs on such nodes: ``in_cycle``; root, depth, path and n_descendants are null.
  ``end_id`` is the node where a walk upwards ends: the root, or the first node of the cycle that it meets; ``hops`` is the
  length of that walk, once round the cycle if there is one.
* null map_id or node_id: the row is no node and is left out.
* repeated rows of one node: the largest parent counts (pass rows that are already reduced where another should).
* empty table: empty result. Extra columns are not carried.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import forget, table, written

OUT = "map_id string, node_id string, parent_id string, root_id string, depth int, n_descendants bigint, in_cycle boolean, end_id string, hops int"
PATHS = "map_id string, node_id string, parent_id string, root_id string, depth int, n_descendants bigint, in_cycle boolean, path array<string>"
LISTS = "map_id string, ancestor_id string, descendant_id string, distance int"
IN_TASK_ROWS = 200_000
#: Elements of paths and lists in one batch that leaves a task.
OUT_ROWS = 20_000
#: Waves of fewer nodes are peeled one by one: deep and narrow trees have many of them.
NARROW = 24
KEY = ["map_id", "node_id"]


class Peeled:
    """Leaf peeling of a forest; parent is -1 at roots. Nodes of cycles, and what hangs on them, have depth -1 and no place."""

    def __init__(self, parent: np.ndarray):
        n = len(parent)
        self.parent = parent
        self.size = size = np.ones(n, dtype=np.int64)
        waves = self._peel()
        self.root, self.depth, self.place = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.end, self.hops, self._tail = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # where a node's subtree begins after its parent, or after the trees before its own
        by_parent = np.argsort(parent, kind="stable")
        before = np.cumsum(size[by_parent]) - size[by_parent]
        first = np.r_[True, np.diff(parent[by_parent]) != 0][:n]
        shift = np.empty(n, dtype=np.int64)
        shift[by_parent] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), n]))
        for wave in reversed(waves):
            if isinstance(wave, list):
                self._down_one_by_one(wave, shift)
            else:
                self._down(wave, shift)
        self._cycles()
        rooted = np.flatnonzero(self.depth >= 0)
        self.order = rooted[np.argsort(self.place[rooted])]  # rooted nodes, each subtree together
        at = np.full(n, -1)
        at[self.order] = np.arange(len(rooted))
        self.place = at

    def _peel(self) -> list:
        parent, size = self.parent, self.size
        has = parent >= 0
        self.open = np.bincount(parent[has], minlength=len(parent))
        waves: list = []
        wave = np.flatnonzero(self.open == 0)
        while len(wave):
            if len(wave) < NARROW:
                run, wave = self._peel_one_by_one(wave.tolist())
                waves.append(run)
                continue
            waves.append(wave)
            up = wave[parent[wave] >= 0]
            np.add.at(size, parent[up], size[up])
            np.subtract.at(self.open, parent[up], 1)
            above = np.unique(parent[up])
            wave = above[self.open[above] == 0]
        self.peeled = np.zeros(len(parent), dtype=bool)
        for wave in waves:
            self.peeled[wave] = True
        return waves

    def _peel_one_by_one(self, ready: list[int]) -> tuple[list[int], np.ndarray]:
        parent, size, open_ = self.parent, self.size, self.open
        run = []
        while ready and len(ready) < 4 * NARROW:
            v = ready.pop()
            run.append(v)
            p = int(parent[v])
            if p >= 0:
                size[p] += size[v]
                open_[p] -= 1
                if open_[p] == 0:
                    ready.append(p)
        return run, np.array(ready, dtype=np.int64)

    def _down(self, wave: np.ndarray, shift: np.ndarray) -> None:
        up = self.parent[wave]
        top = up < 0
        rooted = top | (self.depth[up] >= 0)
        self.end[wave] = np.where(top, wave, self.end[up])
        self.root[wave] = np.where(top, wave, np.where(rooted, self.root[up], -1))
        self.depth[wave] = np.where(top, 0, np.where(rooted, self.depth[up] + 1, -1))
        self.place[wave] = np.where(top, shift[wave], np.where(rooted, self.place[up] + 1 + shift[wave], -1))
        self._tail[wave] = np.where(top, 0, self._tail[up] + 1)

    def _down_one_by_one(self, run: list[int], shift: np.ndarray) -> None:
        parent, root, depth, place, end, tail = self.parent, self.root, self.depth, self.place, self.end, self._tail
        for v in reversed(run):
            p = int(parent[v])
            if p < 0:
                root[v], depth[v], place[v] = v, 0, shift[v]
                continue
            end[v], tail[v] = end[p], tail[p] + 1
            if depth[p] >= 0:
                root[v], depth[v], place[v] = root[p], depth[p] + 1, place[p] + 1 + shift[v]

    def _cycles(self) -> None:
        """Residual nodes are the cycles themselves: their lengths, and the walks of all that hang on them."""
        length = np.zeros(len(self.parent), dtype=np.int64)
        for v in np.flatnonzero(~self.peeled).tolist():
            if not length[v]:
                ring, at = [v], int(self.parent[v])
                while at != v:
                    ring.append(at)
                    at = int(self.parent[at])
                length[ring] = len(ring)
        self.hops = self._tail + length[self.end]


def _indexed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Parent row of each row (-1: none), and the node names."""
    n = len(rows)
    maps, _ = pd.factorize(rows["map_id"])
    names, _ = pd.factorize(pd.concat([rows["node_id"], rows["parent_id"]], ignore_index=True))
    width = int(names.max(initial=0)) + 1
    key, wanted = maps * width + names[:n], np.where(names[n:] < 0, -1, maps * width + names[n:])
    order = np.argsort(key, kind="stable")
    at = np.minimum(np.searchsorted(key[order], wanted), n - 1)
    parent = np.where((wanted >= 0) & (key[order][at] == wanted), order[at], -1)
    return parent, rows["node_id"].to_numpy(dtype=object)


def _peel_maps(batches: Iterator[pa.RecordBatch], want: str = "nodes", in_task_rows: int = IN_TASK_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (map_id, tree): whole trees are peeled together, about ``in_task_rows`` rows at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch.to_pandas())
        if sum(map(len, held)) >= in_task_rows:
            rows = pd.concat(held, ignore_index=True)
            last = (rows["map_id"] == rows["map_id"].iloc[-1]) & (rows["tree"] == rows["tree"].iloc[-1])
            cut = int(np.argmax(last.to_numpy()))
            if cut:
                yield from _results(rows.iloc[:cut].reset_index(drop=True), want)
                rows = rows.iloc[cut:]
            held = [rows]
    if held and sum(map(len, held)):
        yield from _results(pd.concat(held, ignore_index=True), want)


def _results(rows: pd.DataFrame, want: str) -> Iterator[pa.RecordBatch]:
    parent, names = _indexed(rows)
    forest = Peeled(parent)
    maps = rows["map_id"].to_numpy(dtype=object)
    text = lambda values, index: pa.array(np.where(index < 0, None, values[index]), pa.string())
    if want == "lists":
        yield from _lists(forest, maps, names)
        return
    step = OUT_ROWS if want == "nodes" else None
    order = np.arange(len(rows)) if want == "nodes" else np.r_[forest.order, np.flatnonzero(forest.depth < 0)]
    trail: list[str] = []  # the path of the node before, in an order in which subtrees stand together
    lo = 0
    while lo < len(order):
        if step:
            own = order[lo : lo + step]
        else:  # so many nodes that their paths have about OUT_ROWS elements
            total = np.cumsum(np.maximum(forest.depth[order[lo : lo + OUT_ROWS]], 0) + 1)
            own = order[lo : lo + max(1, int(np.searchsorted(total, OUT_ROWS)))]
        lo += len(own)
        lost = forest.depth[own] < 0
        columns = [
            pa.array(maps[own], pa.string()), pa.array(names[own], pa.string()), text(names, parent[own]), text(names, forest.root[own]),
            pa.array(forest.depth[own].astype(np.int32), mask=lost), pa.array(forest.size[own] - 1, mask=lost), pa.array(lost),
        ]
        if want == "nodes":
            columns += [pa.array(names[forest.end[own]], pa.string()), pa.array(forest.hops[own].astype(np.int32))]
        else:
            paths = []
            for v, depth in zip(own.tolist(), forest.depth[own].tolist()):
                if depth < 0:
                    paths.append(None)
                else:
                    del trail[depth:]
                    trail.append(names[v])
                    paths.append(trail.copy())
            columns.append(pa.array(paths, pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (OUT if want == "nodes" else PATHS).split(", ")])


def _lists(forest: Peeled, maps: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every node's list of descendants, from its slice."""
    order, size = forest.order, forest.size
    with_some = order[size[order] > 1]
    ends = np.cumsum(size[with_some] - 1)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, OUT_ROWS):
        row = np.arange(lo, min(total, lo + OUT_ROWS))
        who = np.searchsorted(ends, row, side="right")
        top = with_some[who]
        below = order[forest.place[top] + 1 + row - (ends[who] - (size[top] - 1))]
        distance = (forest.depth[below] - forest.depth[top]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(maps[top], pa.string()), pa.array(names[top], pa.string()), pa.array(names[below], pa.string()), pa.array(distance)], names=[c.split()[0] for c in LISTS.split(", ")])


def _climb(nodes: DataFrame) -> DataFrame:
    """OUT for maps that fit no task, in as many rounds as the depth (or the longest cycle) has binary digits; parents without a row are null.

    jump is the ancestor 2^k above, if there is one; size counts the nodes less than 2^k below; low is the smallest node met.
    """
    top = F.col("parent_id").isNull()
    start = nodes.select(
        *KEY, "parent_id", F.col("parent_id").alias("jump"), F.lit(1).cast("bigint").alias("size"), F.when(top, F.col("node_id")).alias("root_id"), F.when(top, 0).alias("depth"), F.col("node_id").alias("low"),
    )
    state, before, rounds = written(start, "climb"), -1, 0
    while True:
        left = state.where("jump is not null").count()
        # depths have no gaps, so a round without news leaves only those that reach no root; these go on
        # until each has gone round its whole cycle
        if left == 0 or (left == before and 2**rounds >= left):
            break
        ahead = state.select("map_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("root_id").alias("root_ahead"), F.col("depth").alias("depth_ahead"), F.col("low").alias("low_ahead"))
        moving = state.where("jump is not null").join(ahead, ["map_id", "jump"]).select(
            *KEY, "parent_id", F.col("next").alias("jump"), "size", F.col("root_ahead").alias("root_id"), (F.col("depth_ahead") + 2**rounds).cast("int").alias("depth"), F.least("low", "low_ahead").alias("low")
        )
        sent = state.where("jump is not null").groupBy("map_id", F.col("jump").alias("node_id")).agg(F.sum("size").alias("sent"))
        moved = moving.unionByName(state.where("jump is null")).join(sent, KEY, "left").withColumn("size", F.col("size") + F.coalesce("sent", F.lit(0))).drop("sent")
        moved = written(moved, "climb")
        forget(state)
        state, before, rounds = moved, left, rounds + 1
    out = [c.split()[0] for c in OUT.split(", ")]
    known = state.where("jump is null").select(*KEY, "parent_id", "root_id", "depth", (F.col("size") - 1).alias("n_descendants"), F.lit(False).alias("in_cycle"), F.col("root_id").alias("end_id"), F.col("depth").alias("hops")).select(*out)
    if not left:
        return known
    # the nodes of the cycles are those where the others have come to; cut there, the rest is a forest below them
    lost = state.where("jump is not null")
    ring = written(lost.select("map_id", F.col("jump").alias("node_id")).distinct().join(lost.select(*KEY, "low"), KEY), "rings")
    length = ring.groupBy("map_id", "low").agg(F.count("*").cast("int").alias("length"))
    ring = written(ring.join(length, ["map_id", "low"]).select(*KEY, "length"), "rings")
    cut = lost.select(*KEY, "parent_id").join(ring, KEY, "left")
    below = _climb(cut.select(*KEY, F.when(F.col("length").isNull(), F.col("parent_id")).alias("parent_id"))).select(*KEY, "end_id", F.col("depth").alias("tail"))
    hanging = lost.select(*KEY, "parent_id").join(below, KEY).join(ring.withColumnRenamed("node_id", "end_id"), ["map_id", "end_id"])
    null = lambda kind: F.lit(None).cast(kind)
    hanging = hanging.select(*KEY, "parent_id", null("string").alias("root_id"), null("int").alias("depth"), null("bigint").alias("n_descendants"), F.lit(True).alias("in_cycle"), "end_id", (F.col("tail") + F.col("length")).cast("int").alias("hops"))
    return known.unionByName(hanging.select(*out))


def _long_paths(nodes: DataFrame) -> DataFrame:
    """(map_id, node_id, path) of rooted nodes: each takes over the path of the ancestor it has reached so far, twice as far each time."""
    state = written(nodes.select(*KEY, F.col("parent_id").alias("jump"), F.array("node_id").alias("path")), "paths")
    while not state.where("jump is not null").isEmpty():
        above = state.select("map_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("head"))
        moved = state.where("jump is not null").join(above, ["map_id", "jump"]).select(*KEY, F.col("next").alias("jump"), F.concat("head", "path").alias("path"))
        grown = written(moved.unionByName(state.where("jump is null")), "paths")
        forget(state)
        state = grown
    return state.select(*KEY, "path")


def _divided(rows: DataFrame, in_task_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Nodes of maps that fit a task, those of larger maps with parents that exist (None: there are none), and the number of tasks."""
    spark = rows.sparkSession
    nodes = (
        rows.where("map_id is not null and node_id is not null")
        .groupBy(F.col("map_id").cast("string").alias("map_id"), F.col("node_id").cast("string").alias("node_id"))
        .agg(F.max(F.col("parent_id").cast("string")).alias("parent_id"))
    )
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy("map_id").count()
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / in_task_rows))
    if largest <= in_task_rows:
        return nodes, None, parts
    wide = sizes.where(F.col("count") > in_task_rows).select("map_id")
    small, large = nodes.join(wide, "map_id", "left_anti"), nodes.join(wide, "map_id", "left_semi")
    there = large.select("map_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    large = large.join(there, ["map_id", "parent_id"], "left").select(*KEY, F.when(F.col("there"), F.col("parent_id")).alias("parent_id"))
    return small, large, parts


def _in_tasks(nodes: DataFrame, parts: int, want: str, schema: str, in_task_rows: int) -> DataFrame:
    """nodes: (map_id, node_id, parent_id, tree); a tree, or a whole map, is in one task."""
    rows = nodes.repartition(parts, "map_id", "tree").sortWithinPartitions("map_id", "tree")
    return rows.mapInArrow(functools.partial(_peel_maps, want=want, in_task_rows=in_task_rows), schema)


def hierarchy(rows: DataFrame, in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """Root, depth, number of descendants, cycle mark, end and length of the walk upwards of each node of (map_id, node_id, parent_id)."""
    small, large, parts = _divided(rows, in_task_rows)
    out = _in_tasks(small.withColumn("tree", F.lit("")), parts, "nodes", OUT, in_task_rows)
    return out if large is None else out.unionByName(_climb(large))


def _trees(rows: DataFrame, in_task_rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """(map_id, node_id, parent_id, tree) of whatever fits a task; the rest of the larger maps, resolved: trees that don't, and cycles."""
    small, large, parts = _divided(rows, in_task_rows)
    small = small.withColumn("tree", F.lit(""))
    if large is None:
        return small, None, None, parts
    known = written(_climb(large), "resolved")
    tall = known.where(F.col("depth") == 0).where(F.col("n_descendants") >= in_task_rows).select("map_id", "root_id")
    fit = known.where("not in_cycle").join(tall, ["map_id", "root_id"], "left_anti").select(*KEY, "parent_id", F.col("root_id").alias("tree"))
    return small.unionByName(fit), known.where("not in_cycle").join(tall, ["map_id", "root_id"], "left_semi"), known.where("in_cycle"), parts


def paths(rows: DataFrame, in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """As ``hierarchy``, with the path from the root of every node (in place of end and hops). Paths are as long as trees are deep."""
    fit, tall, cyclic, parts = _trees(rows, in_task_rows)
    out = _in_tasks(fit, parts, "paths", PATHS, in_task_rows)
    if tall is None:
        return out
    names = [c.split()[0] for c in PATHS.split(", ")]
    return out.unionByName(tall.join(_long_paths(tall), KEY).select(*names)).unionByName(cyclic.withColumn("path", F.lit(None).cast("array<string>")).select(*names))


def descendants(rows: DataFrame, in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """One row for each node and each of its descendants, with the distance: lists as rows, so that no root's list has to fit a task."""
    fit, tall, _, parts = _trees(rows, in_task_rows)
    out = _in_tasks(fit, parts, "lists", LISTS, in_task_rows)
    if tall is None:
        return out
    at = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id")
    far = _long_paths(tall).where(F.size("path") > 1).select("map_id", F.col("node_id").alias("descendant_id"), F.size("path").alias("n"), at)
    return out.unionByName(far.select("map_id", "ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("at")).alias("distance")))


def pack_nodes(packs: DataFrame) -> DataFrame:
    """Nodes of map ``pack``: ids without surrounding blanks, in lower case; of repeated loads the last counts."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    rows = packs.select(clean("pack_id").alias("node_id"), F.nullif(clean("parent_pack_id"), F.lit("")).alias("parent_id"), "loaded_at").where("node_id != ''")
    last = rows.groupBy("node_id").agg(F.max(F.struct("loaded_at", "parent_id")).alias("last"))
    return last.select(F.lit("pack").alias("map_id"), "node_id", F.col("last.parent_id").alias("parent_id"))


def alias_nodes(aliases: DataFrame) -> DataFrame:
    """Nodes of alias maps (map_id, pos, old_code, new_code): of the rows of one old code that with the highest pos counts."""
    told = aliases.where("old_code is not null and new_code is not null").groupBy("map_id", "old_code").agg(F.max(F.struct("pos", "new_code")).alias("last"))
    told = told.select("map_id", F.col("old_code").cast("string").alias("node_id"), F.col("last.new_code").cast("string").alias("parent_id"))
    return told.unionByName(told.select("map_id", F.col("parent_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id")))


def all_nodes(spark, sf_dir: str) -> DataFrame:
    """The nodes of every map: packs, the alias map of each pack, and the stream's."""
    packs = pack_nodes(table(spark, sf_dir, "symbol_packs"))
    own = alias_nodes(table(spark, sf_dir, "pack_aliases").withColumn("map_id", F.col("pack_id")))
    stream = alias_nodes(table(spark, sf_dir, "stream_aliases").withColumn("map_id", F.lit("stream")))
    return packs.unionByName(own).unionByName(stream)

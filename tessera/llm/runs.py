"""Runs of identical or near-identical consecutive events, each collapsed into one event.

Method. Optimal segmentation by pruned dynamic programming: the events of an entity, in order, are divided into
segments so that the sum of every event's dissimilarity to its segment's code, plus ``penalty`` for each
boundary, is least. Candidates for the last boundary that can't win any more are pruned.

``near`` has the pairs of codes that are near-identical, with their dissimilarity (0: equivalent); any other two different codes
have dissimilarity 1. A run is led by the code that fits it best, of those that occur and those near to them (ties: the smallest).
Where all dissimilarities are 0 or 1 the segments are exactly the longest runs of equal or equivalent codes.

What makes it scale. (1) Neighbours of one code are one weighted event; an optimal boundary never lies
inside it. (2) An event more than two penalties from its segment's code would gain by standing alone, so
between neighbours that no code is within two penalties of both a boundary is certain, and sequences fall
apart into stretches that are segmented independently. All stretches of a batch take the steps of the programme together, in numpy. (3) Events are grouped by
entity and position block, so an entity with a third of all rows is many groups; only the outermost stretches of a block are
open, as weighted events, and are joined in blocks of blocks, level by level (``FAN`` blocks to one), so no task sees an entity whole. What
one task must hold is one stretch.

Defined results
---------------
* events without a code are left out before; lost positions don't end a run.
* several rows of one entity and position: the one that arrived last counts (ties: the larger code, then the later time).
* null entity or position: the row belongs to no sequence and is left out.
* null times: duration is taken from the first and last event that have one, null if none has.
* empty table: empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

PENALTY = 0.2
FAR = 1.0
BLOCK = 4096
FAN = 1024
#: ``near`` is sent to all tasks: more pairs than this are refused.
MAX_NEAR = 100_000
TIE = 1e-9

#: A row is a weighted event; ``edge`` says which open stretch of its block it is in (1 the first, 2 the last, 0 none: a finished segment).
_ROW = "entity string, block bigint, edge tinyint, code int, n_events bigint, first_pos bigint, last_pos bigint, first_at timestamp_ntz, last_at timestamp_ntz"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


class Near:
    """Dissimilarities of codes in arrays: sorted pairs of codes, both ways."""

    def __init__(self, near: dict[tuple[int, int], float], penalty: float):
        if len(near) > MAX_NEAR:
            raise ValueError(f"more than {MAX_NEAR} near pairs")
        if any(not 0 <= d <= FAR for d in near.values()) or not 2 * penalty < FAR:
            raise ValueError("near dissimilarities must lie in [0, 1], and two penalties below 1")
        both = {(min(a, b), max(a, b)): d for (a, b), d in near.items() if a != b}
        both |= {(b, a): d for (a, b), d in both.items()}
        self.around: dict[int, list[int]] = {}
        for a, b in sorted(both):
            self.around.setdefault(a, []).append(b)
        pairs = sorted(both)
        self.keys = np.array([self.key(a, b) for a, b in pairs], dtype=np.int64)
        self.values = np.array([both[p] for p in pairs])
        # pairs of different codes that some code is within two penalties of
        close = {a: {a, *(b for b in bs if both[a, b] <= 2 * penalty)} for a, bs in self.around.items()}
        self.together = np.unique(np.array([self.key(x, y) for group in close.values() for x in group for y in group if x != y], dtype=np.int64))

    @staticmethod
    def key(a, b):
        return (a << 32) + (b & 0xFFFFFFFF)

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dissimilarity of codes, pairwise."""
        key = self.key(a.astype(np.int64), b.astype(np.int64))
        out = np.where(a == b, 0.0, FAR)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (a != b)
            out[known] = self.values[at[known]]
        return out

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the boundary between neighbouring codes is left to the dynamic programme."""
        key = self.key(a.astype(np.int64), b.astype(np.int64))
        return np.isin(key, self.together) if len(self.together) else np.zeros(len(key), dtype=bool)


def segment(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, penalty: float, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """First event and code of every segment of least cost, for the sequences that begin at ``starts``, all at once.

    Ties go to fewer segments, then to the earlier boundary, then to the smallest code.
    """
    length = np.diff(np.r_[starts, len(codes)])
    alone = length == 1
    if alone.all():
        return starts, codes[starts]
    many = np.flatnonzero(~alone)
    many = many[np.argsort(-length[many], kind="stable")]  # the active sequences are always the first ones
    begin, size = starts[many], length[many]
    # the codes that may lead a segment of each sequence, in order, padded with the last
    kinds = []
    for lo, n in zip(begin.tolist(), size.tolist()):
        own = set(codes[lo : lo + n].tolist())
        kinds.append(sorted(own.union(*(near.around.get(c, ()) for c in own))))
    width = max(map(len, kinds))
    lead = np.array([k + [k[-1]] * (width - len(k)) for k in kinds], dtype=np.int64)
    place = np.cumsum(size) - size + np.arange(len(size))  # of each sequence in the flat tables of n + 1 ends
    best, back, kind = np.zeros(size.sum() + len(size)), np.zeros(size.sum() + len(size), dtype=np.int64), np.zeros(size.sum() + len(size), dtype=np.int64)
    best[place] = -penalty
    seq, first, cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
    for end in range(1, int(size[0]) + 1):
        active = int(np.searchsorted(-size, -end, side="right"))
        keep = seq < active
        # the candidates of a sequence in the order of their begin: fewer segments, or else the earlier boundary, come first
        order = np.argsort(np.r_[seq[keep], np.arange(active)], kind="stable")
        seq, first = np.r_[seq[keep], np.arange(active)][order], np.r_[first[keep], np.full(active, end - 1)][order]
        cost = np.concatenate([cost[keep], np.zeros((active, width))])[order]
        event = begin[seq] + end - 1
        cost += weights[event, None] * near.far(np.broadcast_to(codes[event, None], cost.shape), lead[seq])
        within = cost.min(axis=1)
        total = best[place[seq] + first] + penalty + within
        group = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        least = np.minimum.reduceat(total, group)
        good = np.where(total <= np.repeat(least, np.diff(np.r_[group, len(seq)])) + TIE, np.arange(len(seq)), len(seq))
        win = np.minimum.reduceat(good, group)
        at = place[:active] + end
        best[at], back[at] = total[win], first[win]
        kind[at] = lead[np.arange(active), (cost[win] <= within[win, None] + TIE).argmax(axis=1)]
        # a begin whose open segment already costs a penalty more than the best end here can't win later
        live = best[place[seq] + first] + within <= best[at][seq] + TIE
        seq, first, cost = seq[live], first[live], cost[live]
    heads, leads = [starts[alone]], [codes[starts[alone]]]
    end = size.copy()
    left = np.arange(len(size))
    while len(left):
        at = place[left] + end[left]
        end[left] = back[at]
        heads.append(begin[left] + back[at])
        leads.append(kind[at])
        left = left[end[left] > 0]
    heads, leads = np.concatenate(heads), np.concatenate(leads)
    order = np.argsort(heads)
    return heads[order], leads[order]


def _joined(starts: np.ndarray, weight, first_pos, last_pos, first_at, last_at):
    """Weighted events from those between ``starts``; NaT stands for no time."""
    n, ends = len(weight), np.r_[starts[1:], len(weight)] - 1
    if not n:
        return weight, first_pos, last_pos, first_at, last_at
    seen = np.minimum.reduceat(np.where(np.isnat(first_at), n, np.arange(n)), starts)
    late = np.maximum.reduceat(np.where(np.isnat(last_at), -1, np.arange(n)), starts)
    none = np.datetime64("NaT", "us")
    return np.add.reduceat(weight, starts), first_pos[starts], last_pos[ends], np.r_[first_at, none][seen], np.r_[last_at, none][late]


def _segments(penalty: float, near: Near, raw: bool, last: bool):
    """Kernel over rows sorted by (entity, block of blocks, position): whole groups at a time. last: nothing stays open."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        entity = pc.dictionary_encode(rows.column("entity").combine_chunks())
        if isinstance(entity, pa.ChunkedArray):
            entity = entity.combine_chunks()
        who = entity.indices.to_numpy(zero_copy_only=False)
        get = lambda name: rows.column(name).to_numpy()
        group, pos = get("group"), get("first_pos")
        if raw:  # of the rows of one position the last counts; then those without a code are out
            keep = np.r_[(who[1:] != who[:-1]) | (pos[1:] != pos[:-1]), True] & ~np.isnan(rows.column("code").cast(pa.float64()).to_numpy())
            at = np.flatnonzero(keep)
            rows, who, group = rows.take(pa.array(at)), who[at], group[at]
        code = get("code").astype(np.int64)
        time = lambda name: rows.column(name).to_numpy().astype("datetime64[us]")
        changed = np.r_[True, (who[1:] != who[:-1]) | (group[1:] != group[:-1])][: len(code)]
        part = get("edge")
        wall = np.r_[False, (part[1:] == 2) & (part[:-1] == 1)][: len(code)]  # what lay between the two open stretches of a block is finished
        starts = np.flatnonzero(changed | wall | np.r_[True, code[1:] != code[:-1]][: len(code)])
        values = _joined(starts, get("n_events"), get("first_pos"), get("last_pos"), time("first_at"), time("last_at"))
        code, changed, wall, block, who = code[starts], changed[starts], wall[starts], group[starts], who[starts]
        cut = changed | wall | np.r_[True, ~near.open(code[:-1], code[1:])][: len(code)]
        stretch = np.cumsum(cut) - 1
        edge = np.zeros(len(code), dtype=np.int8)
        if not last and len(code):
            own = np.cumsum(changed) - 1
            first = stretch[changed]  # of each group
            final = np.r_[first[1:], stretch[-1] + 1] - 1
            edge[stretch == final[own]] = 2
            edge[stretch == first[own]] = 1
        done = np.flatnonzero(edge == 0)
        wait = np.flatnonzero(edge)
        pick = lambda at: tuple(v[at] for v in values)
        heads, leads = segment(code[done], values[0][done], np.flatnonzero(cut[done]), penalty, near) if len(done) else (done, code[:0])
        closed = _joined(heads, *pick(done))
        out = [np.concatenate(x) for x in zip(closed, pick(wait))]
        of = np.r_[done[heads], wait]
        columns = [entity.dictionary.take(pa.array(who[of])), pa.array(block[of]), pa.array(np.r_[np.zeros(len(heads), np.int8), edge[wait]]), pa.array(np.r_[leads, code[wait]].astype(np.int32)), *map(pa.array, out)]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and _same(held[0], 0, batch, batch.num_rows - 1):
                if raw and len(held) > 4:  # one position may be delivered any number of times
                    held = _last_deliveries(held)
                continue  # all of one group so far
            rows = pa.Table.from_batches(held).combine_chunks()
            lo = rows.num_rows - batch.num_rows
            tail = batch.num_rows - 1
            while tail and _same(batch, tail - 1, batch, batch.num_rows - 1):
                tail -= 1
            if lo + tail:
                yield whole(rows.slice(0, lo + tail))
            held = [batch.slice(tail)]
        if held:
            yield whole(pa.Table.from_batches(held).combine_chunks())

    return run


def _last_deliveries(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Of rows of one group, the last of each position."""
    rows = pa.Table.from_batches(held).combine_chunks()
    pos = rows.column("first_pos").to_numpy()
    return rows.take(pa.array(np.flatnonzero(np.r_[pos[1:] != pos[:-1], True]))).combine_chunks().to_batches()


def _same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in (1, 0))


def collapse(events: DataFrame, near: dict[tuple[int, int], float] | None = None, penalty: float = PENALTY, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(entity, code, n_events, first_pos, last_pos, first_at, last_at) of every segment.

    events: entity string, pos bigint, code int, at timestamp_ntz, arrived timestamp_ntz. ``near`` is a small
    dictionary given by the caller, with dissimilarities from 0 to 1.
    """
    pairs = Near(near or {}, penalty)
    columns = ("code", "n_events", "first_pos", "last_pos", "first_at", "last_at")
    rows = events.where("entity is not null and pos is not null").select("entity", F.floor(F.col("pos") / block).alias("group"), "pos", "code", "at", "arrived")
    rows = rows.repartition("entity", "group").sortWithinPartitions("entity", "group", "pos", F.asc_nulls_first("arrived"), F.asc_nulls_first("code"), F.asc_nulls_first("at"))
    pos, at = F.col("pos"), F.col("at")
    rows = rows.select("entity", "group", "code", F.lit(0).cast("tinyint").alias("edge"), F.lit(1).cast("bigint").alias("n_events"), pos.alias("first_pos"), pos.alias("last_pos"), at.alias("first_at"), at.alias("last_at"))
    found = written(rows.mapInArrow(_segments(penalty, pairs, True, False), _ROW), "segments")
    done = found.where("edge = 0").select("entity", *columns)
    while True:  # as many levels as the number of blocks has digits in base ``fan``
        edges = found.where("edge > 0")
        low, high = edges.agg(F.min("block"), F.max("block")).first()
        if low is None:
            return done
        last = high - low < fan
        rows = edges.select("entity", F.floor((F.col("block") - low) / fan).alias("group"), "edge", *columns)
        rows = rows.repartition("entity", "group").sortWithinPartitions("entity", "group", "first_pos")
        found = rows.mapInArrow(_segments(penalty, pairs, False, last), _ROW)
        if last:
            return done.unionByName(found.select("entity", *columns))
        found = written(found, "segments")
        done = done.unionByName(found.where("edge = 0").select("entity", *columns))

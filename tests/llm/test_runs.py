import random
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
import pytest

from tessera.llm import runs

SCHEMA = "entity string, pos bigint, code int, at timestamp_ntz, arrived timestamp_ntz"
T0 = datetime(2022, 1, 1)


def sec(x):
    return None if x is None else T0 + timedelta(seconds=x)


def best_cost(codes, penalty, near):
    far = lambda a, b: 0.0 if a == b else near.get((a, b), near.get((b, a), 1.0))
    n, kinds = len(codes), sorted({*codes, *(b for p in near for a, b in (p, p[::-1]) if a in codes)})
    best = [-penalty] + [0.0] * n
    for end in range(1, n + 1):
        best[end] = min(best[b] + penalty + min(sum(far(c, k) for c in codes[b:end]) for k in kinds) for b in range(end))
    return best[n]


def cost(parts, codes, penalty, near):
    far = lambda a, b: 0.0 if a == b else near.get((a, b), near.get((b, a), 1.0))
    return sum(far(c, k) for b, e, k in parts for c in codes[b:e]) + penalty * (len(parts) - 1)


def parts_of(heads, leads, n):
    return list(zip(heads.tolist(), [*heads.tolist()[1:], n], leads.tolist()))


def test_segment_is_optimal():
    rng = random.Random(4)
    pairs = {(1, 2): 0.1, (2, 3): 0.3, (1, 3): 0.7, (4, 5): 0.0, (5, 6): 0.0}
    near = runs.Near(pairs, 0.2)
    seqs = [[rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    starts = np.cumsum([0, *map(len, seqs)])[:-1]
    codes = np.array([c for s in seqs for c in s])
    heads, leads = runs.segment(codes, np.ones(len(codes), np.int64), starts, 0.2, near)
    assert set(starts.tolist()) <= set(heads.tolist()) and (np.diff(heads) > 0).all()
    for lo, seq in zip(starts.tolist(), seqs):
        own = (heads >= lo) & (heads < lo + len(seq))
        parts = parts_of(heads[own] - lo, leads[own], len(seq))
        assert cost(parts, seq, 0.2, pairs) == pytest.approx(best_cost(seq, 0.2, pairs))
    heads, leads = runs.segment(np.array([5, 6, 5]), np.array([3, 1, 2]), np.array([0]), 0.2, runs.Near({}, 0.2))
    assert parts_of(heads, leads, 3) == [(0, 1, 5), (1, 2, 6), (2, 3, 5)]
    heads, leads = runs.segment(np.array([9, 7, 8, 1]), np.ones(4, np.int64), np.array([0]), 0.2, runs.Near({(9, 7): 0.0, (8, 7): 0.0, (8, 9): 0.0}, 0.2))
    assert parts_of(heads, leads, 4) == [(0, 3, 7), (3, 4, 1)]


@pytest.mark.parametrize(("block", "fan"), [(4096, 1024), (5, 1024), (2, 2)])
def test_exact_runs(spark, block, fan):
    rng = random.Random(5)
    rows = []
    for e in "ab":
        for pos in range(60):
            if rng.random() < 0.2:
                continue
            for k in range(rng.choice([1, 1, 2])):
                rows.append((e, pos, rng.choice([None, 1, 1, 1, 2]), sec(rng.choice([None, pos])), sec(1000 + k)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in runs.collapse(df, block=block, fan=fan).collect())
    want = []
    for e in "ab":
        last = {}
        for r in rows:
            if r[0] == e and (r[1] not in last or r[4] > last[r[1]][4]):
                last[r[1]] = r
        events = [last[p] for p in sorted(last) if last[p][2] is not None]
        for code, part in groupby(events, key=lambda r: r[2]):
            part = list(part)
            times = [r[3] for r in part if r[3] is not None] or [None]
            want.append((e, code, len(part), part[0][1], part[-1][1], times[0], times[-1]))
    assert got == sorted(want)


@pytest.mark.parametrize(("block", "fan"), [(4096, 1024), (7, 1024), (3, 2)])
def test_near_codes(spark, block, fan):
    rng = random.Random(6)
    near = {(1, 2): 0.1, (2, 3): 0.15, (1, 9): 0.6}
    codes = [rng.choice([1, 1, 2, 3, 9]) for _ in range(80)]
    df = spark.createDataFrame([("e", i, c, sec(i), sec(i)) for i, c in enumerate(codes)], SCHEMA)
    got = sorted((r["first_pos"], r["last_pos"] + 1, r["code"]) for r in runs.collapse(df, near, block=block, fan=fan).collect())
    assert [b for b, _, _ in got] == [0] + [e for _, e, _ in got[:-1]] and got[-1][1] == 80
    assert cost(got, codes, runs.PENALTY, near) == pytest.approx(best_cost(codes, runs.PENALTY, near))
    with pytest.raises(ValueError):
        runs.collapse(df, {(1, 2): 1.9})


def test_edges(spark):
    assert runs.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, 1, None, None), ("a", None, 1, None, None), ("a", 1, None, None, None), ("a", 2, 4, None, None), ("a", 2, 4, None, None)]
    assert [tuple(r) for r in runs.collapse(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", 4, 1, 2, 2, None, None)]


def test_rows_come_from_the_programme(spark):
    """Equivalent codes are joined by the dynamic programme; a long alternating stretch is one segment across blocks."""
    near = {(1, 2): 0.0, (2, 3): 0.0, (1, 3): 0.0}
    codes = [1, 2, 3, 2, 2, 1] * 30 + [7] + [2, 3] * 5
    rows = [("e", i, c, sec(i), sec(i)) for i, c in enumerate(codes)] + [("f", -3, 3, None, None), ("f", 900_000, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [("e", 1, 180, 0, 179, sec(0), sec(179)), ("e", 1, 10, 181, 190, sec(181), sec(190)), ("e", 7, 1, 180, 180, sec(180), sec(180)), ("f", 1, 2, -3, 900_000, None, None)]
    assert sorted(tuple(r) for r in runs.collapse(df, near, block=16, fan=4).collect()) == sorted(want)


def test_large_batches_are_cut_between_groups(spark):
    df = spark.range(60_000).selectExpr("'s' || (id % 2) as entity", "id div 2 as pos", "cast(id div 14 % 3 as int) as code", "cast(null as timestamp_ntz) as at", "timestamp_ntz'2022-01-01' as arrived")
    got = runs.collapse(df).groupBy("entity").agg({"n_events": "sum", "*": "count"}).collect()
    assert sorted(tuple(r) for r in got) == [("s0", 30_000, 4286), ("s1", 30_000, 4286)]


def test_one_position_delivered_very_often(spark):
    df = spark.range(120_000).selectExpr("'s' as entity", "case when id % 1000 = 0 then id div 1000 else 7 end as pos", "cast(id % 3 as int) as code", "cast(null as timestamp_ntz) as at", "timestamp_ntz'2022-01-01' + make_dt_interval(0, 0, 0, id) as arrived")
    got = sorted((r["first_pos"], r["last_pos"], r["code"], r["n_events"]) for r in runs.collapse(df).collect())
    want = [(p, p, 119_999 % 3 if p == 7 else p * 1000 % 3, 1) for p in range(120)]
    merged = [want[0]]
    for row in want[1:]:
        if row[2] == merged[-1][2]:
            merged[-1] = (merged[-1][0], row[1], row[2], merged[-1][3] + 1)
        else:
            merged.append(row)
    assert got == merged

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import packing


def check(rows, items, capacity):
    """Every item whole and in order of its pieces, no container overfull, no two pieces on one place."""
    whole = {}
    boxes = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
        if r["container_id"] is None:
            assert r["n_tokens"] == 0
            continue
        boxes.setdefault(r["container_id"], []).append((r["offset"], r["n_tokens"], r["step_group"]))
    assert {k: sum(n for _, n in v) for k, v in whole.items()} == items
    assert all(len(v) == 1 or all(n == capacity for _, n in sorted(v)[:-1]) for v in whole.values())
    for parts in boxes.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and len({g for _, _, g in parts}) == 1
    return boxes


def test_small(spark):
    items = {1: 0, 2: 5, 3: 10, 4: 21, 5: 3, 6: 7, 7: 9, 8: 1, 9: 10}
    df = spark.createDataFrame(list(items.items()), "doc_id bigint, n_tokens bigint").withColumn("piece", F.lit("clash"))
    boxes = check(packing.pack(df, capacity=10, tiers=(2, 5, 10), group=2).collect(), items, 10)
    assert len(boxes) == 7  # 66 tokens


def test_random(spark):
    rng = random.Random(2)
    items = {i: rng.choice([rng.randint(1, 600), rng.randint(1, 2500), 300]) for i in range(3000)}
    rows = packing.pack(spark.createDataFrame(list(items.items()), "doc_id bigint, n_tokens bigint")).collect()
    boxes = check(rows, items, 2048)
    least = -(-sum(items.values()) // 2048)
    assert least <= len(boxes) <= 1.01 * least + 1
    loads = {}
    for parts in boxes.values():
        loads[parts[0][2]] = loads.get(parts[0][2], 0) + sum(n for _, n, _ in parts)
    assert max(loads.values()) <= 1.02 * np.mean(list(loads.values())) + 2048
    assert all(r["tier"] >= r["n_tokens"] for r in rows)


def test_edges(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, None), (1, -4), (2, 4096), (3, 30), (3, 30)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["n_tokens"], r["container_id"] is None) for r in rows) == [(0, 0, 0, True), (1, 0, 0, True), (2, 0, 2048, False), (2, 1, 2048, False), (3, 0, 30, False), (3, 0, 30, False)]
    assert len({(r["container_id"], r["offset"]) for r in rows if r["container_id"] is not None}) == 4


def test_plan_is_complete():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, size=129)
    counts[0] = 0
    left, used = counts.copy(), np.zeros(129, dtype=np.int64)
    for times, pieces in packing.windows(counts, (16, 32, 64, 128)):
        tier = next(t for t in (16, 32, 64, 128) if t >= pieces[0])
        assert sum(pieces) <= tier and all(x <= tier // 2 for x in pieces[1:]) and sum(pieces) in (pieces[0], tier)
        used[sum(pieces)] += times
        for x in pieces:
            left[x] -= times
    assert (left == 0).all()
    for times, lengths in packing.containers(used):
        assert sum(lengths) <= 128
        for x in lengths:
            used[x] -= times
    assert (used == 0).all()


def test_tiers_change_the_plan():
    counts = np.zeros(101, dtype=np.int64)
    counts[[30, 25, 20, 45, 80]] = 4, 2, 2, 2, 2
    assert packing.windows(counts, (100,)) == [(2, [80]), (2, [45]), (4, [30]), (2, [25]), (2, [20])]  # one tier: all stay loose
    assert packing.windows(counts, (50, 100)) == [(2, [80, 20]), (2, [45]), (4, [30]), (2, [25])]
    counts[5] = 1
    assert packing.windows(counts, (30, 50, 100))[1:3] == [(1, [45, 5]), (1, [45])]

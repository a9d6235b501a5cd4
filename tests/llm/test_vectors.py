import glob
import os
import time

import numpy as np
import pytest

from tessera.llm import clusters, knn, vectors
from tessera.session import written

SCHEMA = "kind int, id bigint, key string, v array<double>"


def sample(n, groups, seed=0, noise=0.035):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    near = c[rng.integers(0, groups, n // 2)] + rng.normal(size=(n // 2, 64)) * noise
    x = np.concatenate([near, rng.normal(size=(n - n // 2, 64))])
    x[5] = x[4] * 3.0
    x[7] = x[6] + rng.normal(size=64) * 1e-3
    return x


def rows_of(x, kind=0):
    return [(kind, i + 10, f"k{i}", v.tolist()) for i, v in enumerate(x)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bad_rows():
    v = [0.1] * 64
    return [(0, 900, "z", None), (0, 901, "z", []), (0, 902, "z", v[:63]), (0, 903, "z", v[:63] + [None]), (0, 904, "z", v[:63] + [float("nan")]), (0, 905, "z", v[:63] + [float("inf")]), (0, 906, "z", [0.0] * 64)]


def test_unit_rows(spark):
    import pyarrow as pa

    column = pa.array([r[3] for r in bad_rows()] + [[3.0] + [0.0] * 63, [1e-200] * 64, [1e200] * 64], pa.list_(pa.float64()))
    at, rows = vectors.unit_rows(column)
    assert at.tolist() == [7, 8, 9] and np.allclose(np.linalg.norm(rows, axis=1), 1)
    assert vectors.unit_rows(column.slice(7, 2))[0].tolist() == [0, 1] and len(vectors.unit_rows(column.slice(0, 0))[0]) == 0


def test_repeated_rows_are_one_record(spark):
    v = sample(8, 1).tolist()
    rows = [(0, 5, "a", v[0]), (0, 3, "a", v[1]), (0, 9, None, v[2]), (0, 8, None, v[3]), (1, 3, "3", v[0]), (1, 3, "3", v[0]), (1, 4, "4", v[1])]
    found, copies = vectors.records(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["kind"], r["id"]) for r in found.collect()) == [(0, 3), (0, 8), (0, 9), (1, 3), (1, 4)] and copies.count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_close_pairs_and_neighbours(spark, split, monkeypatch):
    if split:  # buckets far above the mean: all pairs of blocks
        monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    x = sample(400, 6)
    rows = rows_of(x) + bad_rows() + [(0, 2000, "k3", x[3].tolist())] + rows_of(x[:3], 1)
    df = spark.createDataFrame(rows, SCHEMA)
    u = unit(x)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    want = {(0, min(i, j) + 10, max(i, j) + 10) for i in range(400) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.99}
    got = {tuple(r) for r in knn.close_pairs(df).collect() if r["kind"] == 0}
    assert got == want and len(want) >= 2
    lists = {}
    for r in knn.neighbours(df).where("kind = 0").collect():
        lists.setdefault(r["id"], {})[r["other"]] = r["cos"]
    found = sum(len({j + 10 for j in np.argsort(-c[i])[:5]} & set(lists[i + 10])) for i in range(400))
    assert found / 2000 >= 0.9
    assert all(len(v) == 5 for v in lists.values()) and not any(i >= 900 for i in lists)
    assert all(abs(s - c[i - 10, j - 10]) < 1e-4 for i, v in lists.items() for j, s in v.items())


@pytest.mark.parametrize("rows", [20_000, 200_000, 2_000_000, 173_000_000])
def test_meeting_chance_stays_level(rows):
    rng = np.random.default_rng(11)
    near, close = knn.Layout(1, rows), knn.Layout(1, rows, far=0.99, level=knn.SURE, bucket_rows=knn.CLOSE_ROWS)
    for layout, cos, share in ((near, near.far, 0.7), (near, 0.7, 0.9), (near, 0.85, 0.98), (close, 0.99, 0.999)):
        a, b = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
        b = cos * a + np.sqrt(1 - cos**2) * unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        x, y = np.sort(layout.buckets(a)), np.sort(layout.buckets(b))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]) >= share, (cos, layout.tables, layout.fine)


def test_copies_in_neighbour_lists(spark):
    x = np.concatenate([sample(60, 4), np.tile(sample(60, 4)[3], (9, 1)), sample(60, 4)[8:9]])  # ten of row 3, two of row 8
    lists = {}
    for r in knn.neighbours(spark.createDataFrame(rows_of(x), SCHEMA)).collect():
        lists.setdefault(r["id"], []).append((r["rank"], r["other"], r["cos"]))
    u = unit(x)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    for i, got in lists.items():
        assert [r for r, _, _ in sorted(got)] == [1, 2, 3, 4, 5] and i not in {j for _, j, _ in got}
        near = np.sort(c[i - 10])[-5:]
        assert np.allclose(sorted(s for _, _, s in got if s > 0.6), near[near > 0.6], atol=1e-4)
        assert np.allclose([s for _, j, s in got], [c[i - 10, j - 10] for _, j, _ in got], atol=1e-4)
    assert len(lists) == len(x) and [j for _, j, _ in sorted(lists[72])] == [13, 70, 71, 73, 74]


def test_top_pairs_any_size():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 100, 700):
        x = unit(rng.normal(size=(n, 64))).astype(np.float32) if n else np.zeros((0, 64), np.float32)
        side = rng.integers(0, 2, n).astype(np.int8)
        for s in (None, side):
            _, v = knn.top_pairs(x, 5, s, block=128)
            _, over = knn.top_pairs(x, 5, s, 0.2, block=128)
            c = x @ x.T
            np.fill_diagonal(c, -2)
            if s is not None:
                c[s[:, None] == s[None]] = -2
            want = -np.sort(-np.c_[c, np.full((n, 5), -2.0)], axis=1)[:, :5]
            assert np.allclose(v, want, atol=1e-5)
            assert np.allclose(np.where(over > 0.2, over, -2), np.where(want > 0.2, want, -2), atol=1e-5)


def brute_clusters(x, least=0.85):
    u = unit(x)
    linked = u @ u.T >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(x))
    return {(i + 10, label[i] + 10) for i in range(len(x)) if size[label[i]] >= 3}


@pytest.mark.parametrize(("cell_rows", "block_rows", "fan", "reach"), [(4096, 40_000, 512, clusters.REACH), (60, 40_000, 512, 1), (400, 30, 512, 1), (100, 60, 512, 1), (20, 40_000, 3, 1), (20, 40_000, 4, clusters.REACH)])
def test_clusters(spark, cell_rows, block_rows, fan, reach, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(clusters, "FAN", fan)  # 3 and 4: trees of centroids
    x = np.concatenate([sample(400, 8, seed=2), sample(10, 1, noise=0.001)[:5]])
    chain = np.zeros((5, 64))
    for i in range(5):  # a chain: only neighbours are linked
        chain[i, 0], chain[i, 1] = np.cos(0.5 * i), np.sin(0.5 * i)
    x = np.concatenate([x, chain])
    df = spark.createDataFrame(rows_of(x) + bad_rows() + rows_of(x[:40], 1), SCHEMA)
    got = {(r["id"], r["lead"]) for r in clusters.clusters(df, cell_rows=cell_rows, reach=reach).where("kind = 0").collect()}
    assert got == brute_clusters(x)


@pytest.mark.parametrize(("noise", "copies"), [(0.0, 1), (0.01, 1), (0.01, 3)])
def test_clusters_core_only_above_block_rows(spark, noise, copies, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(4)
    x = np.tile(rng.normal(size=64), (100, 1)) + rng.normal(size=(100, 64)) * noise  # copies or one tight group, nothing around it
    x = np.concatenate([np.tile(x, (copies, 1)), rng.normal(size=(5, 64))])
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    got = {(r["id"], r["lead"]) for r in clusters.clusters(df).collect()}
    assert got == brute_clusters(x) == {(i + 10, 10) for i in range(100 * copies)}


def test_records_sets_copies_apart(spark):
    x = np.concatenate([sample(20, 2), sample(20, 2)[:8], sample(20, 2)[:3] * 2])
    rows, copies = vectors.records(spark.createDataFrame(rows_of(x) + bad_rows(), SCHEMA))
    assert {r["id"] for r in rows.collect()} == {i + 10 for i in range(20) if i not in (5,)}  # 5 is 4, three times as long
    assert {(r["id"], r["rep"]) for r in copies.collect()} == {(15, 14), *((30 + i, 14 if i == 5 else 10 + i) for i in range(8)), *((38 + i, 10 + i) for i in range(3))}
    alike = {r["rep"]: (r["n"], r["smallest"]) for r in vectors.smallest_copies(copies, 2).collect()}
    assert alike[10] == (2, [30, 38]) and alike[14] == (3, [15, 34])


@pytest.mark.parametrize(("block_rows", "reach"), [(40_000, 1), (4, 1), (40_000, clusters.REACH)])
def test_links_between_visitors_of_a_third_cell(spark, block_rows, reach, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block_rows)
    cells = clusters.Cells(5, 4096)
    cells.divide({-1: np.eye(64, dtype=np.float32)[:3]}, {-1: np.ones(3)})
    v = np.zeros((6, 64))
    v[0, :3], v[1, :3] = (0.4, 0.2, 0.3), (0.2, 0.4, 0.3)  # linked, gaps of 0.2; both close to the third centroid
    v[:2, 3] = np.sqrt(1 - (v[:2, :3] ** 2).sum(axis=1))
    v[2:5, :3] = np.eye(3)
    v[5, 40] = 1.0
    assert v[0] @ v[1] >= 0.9
    rows, _ = vectors.records(spark.createDataFrame(rows_of(v), SCHEMA))
    got = {(r["id"], r["lead"]) for r in clusters.joined(clusters.links(rows, {0: cells}, reach=reach)).collect()}
    assert got == {(10, 10), (11, 10)}


@pytest.mark.parametrize(("k", "fan"), [(1, 512), (50, 512), (600, 512), (600, 30)])
def test_few_links_are_lost_at_any_number_of_cells(k, fan):
    rng = np.random.default_rng(12)
    centers = unit(rng.normal(size=(k, 64))).astype(np.float32)
    cells = clusters.Cells(k, 1)
    if k <= fan:
        cells.divide({-1: centers}, {-1: np.ones(k)})
    else:  # a tree: every centre below the nearest of some
        top = centers[:: k // fan]
        cells.divide({-1: top}, {-1: np.full(len(top), 100.0)})
        below = (centers @ top.T).argmax(axis=1)
        cells.divide({j: centers[below == j] for j in cells.open}, {j: np.ones((below == j).sum()) for j in cells.open})
    assert clusters.lost_links(cells, 0.85) <= 0.001 and clusters.lost_links(cells, 0.9) <= 0.0002
    assert clusters.lost_links(cells, 0.85, reach=1, pairs=2000) == 0


@pytest.mark.parametrize("reach", [clusters.REACH, 1])
def test_clusters_in_waves(spark, reach, monkeypatch):
    """What is shuffled at a time stays in proportion to the vectors, however many cells each of them visits."""
    sent = []

    def told(df, name="step", **how):
        if name == "wave":
            sent.append(name)
        return written(df, name, **how)

    monkeypatch.setattr(clusters, "written", told)
    monkeypatch.setattr(clusters, "WAVE", 0.5)
    monkeypatch.setattr(clusters, "WHOLE_ROWS", 30)
    monkeypatch.setattr(clusters, "FINE_ROWS", 10)
    x = sample(600, 8, seed=6)
    got = {(r["id"], r["lead"]) for r in clusters.clusters(spark.createDataFrame(rows_of(x), SCHEMA), cell_rows=60, reach=reach).collect()}
    assert got == brute_clusters(x) and len(sent) >= 3


@pytest.mark.parametrize(("fine_rows", "reach"), [(10, 1), (10, clusters.FINE_REACH), (100, clusters.FINE_REACH)])
def test_divided_comparison_finds_all_components(fine_rows, reach, monkeypatch):
    monkeypatch.setattr(clusters, "FINE_ROWS", fine_rows)
    monkeypatch.setattr(clusters, "FINE_HELD", 700)
    rng = np.random.default_rng(8)
    chain = np.zeros((40, 64))
    chain[:, 0], chain[:, 1] = np.cos(0.15 * np.arange(40)), np.sin(0.15 * np.arange(40))
    tight = rng.normal(size=64) + rng.normal(size=(900, 64)) * 0.1
    x = unit(np.concatenate([sample(2000, 30, seed=9, noise=0.05), chain, tight]))[rng.permutation(2940)].astype(np.float32)
    for core in (np.zeros(len(x), dtype=bool), x @ unit(tight.mean(axis=0)[None])[0] >= 0.97):
        assert (clusters.divided(x, 0.85, core, reach) == clusters.components(x, 0.85, core)).all()


def test_shuffle_files_go_with_a_tidy_write(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in manager.localDirsString() for f in glob.glob(os.path.join(d, "**", "shuffle_*.data"), recursive=True)}
    before = held()
    table = written(spark.range(5000).selectExpr("id % 100 as k").repartition(4, "k").groupBy("k").count(), tidy=True)
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and table.count() == 100


def test_described_and_empty(spark):
    x = sample(200, 4, seed=3)
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    want = {}
    for i, lead in brute_clusters(x):
        want.setdefault(lead, []).append(i)
    got = {r["lead"]: r for r in clusters.described(df).collect()}
    assert {k: r["size"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    u = unit(x)
    for lead, r in got.items():
        own = np.array(sorted(want[lead])) - 10
        mean = u[own].mean(axis=0)
        cos = {i + 10: float(u[i] @ mean / np.linalg.norm(mean)) for i in own}
        assert np.allclose([cos[i] for i in r["typical"]], sorted(cos.values(), reverse=True)[: len(r["typical"])], atol=2e-4)
    empty = df.where("id < 0")
    assert clusters.clusters(empty).count() == 0 and knn.neighbours(empty).count() == 0 and knn.close_pairs(empty).count() == 0


def test_recall_against_numpy(spark):
    from tessera.llm import recall

    x = np.concatenate([sample(300, 5), sample(300, 5)[:4]])
    rows, copies = vectors.records(spark.createDataFrame(rows_of(x), SCHEMA))
    own = rows.unionByName(copies.join(rows.withColumnRenamed("id", "rep"), ["kind", "rep"]).select("kind", "id", "q"))
    got = {(r["id"], r["rank"]): r["cos"] for r in recall.exact_lists(own, own.where("id % 7 = 0")).collect()}
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    want = {(i + 10, k + 1): v for i in range(len(x)) if (i + 10) % 7 == 0 for k, v in enumerate(-np.sort(-c[i])[:5])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    bands = recall.recall(spark.createDataFrame(rows_of(x), SCHEMA), every=7).collect()
    assert sum(r["asked"] for r in bands) == len(want) and all(r["found"] <= r["asked"] for r in bands)
    close = [r for r in bands if r["band"] == 0.99]
    assert close and all(r["found"] == r["asked"] for r in close)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aliases as al
from tessera.operators.hierarchy import Peeled, alias_nodes, descendants, hierarchy, pack_nodes, paths

SCHEMA = "map_id string, node_id string, parent_id string"


def brute(rows):
    up = {(m, n): p for m, n, p in rows}
    out = {}
    for m, n in up:
        path, at = [n], n
        while True:
            p = up[(m, at)]
            if p is None or (m, p) not in up:
                out[(m, n)] = (path[-1], path[::-1], False, path[-1])
                break
            if p in path:
                out[(m, n)] = (None, None, True, p)
                break
            path.append(p)
            at = p
    return out


@pytest.mark.parametrize("limit", [200_000, 6, 1])
def test_random_forests(spark, limit):
    rng = random.Random(3)
    rows = []
    for m in range(4):
        n = (3, 5, 9, 14)[m]
        rows += [(f"m{m}", f"n{i}", rng.choice([None, "gone", *(f"n{j}" for j in range(n))])) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("in_cycle", F.lit("clash"))
    want = brute(rows)
    found = {(r["map_id"], r["node_id"]): r for r in hierarchy(df, limit).collect()}
    long = {(r["map_id"], r["node_id"]): r for r in paths(df, limit).collect()}
    assert set(found) == set(long) == set(want)
    for key, (root, path, cyclic, end) in want.items():
        r = found[key]
        assert (r["root_id"], r["in_cycle"], r["end_id"]) == (root, cyclic, end), key
        assert (long[key]["root_id"], long[key]["path"], long[key]["in_cycle"]) == (root, path, cyclic), key
        if not cyclic:
            below = sum(1 for k, v in want.items() if k[0] == key[0] and v[1] and key[1] in v[1][:-1])
            assert (r["depth"], r["hops"], r["n_descendants"]) == (len(path) - 1, len(path) - 1, below)
            assert (long[key]["depth"], long[key]["n_descendants"]) == (len(path) - 1, below)
        else:
            seen, at, up = [], key[1], {n: p for m, n, p in rows if m == key[0]}
            while at not in seen:
                seen.append(at)
                at = up[at]
            assert r["hops"] == len(seen), key
    pairs = sorted((r["map_id"], r["ancestor_id"], r["descendant_id"], r["distance"]) for r in descendants(df, limit).collect())
    assert pairs == sorted((k[0], a, k[1], len(v[1]) - 1 - i) for k, v in want.items() if v[1] for i, a in enumerate(v[1][:-1]))


@pytest.mark.parametrize("shape", ["chain", "caterpillar", "random", "star"])
def test_peeling_of_deep_and_wide_trees(shape):
    n = 60_000
    rng = np.random.default_rng(3)
    parent = {"chain": np.arange(n) - 1, "caterpillar": np.where(np.arange(n) % 2, np.arange(n) - 1, np.arange(n) - 2), "random": (rng.random(n) * np.arange(n)).astype(int), "star": np.zeros(n, dtype=int)}[shape]
    parent[0] = -1
    forest = Peeled(parent)
    depth, size = np.zeros(n, dtype=int), np.ones(n, dtype=int)
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    for v in range(n - 1, 0, -1):
        size[parent[v]] += size[v]
    assert (forest.depth == depth).all() and (forest.size == size).all() and (forest.root == 0).all() and (forest.hops == depth).all()
    assert sorted(forest.order.tolist()) == list(range(n))
    for v in rng.integers(0, n, 50).tolist():  # all that stand in the slice lead to v
        own = forest.order[forest.place[v] + 1 : forest.place[v] + size[v]]
        for w in own[rng.integers(0, len(own), 3)].tolist() if len(own) else []:
            while depth[w] > depth[v]:
                w = parent[w]
            assert w == v


def test_a_chain_that_fits_no_task(spark):
    n = 3000
    chain = spark.range(n).selectExpr("'m' as map_id", "cast(id as string) as node_id", "case when id > 0 then cast(id - 1 as string) end as parent_id")
    tail = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("m", "c", "b"), ("m", "d", "a")], SCHEMA)
    got = hierarchy(chain.unionByName(tail), in_task_rows=500)
    assert tuple(got.where("not in_cycle").agg(F.count("*"), F.max("depth"), F.max("n_descendants"), F.sum("depth"), F.sum("n_descendants")).first()) == (n, n - 1, n - 1, n * (n - 1) // 2, n * (n - 1) // 2)
    assert {(r["node_id"], r["end_id"], r["hops"]) for r in got.where("in_cycle").collect()} == {("a", "b", 3), ("b", "b", 2), ("c", "c", 2), ("d", "b", 4)}


def test_edges(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("m", None, "a"), (None, "x", None), ("m", "a", "a"), ("m", "b", None), ("m", "b", None)]
    got = {r["node_id"]: (r["root_id"], r["in_cycle"]) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (None, True), "b": ("b", False)}
    chain = [("m", f"{i}", f"{i - 1}" if i else None) for i in range(700)]
    deep = hierarchy(spark.createDataFrame(chain, SCHEMA)).agg(F.max("depth"), F.max("n_descendants")).first()
    assert tuple(deep) == (699, 699)


def test_nodes(spark):
    packs = spark.createDataFrame([(" A ", "b", 1), ("a", "C\t", 2), ("b", " ", 1), (None, "a", 1), (" ", "a", 1)], "pack_id string, parent_pack_id string, loaded_at int")
    assert {tuple(r) for r in pack_nodes(packs).collect()} == {("pack", "a", "c"), ("pack", "b", None)}
    told = spark.createDataFrame([("s", 1, 5, 6), ("s", 3, 5, 7), ("s", 2, 5, 8)], "map_id string, pos int, old_code int, new_code int")
    assert {tuple(r) for r in alias_nodes(told).collect()} == {("s", "5", "7"), ("s", "7", None)}


def test_follow_aliases(spark):
    maps = {"a": {1: 2, 2: 3, 3: 4, 4: 5}, "b": {1: 2, 2: 1, 3: 1}, "c": {1: 1, 2: 1}, "d": {1: 2, 2: 3, 3: 4, 4: 2, 9: 1}}
    rows = [(m, k, o, n) for m, d in maps.items() for k, (o, n) in enumerate(d.items())]
    df = spark.createDataFrame(rows, "pack_id string, pos int, old_code int, new_code int")

    def walk(d, code, most):
        seen, hops = set(), 0
        while code in d and hops < most:
            if code in seen:
                return code
            seen.add(code)
            code, hops = d[code], hops + 1
        return code

    for most in (1, 2, 3, 64):
        got = {(r["pack_id"], r["old_code"]): r["reached_code"] for r in al.follow_aliases(df, most).collect()}
        assert got == {(m, o): walk(d, o, most) for m, d in maps.items() for o in d}, most
    closure = {(r["pack_id"], r["old_code"]): (r["resolved_code"], r["cyclic"]) for r in al.alias_closure(df).collect()}
    assert closure[("a", 1)] == (5, False) and closure[("b", 3)] == (1, True) and closure[("c", 2)] == (1, True) and closure[("d", 9)] == (2, True)
    assert {r["pack_id"]: r["has_cycle"] for r in al.alias_cycles(df).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_follow_queries_at_their_bounds(spark, tmp_path):
    from tessera.plans.alphabet_queries import QUERIES

    chain = [("e", k, k, k + 1) for k in range(70)]
    spark.createDataFrame(chain, "pack_id string, pos int, old_code int, new_code int").write.parquet(str(tmp_path / "pack_aliases.parquet"))
    for name, most in (("alias_follow", 3), ("alias_follow_default", 64)):
        got = {r["old_code"]: r["reached_code"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {k: min(k + most, 70) for k in range(70)}, name

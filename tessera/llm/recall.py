"""python -m tessera.llm.recall DIR: recall of the neighbour lists against brute force, for every vector whose id is divisible by 100 (or --all).

--scale=N: with the bucket layout of N times as many vectors; --links: the share of links p3 loses instead, by number of cells.

Brute force takes the asked vectors in blocks of bounded size, each against all rows in one narrow pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import clusters, knn, vectors
from tessera.llm.vectors import WIDTH, unpack
from tessera.session import get_session, ship, written

BANDS = (-2.0, 0.6, 0.99)
#: Vectors asked for in one pass: 13 MB sent to each task.
ASKED = 100_000
#: Two cosines of 16-bit vectors are no further apart if their vectors are as near.
TOLERANCE = 2e-5


def exact_lists(rows: DataFrame, asked: DataFrame, k: int = knn.K) -> DataFrame:
    """(kind, id, rank, cos): the cosines of the k nearest others in rows (kind, id, q) of each vector asked for, likewise (kind, id, q)."""
    asked = written(asked.withColumn("block", F.floor((F.row_number().over(Window.orderBy("kind", "id")) - 1) / ASKED)), "asked")
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]  # one for ASKED vectors
    out = None
    for block in blocks:
        table = asked.where(F.col("block") == block).select("kind", "id", "q").toArrow().combine_chunks()  # at most ASKED
        kinds, ids, x = table.column("kind").to_numpy(), table.column("id").to_numpy(), unpack(table.column("q"))

        def run(batches: Iterator[pa.RecordBatch], kinds=kinds, ids=ids, x=x) -> Iterator[pa.RecordBatch]:
            best = np.full((len(ids), k), -2.0, dtype=np.float32)
            for batch in batches:
                other, own, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(), unpack(batch.column(2))
                for lo in range(0, len(ids), 1024):
                    part = slice(lo, lo + 1024)
                    cos = x[part] @ y.T
                    cos[(kinds[part, None] != other) | (ids[part, None] == own)] = -2
                    both = np.concatenate([best[part], cos], axis=1)
                    best[part] = -np.partition(-both, k - 1, axis=1)[:, :k]
            at, _ = np.nonzero(best > -2)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[at]), pa.array(ids[at]), pa.array(best[best > -2])], names=["kind", "id", "cos"])

        part = rows.select("kind", "id", "q").mapInArrow(run, "kind int, id bigint, cos float")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "kind int, id bigint, cos float")
    rank = F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("cos")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("kind", "id", "rank", "cos")


def recall(raw: DataFrame, every: int = 100, scale: int = 1) -> DataFrame:
    """(kind, band, asked, found): true neighbours of the vectors whose id is divisible by ``every``, and how many of them the lists have, by their cosine.

    A neighbour is a true one if it is as near as the last of the exact list, so ties count whichever is taken.
    """
    rows, copies = vectors.records(raw)
    own = rows.unionByName(copies.join(rows.withColumnRenamed("id", "rep"), ["kind", "rep"]).select("kind", "id", "q"))
    exact = written(exact_lists(own, own.where(F.col("id") % every == 0)), "exact")
    last = exact.groupBy("kind", "id").agg(F.min("cos").alias("last"))
    got = knn.neighbours(raw, scale=scale).where(F.col("id") % every == 0).join(last, ["kind", "id"]).where(F.col("cos") >= F.col("last") - TOLERANCE)
    band = F.when(F.col("cos") >= BANDS[2], BANDS[2]).when(F.col("cos") >= BANDS[1], BANDS[1]).otherwise(BANDS[0]).alias("band")
    count = lambda df, name: df.groupBy("kind", band).agg(F.count("*").alias(name))
    return count(exact, "asked").join(count(got, "found"), ["kind", "band"], "left").select("kind", "band", "asked", F.coalesce("found", F.lit(0)).alias("found"))


def links(numbers=(50, 1000, 10_000, 40_000)) -> None:
    rng = np.random.default_rng(3)
    for k in numbers:
        cells = clusters.Cells(k, 1)
        x = rng.normal(size=(k, WIDTH))
        cells.divide({-1: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)}, {-1: np.ones(k)})
        y = rng.normal(size=(2000, WIDTH))
        copies = len(cells.visits((y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32), clusters.REACH, ((1 - clusters.LEAST) / 2) ** 0.5)[0]) / 2000
        print(f"{k} cells: a vector without near ones is in {copies:.0f}; lost at cosine 0.85 {clusters.lost_links(cells, 0.85):.5f}, at 0.9 {clusters.lost_links(cells, 0.9):.5f}")


if __name__ == "__main__":
    if "--links" in sys.argv:
        links()
        sys.exit()
    session = get_session("local[8]", **{"spark.driver.memory": "12g", "spark.driver.maxResultSize": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    times = max([int(x[8:]) for x in sys.argv if x.startswith("--scale=")], default=1)
    result = recall(vectors.raw_vectors(session, sys.argv[1]), 1 if "--all" in sys.argv else 100, times).orderBy("kind", "band").collect()
    for kind, name in enumerate(vectors.KINDS):
        mine = [r for r in result if r["kind"] == kind]
        for r in mine:
            print(f"{name}: cosine from {r['band']:g}: recall {r['found'] / r['asked']:.4f} of {r['asked']}")
        if mine:
            print(f"{name}: all: recall {sum(r['found'] for r in mine) / sum(r['asked'] for r in mine):.4f}")

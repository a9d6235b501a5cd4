"""Queries of the training-data problems for language models, and their SQL where SQL can express them."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.llm import bpe, clusters, knn, mojibake, packing, recall, runs, vectors
from tessera.operators.hierarchy import alias_nodes, paths
from tessera.session import ship, table, written


def _kind(column="kind"):
    return F.element_at(F.array(*map(F.lit, vectors.KINDS)), F.col(column) + 1).alias("rec_kind")


def p2_found(spark, sf_dir):
    ship(spark)
    return knn.close_pairs(vectors.raw_vectors(spark, sf_dir)).select(_kind(), F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p2_neighbours(spark, sf_dir):
    """The 5 most similar other vectors of every vector, with their cosine."""
    ship(spark)
    return knn.neighbours(vectors.raw_vectors(spark, sf_dir)).select(_kind(), "id", F.col("other").alias("neighbour_id"), "rank", F.round(F.col("cos").cast("double"), 4).alias("cosine"))


def p2_recall(spark, sf_dir):
    """Of every vector whose id is divisible by 100, against all: how many true neighbours there are, and whether the lists have nine of ten, and all but one in a thousand from 0.99."""
    ship(spark)
    bands = recall.recall(vectors.raw_vectors(spark, sf_dir))
    close = F.col("band") == recall.BANDS[2]
    total = bands.groupBy("kind").agg(F.sum("asked").alias("asked"), F.sum("found").alias("found"), F.sum(F.when(close, F.col("asked"))).alias("near"), F.sum(F.when(close, F.col("found"))).alias("near_found"))
    return total.select(_kind(), "asked", (F.col("found") >= 0.9 * F.col("asked")).alias("enough"), F.coalesce(F.col("near_found") >= 0.999 * F.col("near"), F.lit(True)).alias("enough_close"))


def p3_found(spark, sf_dir):
    ship(spark)
    return clusters.clusters(vectors.raw_vectors(spark, sf_dir)).select(_kind(), F.col("id").alias("member_id"), F.col("lead").alias("lead_id"))


def p3_clusters(spark, sf_dir):
    """Every cluster with its size and its three most typical members."""
    ship(spark)
    return clusters.described(vectors.raw_vectors(spark, sf_dir)).select(_kind(), F.col("lead").alias("lead_id"), "size", "typical")


def _stream_events(spark, sf_dir):
    codes = table(spark, sf_dir, "stream_codes")
    return codes.select(F.col("stream_id").alias("entity"), "pos", "code", F.col("emitted_at").alias("at"), F.col("arrived_at").alias("arrived"))


def _alias_paths(spark, sf_dir):
    """{code: path from the root} of the codes of map ``stream`` that reach a root; a map that is not small is refused."""
    rows = alias_nodes(table(spark, sf_dir, "stream_aliases").withColumn("map_id", F.lit("stream")))
    found = paths(rows).where("not in_cycle").select(F.col("node_id").cast("int").alias("code"), F.col("path").cast("array<int>").alias("path"))
    known = found.take(runs.MAX_NEAR + 1)
    if len(known) > runs.MAX_NEAR:
        raise ValueError(f"more than {runs.MAX_NEAR} codes in the alias map")
    return {r["code"]: r["path"] for r in known}


def _equivalent(spark, sf_dir):
    """Runs of equal or equivalent codes, each under the root of its codes."""
    known = _alias_paths(spark, sf_dir)
    tree = {}
    for code, path in known.items():
        tree.setdefault(path[0], []).append(code)
    found = runs.collapse(_stream_events(spark, sf_dir), {(a, b): 0.0 for own in tree.values() for a, b in itertools.combinations(own, 2)})
    roots = [(code, path[0]) for code, path in known.items()]
    roots = spark.createDataFrame(roots, "code int, root int")
    return found.join(roots, "code", "left").withColumn("code", F.coalesce("root", "code"))


def p5_found(spark, sf_dir):
    ship(spark)
    return _equivalent(spark, sf_dir).where("n_events >= 3").select(F.col("entity").alias("stream_id"), "first_pos", "last_pos")


def _seconds():
    return (F.timestamp_diff("MICROSECOND", F.col("first_at"), F.col("last_at")) / F.lit(1e6)).alias("duration_s")


def p5_runs(spark, sf_dir):
    """Every run of equal or equivalent codes with its code, count and duration in seconds."""
    ship(spark)
    return _equivalent(spark, sf_dir).select(F.col("entity").alias("stream_id"), "code", "n_events", "first_pos", "last_pos", _seconds())


def p5_near_runs(spark, sf_dir):
    """Runs of near-identical codes: the dissimilarity of two codes of one alias tree is a tenth of the steps between them."""
    ship(spark)
    near = {}
    for (a, p), (b, q) in itertools.combinations(_alias_paths(spark, sf_dir).items(), 2):
        common = sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(p, q)))
        if common:
            near[a, b] = min(runs.FAR, 0.1 * (len(p) + len(q) - 2 * common))
    found = runs.collapse(_stream_events(spark, sf_dir), near)
    return found.select(F.col("entity").alias("stream_id"), "code", "n_events", "first_pos", "last_pos", _seconds())


def p6_ids(spark, sf_dir):
    ship(spark)
    return bpe.token_ids(table(spark, sf_dir, "documents"))


def p7_pack(spark, sf_dir):
    """Where each document (or each piece of one longer than a container) goes."""
    ship(spark)
    return packing.pack(written(bpe.token_counts(table(spark, sf_dir, "documents")), "counts"))


def p7_fill(spark, sf_dir):
    """Containers, tokens and unused share of the whole packing."""
    packed = p7_pack(spark, sf_dir).where("container_id is not null")
    used = packed.agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.withColumn("least_containers", F.ceil(F.col("tokens") / packing.CAPACITY)).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY))


def p7_whole(spark, sf_dir):
    """What holds for the whole packing: every document is there with all of its tokens, no container is overfull, no two pieces overlap, none is split but those beyond a container."""
    ship(spark)
    counts = written(bpe.token_counts(table(spark, sf_dir, "documents")), "counts")
    packed = written(packing.pack(counts).withColumn("end", F.col("offset") + F.col("n_tokens")), "packed")
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("pieces"))
    docs = counts.join(docs, "doc_id", "left").agg(
        F.count("*").alias("documents"), F.count_if(F.col("n_tokens") == 0).alias("without_tokens"), F.count_if(F.col("total").isNull() | (F.col("total") != F.col("n_tokens"))).alias("lost"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("split"),
    )
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max("end").alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"), F.countDistinct("step_group").alias("groups"))
    boxes = boxes.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"), F.count_if((F.col("end") != F.col("used")) | (F.col("places") != F.col("pieces")) | (F.col("groups") != 1)).alias("overlapping"))
    return docs.crossJoin(F.broadcast(boxes))  # one row each


def p8_found(spark, sf_dir):
    ship(spark)
    return mojibake.Garbled(table(spark, sf_dir, "documents")).found()


def p8_restored(spark, sf_dir):
    """The found documents with the original text, as far as it is known."""
    ship(spark)
    return mojibake.Garbled(table(spark, sf_dir, "documents")).restored()


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p2_recall, p3_found, p3_clusters, p5_found, p5_runs, p5_near_runs, p6_ids, p7_pack, p7_fill, p7_whole, p8_found, p8_restored)}

_UNITS = """
rows AS (
  SELECT 'observation' AS rec_kind, ord AS id, observation_id AS key, embedding AS v FROM observations
  UNION ALL SELECT 'symbol', symbol_id, CAST(symbol_id AS VARCHAR), proto_embedding FROM symbols),
usable AS (
  SELECT rec_kind, id, key, v FROM rows
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
first AS (
  SELECT rec_kind, id, v FROM usable WHERE key IS NULL
  UNION ALL SELECT rec_kind, min(id), arg_min(v, id) FROM usable WHERE key IS NOT NULL GROUP BY rec_kind, key),
units AS (SELECT rec_kind, id, CAST(v AS DOUBLE[64]) AS v FROM first)
"""

_LED = """
links AS (SELECT a.rec_kind, a.id AS id, b.id AS other FROM units a JOIN units b ON a.rec_kind = b.rec_kind WHERE array_cosine_similarity(a.v, b.v) >= 0.85 OR a.id = b.id),
reach AS (SELECT rec_kind, id, other FROM links UNION SELECT r.rec_kind, r.id, l.other FROM reach r JOIN links l ON l.rec_kind = r.rec_kind AND l.id = r.other),
led AS (SELECT rec_kind, id AS member_id, min(other) AS lead_id, count(*) AS n FROM reach GROUP BY ALL)
"""

_SERIES = """
told AS (SELECT old_code, max_by(new_code, (pos, new_code)) AS new_code FROM stream_aliases GROUP BY old_code),
walk AS (
  SELECT new_code AS code, new_code AS root FROM told WHERE new_code NOT IN (SELECT old_code FROM told)
  UNION
  SELECT t.old_code, w.root FROM walk w JOIN told t ON t.new_code = w.code),
last AS (
  SELECT stream_id, pos, code, emitted_at FROM (
    SELECT *, row_number() OVER (PARTITION BY stream_id, pos ORDER BY arrived_at DESC, code DESC NULLS LAST, emitted_at DESC NULLS LAST) AS k FROM stream_codes)
  WHERE k = 1 AND code IS NOT NULL),
rooted AS (SELECT l.stream_id, l.pos, l.emitted_at, coalesce(w.root, l.code) AS code FROM last l LEFT JOIN walk w ON w.code = l.code),
cuts AS (SELECT *, CASE WHEN lag(code) OVER s IS NOT DISTINCT FROM code THEN 0 ELSE 1 END AS cut FROM rooted WINDOW s AS (PARTITION BY stream_id ORDER BY pos)),
series AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY pos) AS k FROM cuts)
"""

SQL = {
    "p2_found": f"""WITH {_UNITS},
pairs AS (SELECT a.rec_kind, a.id AS id, b.id AS other, array_cosine_similarity(a.v, b.v) AS c FROM units a JOIN units b ON a.rec_kind = b.rec_kind AND a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rec_kind, id ORDER BY c DESC, other) AS k FROM pairs WHERE c >= 0.95)
SELECT DISTINCT rec_kind, least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE k <= 5 AND c >= 0.99""",
    "p2_recall": f"""WITH {_UNITS}
SELECT rec_kind, CAST(sum(least(5, n - 1)) AS BIGINT) AS asked, true AS enough, true AS enough_close FROM (SELECT *, count(*) OVER (PARTITION BY rec_kind) AS n FROM units) WHERE id % 100 = 0 GROUP BY rec_kind""",
    "p7_whole": """SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(text, '') = '') AS without_tokens, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping FROM documents""",
    "p3_clusters": f"""WITH RECURSIVE {_UNITS}, {_LED},
norm AS (SELECT u.rec_kind, id, lead_id, n, list_transform(CAST(v AS DOUBLE[]), lambda x: round(x / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) * 32767)) AS v FROM units u JOIN led l ON l.rec_kind = u.rec_kind AND l.member_id = u.id WHERE n >= 3),
cells AS (SELECT rec_kind, lead_id, generate_subscripts(v, 1) AS pl, unnest(v) AS x FROM norm),
mean AS (SELECT rec_kind, lead_id, list(x ORDER BY pl) AS m FROM (SELECT rec_kind, lead_id, pl, sum(x) AS x FROM cells GROUP BY ALL) GROUP BY ALL),
near AS (SELECT n.*, row_number() OVER (PARTITION BY n.rec_kind, n.lead_id ORDER BY round(list_cosine_similarity(v, m), 4) DESC, id) AS k FROM norm n JOIN mean USING (rec_kind, lead_id))
SELECT rec_kind, lead_id, any_value(n) AS size, list(id ORDER BY k) FILTER (WHERE k <= 3) AS typical FROM near GROUP BY rec_kind, lead_id""",
    "p3_found": f"""WITH RECURSIVE {_UNITS}, {_LED}
SELECT rec_kind, member_id, lead_id FROM led WHERE n >= 3""",
    "p5_found": f"""WITH RECURSIVE {_SERIES}
SELECT stream_id, min(pos) AS first_pos, max(pos) AS last_pos FROM series GROUP BY stream_id, k HAVING count(*) >= 3""",
    "p5_runs": f"""WITH RECURSIVE {_SERIES}
SELECT stream_id, min(code) AS code, count(*) AS n_events, min(pos) AS first_pos, max(pos) AS last_pos,
  date_diff('microsecond', arg_min(emitted_at, pos), arg_max(emitted_at, pos)) / 1e6 AS duration_s
FROM series GROUP BY stream_id, k""",
}

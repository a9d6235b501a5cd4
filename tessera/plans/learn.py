"""Learning an alphabet: observations to a sealed pack. Orchestrates the operators; only class-level figures reach the driver."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import ensure_embedding
from tessera.functions.vectors import mdl_bits
from tessera.operators import clustering, evolution, gloss
from tessera.pack import SymbolPack
from tessera.records import GuardSnapshot, Receipt
from tessera.session import ship, written

#: Observation ids that one symbol may hold.
MAX_IDS = 20_000_000


@dataclass(frozen=True)
class LearnConfig:
    n_symbols: int = 8
    min_cluster_size: int = 2
    tau_kappa: float = 0.35
    tau_residual: float = 0.55
    tau_persist: float = 0.80
    svd_rank: int | None = None
    seed: int = 0  # kept for its callers; seeding is deterministic
    match_threshold: float = evolution.MATCH


def class_table(assigned: DataFrame) -> DataFrame:
    """(class_id, size, kappa, observation_ids) of every class with members, from (class_id, ord, observation_id, cosine); kappa is the mean cosine to the prototype.

    A symbol holds its ids in one array, by the data model. A class of more than ``MAX_IDS`` is refused before anything is collected;
    ``class_members`` has the same as rows, whatever the size.
    """
    figures = assigned.groupBy("class_id").agg(F.count("*").alias("size"), F.avg("cosine").alias("kappa"))
    fits = F.when(F.col("size") <= MAX_IDS, F.col("size")).otherwise(F.raise_error(F.format_string("class %d has %d observation ids; take class_members", "class_id", "size")).cast("bigint"))
    figures = written(figures.select("class_id", fits.cast("int").alias("size"), "kappa"), "class-figures")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "observation_id"))), lambda x: x["observation_id"])
    return figures.join(assigned.groupBy("class_id").agg(ids.alias("observation_ids")), "class_id")


def class_members(assigned: DataFrame) -> DataFrame:
    """(class_id, ord, observation_id): the members of every class as rows."""
    return assigned.select("class_id", "ord", "observation_id")


def operational_residual(cluster: float, svd: float) -> float:
    return max(cluster, 0.25 * svd)


def quarantined(size, kappa, config: LearnConfig):
    """A class too small or too incoherent to be certified."""
    return (size < config.min_cluster_size) | (kappa < config.tau_kappa)


def decide(guards: dict) -> str:
    if guards["pass_all"]:
        return "accept"
    return "accept_provisional" if guards["pass_residual"] and guards["pass_compat"] else "reject"


def guard_values(kappa_avg: float, residual: float, delta: float, survival: float, dangling: bool, first: bool, config: LearnConfig) -> dict:
    out = {"kappa_avg": kappa_avg, "reconstruction_error": residual, "delta_mdl": delta, "min_survival": survival}
    tests = {
        "pass_kappa": kappa_avg >= config.tau_kappa, "pass_residual": residual <= config.tau_residual, "pass_mdl": delta <= 0.0,
        "pass_persist": first or survival >= config.tau_persist, "pass_compat": not dangling,
    }
    return out | {k: bool(v) for k, v in tests.items()} | {"pass_all": all(tests.values())}


def learn_pack(observations: DataFrame, *, config: LearnConfig | None = None, previous: SymbolPack | None = None, llm_client=None, pack_id: str | None = None) -> SymbolPack:
    """A sealed pack from (ord, observation_id, embedding, text). ``pack_id`` may be given so that equal input gives an equal seal."""
    cfg = config or LearnConfig()
    spark = observations.sparkSession
    ship(spark)
    rows = observations.select("ord", "observation_id", F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"), "text")
    rows = rows.withColumn("embedding", ensure_embedding(F.col("embedding"), F.col("text"), F.col("observation_id")))
    x = clustering.matrix(clustering.stack_embeddings(rows), ("observation_id", "text"))
    n, d = x.agg(F.count("*"), (F.max(F.octet_length("x")) / 8).cast("int")).first()
    if not n:
        raise ValueError("learn_pack requires at least one observation")
    rank = cfg.svd_rank or min(max(cfg.n_symbols, 1), n, d)
    svd = clustering.svd_residual(x, rank, n)
    assigned, centroids, _ = clustering.kmeans(x, max(1, min(cfg.n_symbols, n)), n)
    assigned = written(assigned.drop("distance2"), "assigned")
    k = len(centroids)
    residual = operational_residual(clustering.reconstruction_error(assigned), svd)

    protos = spark.createDataFrame([(c, centroids[c].tolist()) for c in range(k)], "class_id int, proto_embedding array<double>")
    members = written(class_table(assigned), "classes")
    glosses = gloss.learn_definition(assigned, llm_client=llm_client).drop("observation_count", "keywords")
    old = previous.symbols if previous is not None else None
    lasting = None
    if old is not None and not old.isEmpty():
        retained = protos.select(F.col("class_id").alias("pos"), F.col("class_id").alias("code"), "class_id", "proto_embedding")
        lasting = evolution.survival(evolution.similarities(old, retained))
    pid = pack_id or str(uuid.uuid4())
    size, kappa = F.coalesce("size", F.lit(0)), F.coalesce("kappa", F.lit(0.0))
    held = quarantined(size, kappa, cfg)
    table = protos.join(members, "class_id", "left").join(glosses, "class_id", "left")
    table = table.join(lasting, "class_id", "left") if lasting is not None else table.withColumn("survival", F.lit(1.0))
    text = F.nullif("definition", F.lit(""))
    none = F.array().cast("array<string>")
    symbols = table.select(
        F.lit(pid).alias("pack_id"), F.col("class_id").alias("pos"), "class_id", F.col("class_id").alias("code"),
        F.when(size > 0, F.col("proto_embedding")).otherwise(F.array_repeat(F.lit(0.0), d)).alias("proto_embedding"), F.coalesce("observation_ids", none).alias("observation_ids"),
        F.coalesce(text, F.when(held, F.format_string("[quarantined class %d]", "class_id"))).alias("definition"), F.coalesce("examples", none).alias("examples"),
        F.when(held, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), held.alias("quarantined"), F.coalesce("survival", F.lit(1.0)).alias("survival"),
        F.struct(kappa.alias("kappa"), size.cast("int").alias("size")).alias("metadata"),
    )
    symbols = written(symbols, "symbols")
    codebook = symbols.select("pack_id", "pos", "code", "class_id")
    if old is not None:
        told = evolution.match_aliases(evolution.similarities(old, symbols), cfg.match_threshold)
        aliases = written(told.select(F.lit(pid).alias("pack_id"), "pos", "old_code", "new_code"), "aliases")
    else:
        aliases = spark.createDataFrame([], schemas.ALIAS)

    facts = symbols.agg(
        F.avg("metadata.kappa").alias("kappa"), F.min("survival").alias("survival"), F.sum(F.coalesce(F.char_length("definition"), F.lit(0))).alias("chars")
    )
    facts = facts.withColumn("bits", mdl_bits(F.lit(k), F.lit(residual), F.lit(d), F.lit(n), F.col("chars"))).first()
    delta = 0.0 if previous is None else facts["bits"] - previous.mdl_bits
    dangling = not aliases.join(codebook.select(F.col("code").alias("new_code")), "new_code", "left_anti").isEmpty()
    guards = guard_values(facts["kappa"], residual, delta, facts["survival"], dangling, previous is None, cfg)
    decision, now = decide(guards), time.time()
    receipts = [
        Receipt("factorization", bool(svd <= cfg.tau_residual), now, reconstruction_error=svd, metadata={"rank": rank}),
        Receipt("clustering", guards["pass_persist"], now, kappa=facts["kappa"], metadata={"k": k, "min_survival": facts["survival"]}),
        Receipt("finalize", decision != "reject", now, kappa=facts["kappa"], reconstruction_error=residual, delta_mdl_bits=float(delta), metadata={"decision": decision}),
    ]
    knobs = {name: getattr(cfg, name) for name in ("n_symbols", "tau_kappa", "tau_residual", "tau_persist")}
    pack = SymbolPack(
        pid, symbols, codebook, aliases, residual, "", None if previous is None else previous.pack_id, receipts, GuardSnapshot(**guards), facts["bits"], now,
        {"n_observations": n, "decision": decision, "config": knobs},
    )
    return replace(pack, checksum=pack.compute_checksum())


def prototypes_of(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, size, proto_embedding): the mean vector of every group; element sums are combined before the shuffle."""
    each = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    mean = each.groupBy(key, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return mean.groupBy(key).agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("proto_embedding"))


def as_array(column) -> np.ndarray:
    return np.array(list(column), dtype=np.float64)

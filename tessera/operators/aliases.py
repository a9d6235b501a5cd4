"""Alias maps: single-hop rewriting, transitive closure, bounded following, cycles.

Maps of many packs are handled at once; every table carries pack_id. Of several statements about one old
code the one with the highest pos counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import alias_nodes, hierarchy


def last_statements(aliases: DataFrame) -> DataFrame:
    """(pack_id, pos, old_code, new_code): one row for each old code of a pack."""
    last = aliases.groupBy("pack_id", "old_code").agg(F.max(F.struct("pos", "new_code")).alias("last"))
    return last.select("pack_id", F.col("last.pos").alias("pos"), "old_code", F.col("last.new_code").alias("new_code"))


def rewrite_stream(codes: DataFrame, aliases: DataFrame, code: str = "code") -> DataFrame:
    """Every code replaced by its alias, one hop only. aliases: (old_code, new_code), one row for each old code."""
    hop = aliases.select(F.col("old_code").alias(code), F.col("new_code").alias("_new"))
    return codes.join(hop, code, "left").withColumn(code, F.coalesce("_new", code)).drop("_new")


def alias_closure(aliases: DataFrame) -> DataFrame:
    """(pack_id, old_code, resolved_code, cyclic) of every old code: where it leads in the end.

    On a loop a walk stops at the first code it meets again.
    """
    return _walks(aliases).select("pack_id", "old_code", "resolved_code", "cyclic")


def _walks(aliases: DataFrame) -> DataFrame:
    """(pack_id, old_code, resolved_code, cyclic, hops): the closure with the hops of the whole walk (with a loop: until a code is met again)."""
    nodes = hierarchy(alias_nodes(aliases.withColumnRenamed("pack_id", "map_id"))).where("parent_id is not null")
    code = lambda c: F.col(c).cast("int")
    return nodes.select(F.col("map_id").alias("pack_id"), code("node_id").alias("old_code"), code("end_id").alias("resolved_code"), F.col("in_cycle").alias("cyclic"), "hops")


def follow_aliases(aliases: DataFrame, max_hops: int = 64) -> DataFrame:
    """(pack_id, old_code, reached_code): as the closure, but after at most ``max_hops`` hops.

    Hops double: a table of 2^i hops is joined to itself, so the bound costs its logarithm in joins.
    """
    step = last_statements(aliases).select("pack_id", "old_code", "new_code")
    power = step.select("pack_id", F.col("old_code").alias("at"), F.col("new_code").alias("to"))
    reached = step.select("pack_id", "old_code", F.col("old_code").alias("at"), F.lit(True).alias("going"))
    left = max_hops
    while left:
        if left & 1:
            moved = reached.join(power, ["pack_id", "at"], "left")
            reached = moved.select("pack_id", "old_code", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("going"))
        left >>= 1
        if left:
            nxt = power.select("pack_id", F.col("at").alias("to"), F.col("to").alias("further"))
            power = power.join(nxt, ["pack_id", "to"], "left").select("pack_id", "at", F.coalesce("further", "to").alias("to"))
    return reached.join(_walks(aliases), ["pack_id", "old_code"]).select("pack_id", "old_code", F.when(F.col("hops") <= max_hops, F.col("resolved_code")).otherwise(F.col("at")).alias("reached_code"))


def alias_cycles(aliases: DataFrame) -> DataFrame:
    """(pack_id, has_cycle) of every pack that has aliases; a code that is its own alias counts."""
    return alias_closure(aliases).groupBy("pack_id").agg(F.bool_or("cyclic").alias("has_cycle"))


def dangling_targets(aliases: DataFrame, codebook: DataFrame) -> DataFrame:
    """Aliases whose target has no entry in the codebook of the pack."""
    return aliases.join(codebook.select("pack_id", F.col("code").alias("new_code")), ["pack_id", "new_code"], "left_anti")

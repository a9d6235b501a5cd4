"""Code streams to glosses: alias resolution, symbol lookup with fallback, states. Never invents English.

All joins are on (pack_id, code) with tables of one row for each key, so a stream is read once, in place,
and its rows neither multiply nor leave their partition where Spark finds the pack tables small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_definition
from tessera.functions.vectors import confidence_cap
from tessera.operators.aliases import alias_closure
from tessera.session import written


def live_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that are not quarantined (null counts as not)."""
    return symbols.where(~F.coalesce("quarantined", F.lit(False)))


def first_by(symbols: DataFrame, key: str) -> DataFrame:
    """Of the symbols of a pack with one class (or code) the first in list order."""
    rank = F.row_number().over(Window.partitionBy("pack_id", key).orderBy("pos"))
    return symbols.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def code_entries(codebook: DataFrame) -> DataFrame:
    """(pack_id, code, class_id): one row for each code; of repeated entries the last counts."""
    return codebook.groupBy("pack_id", "code").agg(F.max(F.struct("pos", "class_id")).getField("class_id").alias("class_id"))


def symbols_by_code(symbols: DataFrame, codebook: DataFrame) -> DataFrame:
    """(pack_id, code, symbol): the codebook's class first; where that class has no symbol, the first symbol of that own code."""
    fields = F.struct("class_id", "code", "observation_ids", "definition", "confidence", "quarantined")
    by_class = first_by(symbols, "class_id").select("pack_id", "class_id", fields.alias("by_class"))
    by_code = first_by(symbols, "code").select("pack_id", "code", fields.alias("by_code"))
    listed = code_entries(codebook).join(by_class, ["pack_id", "class_id"], "left").select("pack_id", "code", "by_class")
    both = listed.join(by_code, ["pack_id", "code"], "full")
    return both.select("pack_id", "code", F.coalesce("by_class", "by_code").alias("symbol")).where("symbol is not null")


def translate(codes: DataFrame, packs: DataFrame, symbols: DataFrame, codebook: DataFrame, aliases: DataFrame) -> DataFrame:
    """One gloss for each row of codes (pack_id, code, and any other columns, which are kept).

    A row of an unknown pack is ``unknown`` with null checksum. Null codes are unknown too.
    """
    closure = written(alias_closure(aliases), "closure").select("pack_id", F.col("old_code").alias("code"), "resolved_code")
    header = packs.select("pack_id", F.col("checksum").alias("pack_checksum"), F.coalesce("reconstruction_error", F.lit(0.0)).alias("_residual"))
    found = written(symbols_by_code(symbols, codebook), "lookup").select("pack_id", F.col("code").alias("_at"), "symbol")  # its size is then known to Spark
    rows = codes.join(closure, ["pack_id", "code"], "left").withColumn("_at", F.coalesce("resolved_code", "code")).withColumn("_aliased", F.col("resolved_code").isNotNull()).drop("resolved_code")
    rows = rows.join(found, ["pack_id", "_at"], "left").join(header, "pack_id", "left")
    s = F.col("symbol")
    known, quarantined = s.isNotNull(), F.coalesce(s["quarantined"], F.lit(False))
    text = normal_definition(s["definition"])
    return rows.select(
        *codes.columns,
        F.when(~known, F.format_string("[undecodable: no symbol for code %d]", "code"))
        .when(quarantined, F.format_string("[quarantined: symbol %d is not certified unfoldable]", "_at"))
        .when(text.isNull(), F.format_string("[unglossed: symbol %d has no bound English]", "_at"))
        .otherwise(text).alias("english"),
        F.when(known & ~quarantined & text.isNotNull(), confidence_cap(F.coalesce(s["confidence"], F.lit(0.0)), F.col("_residual"))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(~known, "unknown").when(quarantined, "quarantined").when(F.col("_aliased"), "aliased").otherwise("ok").alias("state"),
        "pack_checksum", s["class_id"].alias("class_id"), F.when(known, F.col("_at")).alias("resolved_code"),
        F.coalesce(s["observation_ids"], F.array().cast("array<string>")).alias("observation_ids"),
    )

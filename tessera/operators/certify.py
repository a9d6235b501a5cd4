"""Fail-closed certification of packs: addressable, unfoldable, gloss-bound, residual within bounds.

Many packs are certified at once. Each gate is a table of violations (pack_id, gate, rank, pos, message); a
certificate is the ordered list of a pack's violations. Checksums are computed by pack in workers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import digest16
from tessera.functions.text import normal_definition
from tessera.functions.vectors import is_finite
from tessera.operators.aliases import alias_closure, last_statements
from tessera.operators.translate import code_entries, live_symbols, symbols_by_code
from tessera.session import written

TAU_RESIDUAL = 0.55


def checksum_of(pack_id, residual, codebook: dict, aliases: dict, symbols: list[dict]) -> str:
    """The seal of one pack; symbols are dictionaries with the five sealed fields, in list order."""
    sealed = [{k: s[k] for k in ("class_id", "code", "observation_ids", "definition", "quarantined")} for s in symbols]
    for s in sealed:
        s["definition"] = (s["definition"] or "").strip() or None
        s["quarantined"] = bool(s["quarantined"])
        s["observation_ids"] = list(s["observation_ids"])
    return digest16({
        "pack_id": pack_id,
        "reconstruction_error": round(float(residual or 0.0), 8),
        "codebook": {str(k): int(v) for k, v in codebook.items()},
        "aliases": {str(k): int(v) for k, v in aliases.items()},
        "symbols": sorted(sealed, key=lambda s: s["class_id"]),
    })


def checksums(packs: DataFrame, symbols: DataFrame, codebook: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pack_id, expected_checksum) of every pack. The symbols of one pack are bounded by its alphabet."""
    seal = F.struct("pos", "class_id", "code", F.coalesce("observation_ids", F.array().cast("array<string>")).alias("observation_ids"), "definition", F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
    s = symbols.groupBy("pack_id").agg(F.sort_array(F.collect_list(seal)).alias("symbols"))
    c = code_entries(codebook).groupBy("pack_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "class_id"))).alias("codebook"))
    a = last_statements(aliases).groupBy("pack_id").agg(F.map_from_entries(F.collect_list(F.struct("old_code", "new_code"))).alias("aliases"))

    @F.pandas_udf("string")
    def seal_of(pack_id: pd.Series, residual: pd.Series, code: pd.Series, alias: pd.Series, symbol: pd.Series) -> pd.Series:
        rows = zip(pack_id, residual, code, alias, symbol)
        return pd.Series([checksum_of(p, None if pd.isna(r) else r, dict(c or {}), dict(a or {}), list(s) if s is not None else []) for p, r, c, a, s in rows], dtype=object)

    joined = packs.select("pack_id", "reconstruction_error").join(s, "pack_id", "left").join(c, "pack_id", "left").join(a, "pack_id", "left")
    return joined.select("pack_id", seal_of("pack_id", "reconstruction_error", "codebook", "aliases", "symbols").alias("expected_checksum"))


def violations(packs: DataFrame, symbols: DataFrame, codebook: DataFrame, aliases: DataFrame, expected: DataFrame, require_gloss: bool = True, tau_residual: float = TAU_RESIDUAL) -> DataFrame:
    """(pack_id, gate, rank, pos, message) of every broken rule, of the packs in ``packs``."""
    entries = code_entries(codebook).join(codebook.groupBy("pack_id", "code").agg(F.min("pos").alias("pos")), ["pack_id", "code"])

    def rows(df: DataFrame, gate: str, rank: int, pos, *message) -> DataFrame:
        return df.select("pack_id", F.lit(gate).alias("gate"), F.lit(rank).alias("rank"), F.col(pos).cast("bigint").alias("pos") if isinstance(pos, str) else pos.cast("bigint").alias("pos"), F.format_string(*message).alias("message"))

    classes = symbols.select("pack_id", "class_id").distinct()
    missing = entries.join(classes, ["pack_id", "class_id"], "left_anti")
    mapped = symbols.select("pack_id", "pos", "class_id", "code").join(entries.select("pack_id", "code", F.col("class_id").alias("mapped")), ["pack_id", "code"], "left")
    closure = written(alias_closure(aliases), "closure")
    loops = closure.where("cyclic").select("pack_id").distinct()
    told = last_statements(aliases).join(closure, ["pack_id", "old_code"])
    nowhere = told.join(symbols_by_code(symbols, codebook).select("pack_id", F.col("code").alias("resolved_code")), ["pack_id", "resolved_code"], "left_anti")
    live = live_symbols(symbols)
    seals = packs.select("pack_id", F.coalesce("checksum", F.lit("")).alias("checksum")).join(expected, "pack_id")
    residual = packs.select("pack_id", F.coalesce("reconstruction_error", F.lit(0.0)).alias("r"))
    out = [
        rows(missing, "addressable", 1, "pos", "code %d maps to missing class %d", "code", "class_id"),
        rows(mapped.where("mapped is null"), "addressable", 2, "pos", "symbol class %d code %d missing from codebook", "class_id", "code"),
        rows(mapped.where("mapped <> class_id"), "addressable", 2, "pos", "code %d codebook class %d != symbol class %d", "code", "mapped", "class_id"),
        rows(loops, "addressable", 3, F.lit(0), "alias map contains a cycle"),
        rows(nowhere, "addressable", 4, "pos", "alias %d->%d does not resolve to a symbol", "old_code", "new_code"),
        rows(live.where("coalesce(size(observation_ids), 0) <= 0"), "unfoldable", 5, "pos", "class %d has no observation_ids", "class_id"),
        rows(seals.where("checksum = ''"), "gloss_bound", 6, F.lit(0), "pack is unsealed (empty checksum)"),
        rows(seals.where("checksum <> '' and checksum <> expected_checksum"), "gloss_bound", 6, F.lit(0), "checksum mismatch: gloss/pack mutated after sealing"),
        rows(residual.where(~(is_finite(F.col("r")) & (F.col("r") <= tau_residual))), "residual_ok", 8, F.lit(0), f"reconstruction_error %.6f exceeds tau_residual {tau_residual}", "r"),
    ]
    if require_gloss:
        out.append(rows(live.where(normal_definition(F.col("definition")).isNull()), "gloss_bound", 7, "pos", "class %d has no bound English gloss", "class_id"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.join(packs.select("pack_id"), "pack_id", "left_semi")


GATES = ("addressable", "unfoldable", "gloss_bound", "residual_ok")


def certify(packs: DataFrame, symbols: DataFrame, codebook: DataFrame, aliases: DataFrame, require_gloss: bool = True, tau_residual: float = TAU_RESIDUAL) -> DataFrame:
    """One certificate for each pack of ``packs`` (one row for each pack_id)."""
    expected = written(checksums(packs, symbols, codebook, aliases), "checksums")
    broken = violations(packs, symbols, codebook, aliases, expected, require_gloss, tau_residual)
    found = broken.groupBy("pack_id").agg(
        *(F.bool_or(F.col("gate") == g).alias(f"_{g}") for g in GATES), F.sort_array(F.collect_list(F.struct("rank", "pos", "message"))).alias("_all")
    )
    counts = symbols.groupBy("pack_id").agg(F.count("*").alias("n_symbols"), F.count_if(~F.coalesce("quarantined", F.lit(False))).alias("n_live"), F.count_if(F.coalesce("quarantined", F.lit(False))).alias("n_quarantined"))
    n_aliases = last_statements(aliases).groupBy("pack_id").agg(F.count("*").alias("n_aliases"))
    rows = packs.join(expected, "pack_id").join(found, "pack_id", "left").join(counts, "pack_id", "left").join(n_aliases, "pack_id", "left")
    gates = {g: ~F.coalesce(F.col(f"_{g}"), F.lit(False)) for g in GATES}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return rows.select(
        "pack_id", F.coalesce("checksum", F.lit("")).alias("pack_checksum"), "expected_checksum",
        (gates["addressable"] & gates["unfoldable"] & gates["gloss_bound"] & gates["residual_ok"]).alias("passed"),
        *(gates[g].alias(g) for g in GATES), F.lit(True).alias("fail_closed"),
        F.coalesce(F.transform("_all", lambda x: x["message"]), F.array().cast("array<string>")).alias("failures"),
        F.unix_micros(F.current_timestamp()).cast("double").alias("_t"),
        F.struct(zero("n_symbols"), zero("n_live"), zero("n_quarantined"), zero("n_aliases"), F.coalesce("reconstruction_error", F.lit(0.0)).alias("reconstruction_error"), F.lit(float(tau_residual)).alias("tau_residual"), F.lit(require_gloss).alias("require_gloss"), F.coalesce("mdl_bits", F.lit(0.0)).alias("mdl_bits")).alias("details"),
    ).withColumn("timestamp", F.col("_t") / 1e6).drop("_t")

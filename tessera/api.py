"""The public names: one pack at a time, on top of the operators that take many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import certify as _certify
from tessera.operators import translate as _translate
from tessera.operators.dynamics import SubjectiveSymbolDynamics
from tessera.pack import SymbolPack, load_pack, save_pack
from tessera.plans.learn import LearnConfig, learn_pack
from tessera.records import AuditCertificate, Gloss, Observation, Receipt, Symbol
from tessera.session import ship
from tessera.sources.jsonl import iter_jsonl, load_observations_jsonl, load_stream


def translate_frame(pack: SymbolPack, codes: DataFrame) -> DataFrame:
    """Glosses of (pos, code) as a table: the form for streams of any length."""
    ship(pack.spark)
    rows = codes.select(F.lit(pack.pack_id).alias("pack_id"), F.col("pos").cast("bigint").alias("pos"), F.col("code").cast("int").alias("code"))
    return _translate.translate(rows, pack.header, pack.symbols, pack.codebook, pack.aliases).drop("pack_id")


def translate_stream(pack: SymbolPack, codes: DataFrame | Sequence[int]) -> list[Gloss]:
    """Glosses of a short stream as records, in order."""
    if not isinstance(codes, DataFrame):
        codes = pack.spark.createDataFrame([(k, int(c)) for k, c in enumerate(codes)], schemas.STREAM)
    rows = translate_frame(pack, codes).orderBy("pos").collect()
    return [Gloss.from_dict({k: v for k, v in r.asDict().items() if k in Gloss.FIELDS}) for r in rows]


def certify(pack: SymbolPack, *, require_gloss: bool = True, tau_residual: float = _certify.TAU_RESIDUAL) -> AuditCertificate:
    ship(pack.spark)
    row = _certify.certify(pack.header, pack.symbols, pack.codebook, pack.aliases, require_gloss, tau_residual).first()
    return AuditCertificate.from_dict(row.asDict(recursive=True))


__all__ = [
    "AuditCertificate", "Gloss", "LearnConfig", "Observation", "Receipt", "SubjectiveSymbolDynamics", "Symbol", "SymbolPack", "certify", "iter_jsonl",
    "learn_pack", "load_observations_jsonl", "load_pack", "load_stream", "save_pack", "translate_frame", "translate_stream",
]

"""A symbol pack: a small header and three tables, and its interchange form (JSON)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.certify import checksum_of
from tessera.records import GuardSnapshot, PackRecord, Receipt, Symbol


@dataclass
class SymbolPack:
    """symbols, codebook and aliases are tables with pack_id and pos; everything else is the header."""

    pack_id: str
    symbols: DataFrame
    codebook: DataFrame
    aliases: DataFrame
    reconstruction_error: float = 0.0
    checksum: str = ""
    parent_pack_id: str | None = None
    receipts: list[Receipt] = field(default_factory=list)
    guards: GuardSnapshot | None = None
    mdl_bits: float = 0.0
    timestamp: float = 0.0
    metadata: dict[str, Any] = field(default_factory=dict)

    HEADER = ("pack_id", "reconstruction_error", "checksum", "parent_pack_id", "receipts", "guards", "mdl_bits", "timestamp", "metadata")

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    @property
    def header(self) -> DataFrame:
        row = (self.pack_id, self.parent_pack_id, self.reconstruction_error, self.mdl_bits, self.checksum)
        return self.spark.createDataFrame([row], schemas.PACK)

    def to_record(self) -> PackRecord:
        """The interchange form, on the driver: symbols are as many as the alphabet has."""
        symbols = []
        for r in self.symbols.orderBy("pos").collect():
            meta = r["metadata"].asDict() if r["metadata"] is not None else {}
            values = {n: r[n] for n in Symbol.FIELDS if n != "metadata"} | {"metadata": {k: v for k, v in meta.items() if v is not None}}
            symbols.append(Symbol.from_dict(values))
        pairs = lambda df, a, b: {r[a]: r[b] for r in df.orderBy("pos").collect()}
        return PackRecord(symbols=symbols, codebook=pairs(self.codebook, "code", "class_id"), aliases=pairs(self.aliases, "old_code", "new_code"), **{n: getattr(self, n) for n in self.HEADER})

    @classmethod
    def from_record(cls, spark: SparkSession, record: PackRecord) -> SymbolPack:
        pid = record.pack_id
        symbols = [
            (pid, k, s.class_id, s.code, s.proto_embedding, s.observation_ids, s.definition, s.examples, s.confidence, s.quarantined, s.survival,
             (float(s.metadata["kappa"]) if s.metadata.get("kappa") is not None else None, s.metadata.get("size")) if s.metadata else None)
            for k, s in enumerate(record.symbols)
        ]
        rows = lambda pairs: [(pid, k, a, b) for k, (a, b) in enumerate(pairs.items())]
        return cls(
            symbols=spark.createDataFrame(symbols, schemas.SYMBOL), codebook=spark.createDataFrame(rows(record.codebook), schemas.CODEBOOK),
            aliases=spark.createDataFrame(rows(record.aliases), schemas.ALIAS), **{n: getattr(record, n) for n in cls.HEADER},
        )

    def compute_checksum(self) -> str:
        r = self.to_record()
        return checksum_of(r.pack_id, r.reconstruction_error, r.codebook, r.aliases, [s.to_dict() for s in r.symbols])

    def seal(self) -> SymbolPack:
        return replace(self, checksum=self.compute_checksum())

    def live(self) -> DataFrame:
        return self.symbols.where(~F.coalesce("quarantined", F.lit(False)))


def save_pack(pack: SymbolPack, path: str | Path) -> None:
    """JSON with sorted keys, two blanks of indent and a final newline."""
    Path(path).write_text(json.dumps(pack.to_record().to_dict(), indent=2, sort_keys=True) + "\n", encoding="utf-8")


def load_pack(spark: SparkSession, path: str | Path) -> SymbolPack:
    return SymbolPack.from_record(spark, PackRecord.from_dict(json.loads(Path(path).read_text(encoding="utf-8"))))


def save_tables(pack: SymbolPack, folder: str) -> None:
    """The pack as parquet tables, for alphabets and evidence beyond what one JSON file should hold."""
    pack.header.write.parquet(f"{folder}/pack")
    for name in ("symbols", "codebook", "aliases"):
        getattr(pack, name).write.parquet(f"{folder}/{name}")

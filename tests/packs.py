"""The two-symbol pack of the tests, and variants of it."""

from tessera.operators.certify import checksum_of
from tessera.pack import SymbolPack
from tessera.records import PackRecord, Symbol
from tessera.session import written


def two_symbols():
    return [
        Symbol(0, 0, [0.6, 0.8, 0.0], ["n-1", "n-2"], "Symbol for north.", ["north wind"], 0.75),
        Symbol(1, 1, [0.0, 0.28, 0.96], ["s-1"], "Symbol for south.", ["south"], 0.6),
    ]


def pack_of(spark, symbols=None, sealed=True, **header):
    symbols = two_symbols() if symbols is None else symbols
    values = {"pack_id": "pack-test", "reconstruction_error": 0.1, "mdl_bits": 9.0, "aliases": {}, "codebook": {s.code: s.class_id for s in symbols}}
    record = PackRecord(symbols=symbols, **(values | header))
    if sealed:
        record.checksum = checksum_of(record.pack_id, record.reconstruction_error, record.codebook, record.aliases, [s.to_dict() for s in symbols])
    return SymbolPack.from_record(spark, record)


def all_tables(packs):
    """The four tables of several packs (of different ids) together."""
    tables = [[p.header, p.symbols, p.codebook, p.aliases] for p in packs]
    out = tables[0]
    for more in tables[1:]:
        out = [a.unionByName(b) for a, b in zip(out, more)]
    return [written(t, "packs") for t in out]

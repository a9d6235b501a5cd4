"""The records of the data model and their plain-dictionary form.

Every record is declared as a table of fields (coercion, default); reading and writing dictionaries is generic.
Collections of records live in DataFrames; these classes are for single records at the edges (files, driver results).
"""

from __future__ import annotations

from typing import Any

REQUIRED = object()


def _maybe(kind):
    return lambda x: None if x is None else kind(x)


def _list(kind):
    return lambda x: [kind(i) for i in (x or [])]


def _whole_map(x) -> dict[int, int]:
    return {int(k): int(v) for k, v in (x or {}).items()}


def _number(x) -> float:
    return float(x or 0.0)


def _dict(x) -> dict:
    return dict(x or {})


class Record:
    #: name: (coercion when read, default when absent)
    FIELDS: dict[str, tuple[Any, Any]] = {}

    def __init__(self, *values, **named):
        given = dict(zip(self.FIELDS, values)) | named
        unknown = set(given) - set(self.FIELDS)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no field {sorted(unknown)[0]}")
        for name, (_, default) in self.FIELDS.items():
            if name not in given and default is REQUIRED:
                raise TypeError(f"{type(self).__name__} needs {name}")
            value = given.get(name, default)
            setattr(self, name, value() if callable(value) else value)
        self.check()

    def check(self) -> None:
        pass

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.to_dict() == other.to_dict()

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{n}={getattr(self, n)!r}' for n in self.FIELDS)})"

    def to_dict(self) -> dict:
        return {name: _plain(getattr(self, name)) for name in self.FIELDS}

    @classmethod
    def from_dict(cls, data: dict):
        values = {}
        for name, (coerce, default) in cls.FIELDS.items():
            if name in data:
                values[name] = coerce(data[name])
            elif default is REQUIRED:
                raise KeyError(name)
            else:
                values[name] = coerce(default() if callable(default) else default)
        return cls(**values)


def _plain(value):
    if isinstance(value, Record):
        return value.to_dict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


class Observation(Record):
    FIELDS = {"observation_id": (str, REQUIRED), "embedding": (_list(float), list), "text": (lambda x: x, None), "metadata": (_dict, dict)}


class Receipt(Record):
    FIELDS = {
        "step": (str, REQUIRED), "ok": (bool, REQUIRED), "timestamp": (float, REQUIRED), "kappa": (_maybe(float), None),
        "reconstruction_error": (_maybe(float), None), "delta_mdl_bits": (_maybe(float), None), "metadata": (_dict, dict),
    }


class GuardSnapshot(Record):
    FIELDS = {n: (lambda x: x, REQUIRED) for n in (
        "kappa_avg", "reconstruction_error", "delta_mdl", "min_survival", "pass_kappa", "pass_residual", "pass_mdl", "pass_persist", "pass_compat", "pass_all",
    )}


class Symbol(Record):
    FIELDS = {
        "class_id": (int, REQUIRED), "code": (int, REQUIRED), "proto_embedding": (_list(float), REQUIRED), "observation_ids": (_list(str), REQUIRED),
        "definition": (lambda x: x, None), "examples": (_list(str), list), "confidence": (_number, 0.0), "quarantined": (lambda x: bool(x or False), False),
        "survival": (lambda x: 1.0 if x is None else float(x), 1.0), "metadata": (_dict, dict),
    }

    @classmethod
    def from_dict(cls, data: dict):
        return super().from_dict({"proto_embedding": [], "observation_ids": []} | data)


GLOSS_STATES = ("ok", "aliased", "quarantined", "unknown")


class Gloss(Record):
    FIELDS = {
        "code": (int, REQUIRED), "english": (str, REQUIRED), "confidence": (float, REQUIRED), "state": (str, REQUIRED), "pack_checksum": (str, REQUIRED),
        "class_id": (_maybe(int), None), "resolved_code": (_maybe(int), None), "observation_ids": (_list(str), list),
    }

    def check(self) -> None:
        if self.state not in GLOSS_STATES:
            raise ValueError(f"invalid gloss state {self.state!r}")


class AuditCertificate(Record):
    FIELDS = {
        "pack_id": (str, REQUIRED), "pack_checksum": (str, REQUIRED), "expected_checksum": (str, REQUIRED), "passed": (bool, REQUIRED), "addressable": (bool, REQUIRED),
        "unfoldable": (bool, REQUIRED), "gloss_bound": (bool, REQUIRED), "residual_ok": (bool, REQUIRED), "fail_closed": (bool, True), "failures": (_list(str), list),
        "timestamp": (float, REQUIRED), "details": (_dict, dict),
    }


class PackRecord(Record):
    """A whole pack in its interchange form."""

    FIELDS = {
        "pack_id": (str, REQUIRED), "symbols": (_list(lambda s: s if isinstance(s, Symbol) else Symbol.from_dict(s)), list), "codebook": (_whole_map, dict), "aliases": (_whole_map, dict),
        "reconstruction_error": (_number, 0.0), "checksum": (lambda x: str(x or ""), ""), "parent_pack_id": (lambda x: x, None),
        "receipts": (_list(lambda r: r if isinstance(r, Receipt) else Receipt.from_dict(r)), list), "guards": (lambda g: GuardSnapshot.from_dict(g) if g else None, None),
        "mdl_bits": (_number, 0.0), "timestamp": (_number, 0.0), "metadata": (_dict, dict),
    }

    def to_dict(self) -> dict:
        out = super().to_dict()
        for name in ("codebook", "aliases"):
            out[name] = {str(k): int(v) for k, v in out[name].items()}
        return out

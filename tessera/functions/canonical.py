"""Canonical JSON and the short digest over it (Python: Spark's to_json writes numbers, escapes and nulls differently)."""

from __future__ import annotations

import hashlib
import json


def canonical_json(value) -> str:
    """Keys sorted, no blanks, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest16(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]

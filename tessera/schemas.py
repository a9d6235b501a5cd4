"""Schemas of the tables. Every table has an ordering column (ord or pos): order has meaning here, and Spark keeps none."""

from __future__ import annotations

OBSERVATION = "ord bigint, observation_id string, embedding array<double>, text string, metadata string"
SYMBOL = (
    "pack_id string, pos int, class_id int, code int, proto_embedding array<double>, observation_ids array<string>, definition string, "
    "examples array<string>, confidence double, quarantined boolean, survival double, metadata struct<kappa:double,size:int>"
)
CODEBOOK = "pack_id string, pos int, code int, class_id int"
ALIAS = "pack_id string, pos int, old_code int, new_code int"
PACK = "pack_id string, parent_pack_id string, reconstruction_error double, mdl_bits double, checksum string"
GLOSS = "pos bigint, code int, english string, confidence double, state string, pack_checksum string, class_id int, resolved_code int, observation_ids array<string>"
STREAM = "pos bigint, code int"

"""Queries of the general training-data problems: lines that fail to parse, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.hierarchy import all_nodes, descendants, hierarchy, paths
from tessera.session import ship, table
from tessera.sources.rejects import parse_lines, split_lines


def p1_found(spark, sf_dir):
    ship(spark)
    return parse_lines(table(spark, sf_dir, "raw_observations")).where("status = 'rejected'").select("raw_id")


def p1_loaded(spark, sf_dir):
    ship(spark)
    return parse_lines(table(spark, sf_dir, "raw_observations")).where("status = 'loaded'").select("raw_id", "observation_id", "text", "embedding", "metadata")


def p1_rejects(spark, sf_dir):
    ship(spark)
    return split_lines(table(spark, sf_dir, "raw_observations"))[1]


def p4_found(spark, sf_dir):
    ship(spark)
    return hierarchy(all_nodes(spark, sf_dir)).select("map_id", "node_id", F.coalesce("root_id", F.lit("cycle")).alias("root_id"))


def p4_paths(spark, sf_dir):
    ship(spark)
    return paths(all_nodes(spark, sf_dir)).select("map_id", "node_id", "root_id", "depth", F.array_join("path", ">").alias("path"), "n_descendants", "in_cycle")


def p4_descendants(spark, sf_dir):
    ship(spark)
    return descendants(all_nodes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_rejects, p4_found, p4_paths, p4_descendants)}

_NODES = r"""
packs AS (
  SELECT node_id, max_by(parent_id, (loaded_at, parent_id)) AS parent_id FROM (
    SELECT lower(regexp_replace(pack_id, '^\s+|\s+$', '', 'g')) AS node_id,
           nullif(lower(regexp_replace(parent_pack_id, '^\s+|\s+$', '', 'g')), '') AS parent_id, loaded_at
    FROM symbol_packs) WHERE node_id <> '' GROUP BY node_id),
told AS (
  SELECT map_id, old_code, max_by(new_code, (pos, new_code)) AS new_code FROM (
    SELECT pack_id AS map_id, pos, old_code, new_code FROM pack_aliases
    UNION ALL SELECT 'stream', pos, old_code, new_code FROM stream_aliases) GROUP BY ALL),
edges AS (
  SELECT 'pack' AS map_id, p.node_id, q.node_id AS parent_id FROM packs p LEFT JOIN packs q ON p.parent_id = q.node_id
  UNION ALL SELECT map_id, CAST(old_code AS VARCHAR), CAST(new_code AS VARCHAR) FROM told),
nodes AS (
  SELECT map_id, node_id, max(parent_id) AS parent_id FROM (
    SELECT map_id, node_id, parent_id FROM edges
    UNION ALL SELECT map_id, parent_id, NULL FROM edges WHERE parent_id IS NOT NULL) GROUP BY ALL),
walk AS (
  SELECT map_id, node_id, node_id AS at, 0 AS depth, [node_id] AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.map_id, n.node_id, w.at, w.depth + 1, list_append(w.path, n.node_id) FROM walk w JOIN nodes n ON n.map_id = w.map_id AND n.parent_id = w.node_id)
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
# JSON by RFC 8259: what the parser also takes (commas before a closing bracket, NaN, Infinity, comments) is looked for outside of strings
_LINES = rf"""
l AS (SELECT raw_id, line_no, fmt, regexp_replace(raw_line, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS line FROM raw_observations),
u AS (SELECT * FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
k AS (SELECT raw_id, line_no, line, regexp_replace(line, '"(?:[^"\\]|\\.)*"', '""', 'gs') AS bare FROM u WHERE fmt = 'jsonl'),
j AS (SELECT raw_id, line_no, line, json_valid(line) AND NOT regexp_matches(bare, ',[ \t\r\n]*[}}\]]') AND NOT regexp_matches(bare, 'N|I|i|//|/\*') AS ok FROM k),
jo AS (SELECT raw_id, line_no, CASE WHEN ok THEN json_type(line) END AS t, CASE WHEN ok THEN line END AS line FROM j),
jv AS (
  SELECT raw_id, line_no, json_type(line, '$.observation_id') AS it, line ->> '$.observation_id' AS id, json_type(line, '$.embedding') AS et, line -> '$.embedding' AS emb,
    json_type(line, '$.text') AS tt, line ->> '$.text' AS text FROM jo WHERE t = 'OBJECT'),
c AS (SELECT raw_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD}){{3}}', 's') AS ok FROM u WHERE fmt = 'csv'),
cf AS (SELECT raw_id, regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['id', 'text', 'emb', 'meta'], 's') AS f FROM c WHERE ok),
cv AS (SELECT raw_id, list_transform([f.id, f.text, f.emb], lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM cf),
v AS (
  SELECT raw_id, CASE WHEN it IS NULL THEN 'obs-' || line_no WHEN it IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'HUGEINT') THEN id ELSE '' END AS id,
    et IS NULL OR et = 'NULL' AS none, CAST(emb AS VARCHAR) AS emb, coalesce(tt <> 'NULL', false) AND text IS DISTINCT FROM '' AS has_text FROM jv
  UNION ALL SELECT raw_id, f[1], f[3] IN ('', 'null'), f[3], f[2] <> '' FROM cv),
e AS (SELECT raw_id, id, none, has_text, CASE WHEN NOT none AND json_valid(emb) THEN emb END AS emb FROM v),
g AS (SELECT *, none OR (json_type(emb) = 'ARRAY' AND json_array_length(emb) = 0) AS missing,
  json_type(emb) = 'ARRAY' AND json_array_length(emb) = 16 AND len(list_filter(TRY_CAST(emb AS JSON[]), lambda x: json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AND isfinite(TRY_CAST(CAST(x AS VARCHAR) AS DOUBLE)))) = 16 AS whole FROM e),
good AS (SELECT * FROM g WHERE regexp_full_match(id, '[A-Za-z0-9._:-]{{1,64}}') AND CASE WHEN missing THEN has_text ELSE coalesce(whole, false) END)
"""

SQL = {
    "p1_found": f"WITH {_LINES} SELECT raw_id FROM u WHERE raw_id NOT IN (SELECT raw_id FROM good)",
    "p1_loaded": f"""WITH {_LINES},
lit AS (
  SELECT raw_id, CASE WHEN json_type(line, '$.text') <> 'NULL' THEN line ->> '$.text' END AS text, CASE WHEN json_type(line, '$.metadata') <> 'NULL' THEN CAST(line -> '$.metadata' AS VARCHAR) END AS metadata FROM jo WHERE t = 'OBJECT'
  UNION ALL SELECT cv.raw_id, cv.f[2], nullif(m.x, '') FROM cv
    JOIN (SELECT raw_id, CASE WHEN starts_with(f.meta, '"') THEN replace(substr(f.meta, 2, length(f.meta) - 2), '""', '"') ELSE f.meta END AS x FROM cf) m ON m.raw_id = cv.raw_id)
SELECT g.raw_id, g.id AS observation_id, lit.text, CASE WHEN NOT missing THEN CAST(emb AS DOUBLE[]) END AS embedding, lit.metadata FROM good g JOIN lit ON lit.raw_id = g.raw_id""",
    "p4_found": f"""WITH RECURSIVE {_NODES}
SELECT n.map_id, n.node_id, coalesce(w.at, 'cycle') AS root_id FROM nodes n LEFT JOIN walk w ON w.map_id = n.map_id AND w.node_id = n.node_id""",
    "p4_descendants": f"""WITH RECURSIVE {_NODES}
SELECT map_id, path[i] AS ancestor_id, node_id AS descendant_id, CAST(depth + 1 - i AS INTEGER) AS distance
FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM walk WHERE depth > 0)""",
    "p4_paths": f"""WITH RECURSIVE {_NODES},
below AS (SELECT map_id, path[i] AS node_id, count(*) AS n FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM walk WHERE depth > 0) GROUP BY ALL)
SELECT n.map_id, n.node_id, w.at AS root_id, CAST(w.depth AS INTEGER) AS depth, coalesce(array_to_string(w.path, '>'), NULL) AS path,
  CASE WHEN w.at IS NOT NULL THEN coalesce(b.n, 0) END AS n_descendants, w.at IS NULL AS in_cycle
FROM nodes n LEFT JOIN walk w ON w.map_id = n.map_id AND w.node_id = n.node_id LEFT JOIN below b ON b.map_id = n.map_id AND b.node_id = n.node_id""",
}

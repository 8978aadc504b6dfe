"""Queries of the general data operators, with their SQL."""

from __future__ import annotations

from codestrata.operators import references, snapshots
from codestrata.session import load


def p1_found(spark, sf):
    return snapshots.snapshot_changes(load(spark, sf, "snapshots"))


def p1_change_counts(spark, sf):
    """Added, removed and changed entries per repository, snapshot and field."""
    from pyspark.sql import functions as F

    d = p1_found(spark, sf).groupBy("repo_id", "snapshot_id", "field")
    return d.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "changed")])


def _orphans(spark, sf):
    return references.relation_orphans(load(spark, sf, "kg_relations"), load(spark, sf, "kg_entities"), load(spark, sf, "kg_docs"))


def p4_found(spark, sf):
    return _orphans(spark, sf).select("id", "ref", "state")


def p4_orphan_counts(spark, sf):
    return references.orphan_counts(_orphans(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_change_counts, p4_found, p4_orphan_counts)}

_P1 = r"""
s0 AS (SELECT DISTINCT repo_id, id, created_at, data FROM snapshots WHERE json_valid(data) AND json_type(data) = 'OBJECT'),
norm AS (SELECT repo_id, id, created_at,
  CASE WHEN json_type(data, '$.fileCoupling') = 'OBJECT' THEN data->'$.fileCoupling' END fc,
  CASE WHEN json_type(data, '$.untestedFilePaths') = 'ARRAY' THEN data->'$.untestedFilePaths' END ut,
  data->>'$.healthScore' hs FROM s0),
f AS (
  SELECT repo_id, id, created_at, 'fileCoupling' field, fc j FROM norm WHERE fc IS NOT NULL
  UNION ALL SELECT repo_id, id, created_at, 'untestedFilePaths', ut FROM norm WHERE ut IS NOT NULL
  UNION ALL SELECT repo_id, id, created_at, 'healthScore', to_json(hs) FROM norm WHERE hs IS NOT NULL),
o AS (SELECT *, lag(id) OVER w prev_id, lead(id) OVER w next_id FROM f WINDOW w AS (PARTITION BY repo_id, field ORDER BY created_at, id)),
k AS (
  SELECT o.*, e.key item, concat_ws('|', CAST(TRY_CAST(e.value->>'$.in' AS DOUBLE) AS VARCHAR), CAST(TRY_CAST(e.value->>'$.out' AS DOUBLE) AS VARCHAR)) h FROM o, json_each(j) e WHERE field = 'fileCoupling'
  UNION ALL SELECT o.*, e.value->>'$' item, '' h FROM o, json_each(j) e WHERE field = 'untestedFilePaths'
  UNION ALL SELECT o.*, 'healthScore', CAST(TRY_CAST(j->>'$' AS DOUBLE) AS VARCHAR) FROM o WHERE field = 'healthScore'),
n AS (SELECT repo_id, field, id, prev_id, next_id, regexp_replace(regexp_replace(replace(item, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') item, max(h) h FROM k GROUP BY ALL),
d AS (SELECT coalesce(c.repo_id, p.repo_id) repo_id, coalesce(c.id, p.next_id) snapshot_id, coalesce(c.field, p.field) field, coalesce(c.item, p.item) item,
  CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN c.h <> p.h THEN 'changed' END change
  FROM (SELECT * FROM n WHERE prev_id IS NOT NULL) c FULL OUTER JOIN (SELECT * FROM n WHERE next_id IS NOT NULL) p
  ON c.repo_id = p.repo_id AND c.field = p.field AND c.id = p.next_id AND c.item = p.item)
"""

_P4 = r"""
e AS (SELECT 'kg_entities' target, lower(trim(id)) key, loaded_at s, deleted_at e FROM kg_entities
  UNION ALL SELECT 'kg_docs', lower(trim(id)), CAST(to_timestamp(indexed_at) AT TIME ZONE 'UTC' AS TIMESTAMP), deleted_at FROM kg_docs),
g AS (SELECT target, key, min(s) first_s FROM e GROUP BY ALL),
r AS (SELECT DISTINCT id, loaded_at t, ref, target, key FROM (
  SELECT id, loaded_at, 'src_id' ref, 'kg_entities' target, nullif(lower(trim(src_id)), '') key FROM kg_relations
  UNION ALL SELECT id, loaded_at, 'dst_id', 'kg_entities', nullif(lower(trim(dst_id)), '') FROM kg_relations
  UNION ALL SELECT id, loaded_at, 'doc_id', 'kg_docs', nullif(lower(trim(doc_id)), '') FROM kg_relations) WHERE key IS NOT NULL),
o AS (SELECT r.id, r.ref, r.target, r.t, CASE WHEN first_s IS NULL THEN 'missing' WHEN first_s > t THEN 'later' ELSE 'deleted' END state
  FROM r LEFT JOIN g USING (target, key)
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.target = r.target AND e.key = r.key AND e.s <= r.t AND (e.e IS NULL OR e.e > r.t)))
"""

SQL = {
    "p1_found": f"WITH {_P1} SELECT * FROM d WHERE change IS NOT NULL",
    "p1_change_counts": f"""WITH {_P1} SELECT repo_id, snapshot_id, field, count(*) FILTER (change = 'added') n_added,
      count(*) FILTER (change = 'removed') n_removed, count(*) FILTER (change = 'changed') n_changed FROM d WHERE change IS NOT NULL GROUP BY ALL""",
    "p4_found": f"WITH {_P4} SELECT id, ref, state FROM o",
    "p4_orphan_counts": f"WITH {_P4} SELECT target ref_table, ref, coalesce(strftime(t, '%Y-%m'), 'unknown') period, state, count(*) n_orphans FROM o GROUP BY ALL",
}

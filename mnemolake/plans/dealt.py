"""Queries of the general data problems, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators.changefeed import current_entries
from mnemolake.operators.delivery_store import exactly_once, repeated_deliveries
from mnemolake.operators.hierarchy import descendants, hierarchy
from mnemolake.operators.orphans import orphan_counts, orphan_references
from mnemolake.sources.tables import table

CANON = "translate(upper({0}), 'OIL', '011')"
IDS = "list_distinct(list_transform(coalesce({0}, []), lambda x: translate(upper(x), 'OIL', '011')))"


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_references(table(spark, root, "records"))


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphan_counts(p2_found(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_deliveries(table(spark, root, "deliveries"))


def p4_kept(spark: SparkSession, root: str) -> DataFrame:
    return exactly_once(table(spark, root, "deliveries")).select("delivery_no", "space", "id", "author_node", "epoch")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy(table(spark, root, "records")).select("id", "root_id", "depth")


def hierarchy_fragments(spark: SparkSession, root: str) -> DataFrame:
    """The same with fragments so small that several levels of quotients are solved at every size."""
    return hierarchy(table(spark, root, "records"), task_rows=500).select("id", "root_id", "depth")


def p5_paths(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy(table(spark, root, "records"), trails=True).select("id", "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, root: str) -> DataFrame:
    return descendants(hierarchy(table(spark, root, "records"), trails=True)).select("id", "descendant_id", "distance")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return current_entries(table(spark, root, "changes"))


IMAGE = ("kind", "author_node", "author_agent", "author_model", "evidence", "embed_model", "bytes")


def p6_state(spark: SparkSession, root: str) -> DataFrame:
    """The rebuilt table itself: every live entry with the content of its current record."""
    return current_entries(table(spark, root, "changes"), image=IMAGE)


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_counts, p4_found, p4_kept, p5_found, hierarchy_fragments, p5_paths, p5_descendants, p6_found, p6_state)}


_P2 = f"""
WITH r AS (SELECT space, {CANON.format('id')} AS id, kind, received_at AS seen, {IDS.format('supersedes')} AS sup, {IDS.format('refs')} AS ref FROM records WHERE id IS NOT NULL),
e AS (SELECT space, id, seen, 'supersedes' AS field_name, unnest(sup) AS target FROM r UNION ALL SELECT space, id, seen, 'refs', unnest(ref) FROM r),
t AS (SELECT space, id, seen, unnest(sup) AS target FROM r WHERE kind = 'tombstone'),
s AS (SELECT e.id AS from_id, field_name, e.target AS target_id, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.seen > e.seen THEN 'late'
      WHEN EXISTS (SELECT 1 FROM t WHERE t.space = e.space AND t.target = e.target AND t.id <> e.id AND t.seen <= e.seen) THEN 'deleted' END AS status, strftime(e.seen, '%Y-%m-%d') AS received_day
      FROM e LEFT JOIN r p ON p.space = e.space AND p.id = e.target)
"""
_P5 = f"""
WITH RECURSIVE r AS (SELECT space, {CANON.format('id')} AS id, {IDS.format('supersedes')} AS sup FROM records),
e AS (SELECT space, id, unnest(sup) AS target FROM r),
p AS (SELECT e.space, e.id, max(e.target) AS parent FROM e JOIN r k ON k.space = e.space AND k.id = e.target GROUP BY ALL),
n AS (SELECT space, id FROM p UNION SELECT space, parent FROM p),
walk AS (SELECT space, id, id AS cur, 0 AS depth, [id] AS trail, false AS circle FROM n
  UNION ALL SELECT w.space, w.id, p.parent, w.depth + 1, list_append(w.trail, p.parent), list_contains(w.trail, p.parent) FROM walk w JOIN p ON p.space = w.space AND p.id = w.cur WHERE NOT w.circle),
fin AS (SELECT id, cur, depth, trail, circle FROM walk QUALIFY row_number() OVER (PARTITION BY space, id ORDER BY depth DESC) = 1),
f AS (SELECT id, CASE WHEN circle THEN list_min(list_slice(trail, list_position(trail, cur), len(trail))) ELSE cur END AS root_id, CASE WHEN circle THEN -1 ELSE depth END AS depth, CASE WHEN circle THEN [] ELSE list_reverse(trail) END AS path FROM fin)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT DISTINCT from_id, field_name, target_id, status, received_day FROM s WHERE status IS NOT NULL",
        "p2_counts": _P2 + "SELECT field_name, status, received_day, count(*) AS n_refs FROM (SELECT DISTINCT * FROM s) WHERE status IS NOT NULL GROUP BY ALL",
        "p4_found": f"SELECT delivery_no FROM deliveries WHERE id IS NOT NULL AND author_node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {CANON.format('id')}, trim(author_node) ORDER BY received_at NULLS LAST, delivery_no) > 1",
        "p4_kept": f"SELECT delivery_no, space, id, author_node, epoch FROM deliveries QUALIFY id IS NULL OR author_node IS NULL OR row_number() OVER (PARTITION BY {CANON.format('id')}, trim(author_node) ORDER BY received_at NULLS LAST, delivery_no) = 1",
        "p5_found": _P5 + "SELECT id, root_id, CAST(depth AS BIGINT) AS depth FROM f",
        "hierarchy_fragments": _P5 + "SELECT id, root_id, CAST(depth AS BIGINT) AS depth FROM f",
        "p5_paths": _P5 + "SELECT id, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path FROM f",
        "p5_descendants": _P5 + "SELECT path[lvl] AS id, id AS descendant_id, CAST(depth - lvl + 1 AS BIGINT) AS distance FROM (SELECT id, depth, path, unnest(range(1, depth + 1)) AS lvl FROM f WHERE depth > 0)",
        "p6_found": f"""
WITH c AS (SELECT space, {CANON.format('id')} AS id, hlc.wall AS wall, hlc.counter AS counter, kind, {IDS.format('supersedes')} AS named FROM changes),
e AS (SELECT space, unnest(CASE WHEN len(named) = 0 THEN [id] ELSE named END) AS entry_id, id, wall, counter, kind FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY space, entry_id ORDER BY wall DESC, counter DESC, id DESC) AS rn FROM e)
SELECT space, entry_id, id AS current_id FROM l WHERE rn = 1 AND kind NOT IN ('tombstone', 'retraction')""",
        "p6_state": f"""
WITH c AS (SELECT * REPLACE ({CANON.format('id')} AS id), {IDS.format('supersedes')} AS named FROM changes),
e AS (SELECT *, unnest(CASE WHEN len(named) = 0 THEN [id] ELSE named END) AS entry_id FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY space, entry_id ORDER BY hlc.wall DESC, hlc.counter DESC, id DESC, {', '.join(f'{c} DESC NULLS LAST' for c in IMAGE)}) AS rn FROM e)
SELECT space, entry_id, id AS current_id, {', '.join(IMAGE)} FROM l WHERE rn = 1 AND kind NOT IN ('tombstone', 'retraction')""",
    }

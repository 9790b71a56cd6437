"""Registered queries: import edges and the order of migration.

The files are put together from part numbers, so that the SQL side knows who imports whom without reading contents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright.operators import order
from shiftwright.plans.tables import read


def _path(key):
    return F.concat(F.lit("src/a"), key % 7, F.lit("/p"), key, F.lit(".ts"))


def _name(key):
    return F.concat(F.lit("../a"), key % 7, F.lit("/p"), key)


def _files(spark, sf):
    """Every file imports one with about a quarter of its number; some neighbours import each other, or a ring of three."""
    key = F.col("p_partkey")
    place = F.floor(key / 3) % 10
    ring = F.when(place.isin(5, 6), key + 3).when(place == 7, key - 6)
    return read(spark, sf, "part").select(
        F.concat(F.lit("g"), key % 3).alias("project"), _path(key).alias("path"),
        F.concat(
            F.lit("import { A } from '"), _name((F.floor(key / 12) * 3 + key % 3).cast("long")), F.lit("';\nimport x from \"pkg\";\n"),
            F.coalesce(F.concat(F.lit("export * from \""), _name(ring), F.lit(".ts\";\n")), F.lit("")),
            F.lit("const q = require('./none'), t = '"), F.col("p_name"), F.lit("';\n"),
        ).alias("content"),
    )


def import_edges(spark, sf):
    return order.import_edges(_files(spark, sf))


def migration_order(spark, sf):
    return order.migration_order(_files(spark, sf))


QUERIES = {"import_edges": import_edges, "migration_order": migration_order}

_EDGES_SQL = """
k AS (SELECT p_partkey AS k FROM part),
e AS (
  SELECT k, m FROM (
    SELECT k, k // 12 * 3 + k % 3 AS m FROM k UNION
    SELECT k, CASE WHEN k // 3 % 10 IN (5, 6) THEN k + 3 WHEN k // 3 % 10 = 7 THEN k - 6 END FROM k)
  WHERE m <> k AND m IN (SELECT k FROM k)),
p AS (SELECT k, 'g' || k % 3 AS project, 'src/a' || k % 7 || '/p' || k || '.ts' AS path FROM k)"""

ORACLES = {
    "import_edges": f"""WITH {_EDGES_SQL}
SELECT a.project, a.path, b.path AS target FROM e JOIN p a ON a.k = e.k JOIN p b ON b.k = e.m""",
    "migration_order": f"""WITH RECURSIVE {_EDGES_SQL},
reach AS (SELECT k, m FROM e UNION SELECT reach.k, e.m FROM reach JOIN e ON reach.m = e.k),
comp AS (
  SELECT p.k, p.project, p.path, least(p.path, coalesce(min(q.path), p.path)) AS component
  FROM p LEFT JOIN (SELECT a.k, a.m FROM reach a JOIN reach b ON a.k = b.m AND a.m = b.k) c ON c.k = p.k
  LEFT JOIN p q ON q.k = c.m GROUP BY p.k, p.project, p.path),
up AS (
  SELECT DISTINCT a.project, a.component AS c, b.component AS d
  FROM e JOIN comp a ON a.k = e.k JOIN comp b ON b.k = e.m WHERE a.component <> b.component),
deep AS (
  SELECT DISTINCT project, component AS c, 0 AS level FROM comp
  UNION SELECT up.project, up.c, level + 1 FROM deep JOIN up ON up.project = deep.project AND up.d = deep.c)
SELECT project, path, component, (SELECT max(level) FROM deep d WHERE d.project = comp.project AND d.c = comp.component) AS level
FROM comp""",
}

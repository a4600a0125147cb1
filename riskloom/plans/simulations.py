"""Queries of the upgrade simulation: projects of eight pinned packages each, two releases of every package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import simulate as sim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: In SQL that Spark and DuckDB read alike.
PINS = "SELECT concat('app', CAST(CAST(floor(p_partkey / 8e0) AS BIGINT) AS STRING)) AS project, concat('pkg', CAST(p_partkey AS STRING)) AS package, '1.0' AS version FROM {part} WHERE p_partkey % 8 < 7"
UPGRADES = "SELECT concat('app', CAST(CAST(floor(p_partkey / 8e0) AS BIGINT) AS STRING)) AS project, concat('pkg', CAST(p_partkey AS STRING)) AS package, '2.0' AS target_version, p_partkey % 8 AS position FROM {part} WHERE p_partkey % 24 = 0 OR p_partkey % 24 = 9 OR p_partkey % 40 = 5"
RELEASES = "SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package, concat(CAST(v AS STRING), '.0') AS version, CASE WHEN v = 2 AND p_partkey % 74 = 0 THEN '!=3.11.*' WHEN v = 2 AND p_partkey % 37 = 0 THEN '>=3.12' ELSE '~=3.8' END AS python_requires FROM {part} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2) w WHERE p_partkey % 53 > 0"
DIRECT = """SELECT concat('pkg', CAST(p_partkey AS STRING)) AS parent, concat(CAST(v AS STRING), '.0') AS parent_version, concat('pkg', CAST(p_partkey - p_partkey % 8 + CAST(floor((p_partkey % 8) / 3e0) AS BIGINT) AS STRING)) AS dep,
    CASE WHEN v = 2 AND p_partkey % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN '>=2.0' WHEN 1 THEN '~=2.0' WHEN 2 THEN '==2.*' ELSE '>1.5, >2.0rc1' END WHEN p_partkey % 11 = 1 THEN CASE p_partkey % 2 WHEN 0 THEN '<2.0' ELSE '!=2.*' END ELSE '>=1.0' END AS spec, concat(CAST(v AS STRING), '.0') AS dep_version
  FROM {part} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2) w WHERE p_partkey % 8 > 0
  UNION ALL SELECT concat('pkg', CAST(p_partkey AS STRING)), concat(CAST(v AS STRING), '.0'), concat('pkg', CAST(CAST(floor(p_partkey / 5e0) AS BIGINT) AS STRING)), CASE WHEN v = 2 THEN '>=2.0' ELSE '>=1.0' END, concat(CAST(v AS STRING), '.0')
  FROM {part} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2) w WHERE p_partkey % 8 = 0 AND p_partkey > 0"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def simulated(spark: SparkSession, sf: str, wanted: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    return sim.simulate(*(spark.sql(q, part=part) for q in (PINS, UPGRADES, DIRECT, RELEASES)), "3.11", (wanted,))[wanted]


def met(version: str) -> str:
    return f"(CASE WHEN spec IN ('>=2.0', '~=2.0', '==2.*', '>1.5, >2.0rc1') THEN {version} >= '2.0' WHEN spec IN ('<2.0', '!=2.*') THEN {version} < '2.0' ELSE {version} >= '1.0' END)"


def tree(name: str, pins: str) -> str:
    """A tree's nodes and edges as common table expressions; versions here compare as texts."""
    return f"""r_{name}(project, package, version) AS (SELECT project, package, version FROM {pins} UNION SELECT r.project, d.dep, d.dep_version FROM r_{name} r JOIN direct d ON d.parent = r.package AND d.parent_version = r.version),
  n_{name} AS (SELECT r.project, r.package, coalesce(max(p.version), max(r.version)) AS version FROM r_{name} r LEFT JOIN {pins} p USING (project, package) GROUP BY ALL),
  e_{name} AS (SELECT r.project, r.package, d.dep, arg_max(d.spec, r.version) AS spec FROM r_{name} r JOIN direct d ON d.parent = r.package AND d.parent_version = r.version GROUP BY ALL)"""


SIMULATED = f"""WITH RECURSIVE pins AS ({PINS}), ups AS ({UPGRADES}), releases AS ({RELEASES}), direct AS ({DIRECT}), prim AS (SELECT project, arg_min(package, position) AS package FROM ups GROUP BY 1),
  freed AS (SELECT DISTINCT u.project, d.dep AS package FROM ups u JOIN direct d ON d.parent = u.package AND d.parent_version = u.target_version),
  later AS (SELECT project, package, target_version AS version FROM ups UNION ALL SELECT * FROM pins WHERE (project, package) NOT IN (SELECT project, package FROM ups) AND (project, package) NOT IN (SELECT project, package FROM freed)),
  {tree("c", "pins")}, {tree("t", "later")},
  diff AS (SELECT coalesce(c.project, t.project) AS project, coalesce(c.package, t.package) AS package, c.version AS a, t.version AS b FROM n_c c FULL JOIN n_t t ON c.project = t.project AND c.package = t.package WHERE c.version IS DISTINCT FROM t.version),
  moved AS (SELECT * FROM diff WHERE a IS NOT NULL AND b IS NOT NULL AND (project, package) NOT IN (SELECT project, package FROM prim)),
  scope AS (SELECT project, package FROM ups UNION SELECT project, package FROM diff WHERE b IS NOT NULL),
  clash AS (SELECT e.project, e.dep FROM e_t e JOIN n_t n ON n.project = e.project AND n.package = e.dep LEFT JOIN scope s ON s.project = e.project AND s.package = e.package LEFT JOIN scope z ON z.project = e.project AND z.package = e.dep GROUP BY ALL
    HAVING count(*) >= 2 AND NOT bool_and({met("n.version")}) AND bool_or(s.package IS NOT NULL OR z.package IS NOT NULL)),
  blockers AS (SELECT DISTINCT project, package FROM e_t WHERE (project, dep) IN (SELECT project, dep FROM clash) AND (project, package) NOT IN (SELECT project, package FROM prim)),
  steps AS (SELECT * FROM blockers UNION SELECT project, package FROM ups)""".replace("{part}", "part")


@query("upgrade_simulation", f"""{SIMULATED}, apps AS (SELECT project FROM pins UNION SELECT project FROM ups), bad AS (SELECT DISTINCT project, package FROM (SELECT * FROM pins UNION ALL SELECT * FROM later) WHERE (package, version) NOT IN (SELECT package, version FROM releases)),
  wide AS (SELECT project, package FROM pins UNION SELECT * FROM prim UNION SELECT project, package FROM diff WHERE a IS NOT NULL AND b IS NOT NULL), run AS (SELECT n.* FROM n_t n JOIN wide USING (project, package) JOIN releases r ON r.package = n.package AND r.version = n.version WHERE r.python_requires <> '~=3.8'),
  k AS (SELECT project, (SELECT count(*) FROM diff d WHERE d.project = p.project AND a IS NOT NULL AND b IS NOT NULL) AS bumped, (SELECT count(*) FROM diff d WHERE d.project = p.project AND a IS NULL) AS added, (SELECT count(*) FROM diff d WHERE d.project = p.project AND b IS NULL) AS removed,
    (SELECT count(*) FROM clash x WHERE x.project = p.project) AS conflicts, (SELECT count(*) FROM moved x WHERE x.project = p.project) AS chain, (SELECT count(*) FROM steps x WHERE x.project = p.project) AS steps,
    (SELECT count(*) FROM bad x WHERE x.project = p.project) AS unresolved, (SELECT count(*) FROM run x WHERE x.project = p.project) AS runtime_conflicts FROM apps p)
  SELECT *, steps > 0 OR conflicts = 0 AS feasible, CASE WHEN unresolved > 0 THEN 'degraded' ELSE 'ok' END AS status,
    CASE WHEN runtime_conflicts > 0 OR conflicts > 0 AND steps = 0 THEN 'BLOCK_AS_REQUESTED' WHEN conflicts > 0 OR chain > 0 THEN 'PROCEED_AFTER_RESOLUTION' ELSE 'SAFE' END AS verdict FROM k""")
def upgrade_simulation(spark, sf):
    return simulated(spark, sf, "summary")


@query("cascade_chain_ordered", f"""{SIMULATED}, inner_edges AS (SELECT e.project, e.package, e.dep FROM e_t e JOIN moved m ON m.project = e.project AND m.package = e.package JOIN moved d ON d.project = e.project AND d.package = e.dep WHERE e.package <> e.dep),
  far(project, package, layer) AS (SELECT project, package, 0 FROM moved UNION SELECT i.project, i.package, f.layer + 1 FROM far f JOIN inner_edges i ON i.project = f.project AND i.dep = f.package),
  who AS (SELECT m.project, m.package, coalesce(t.package, c.package) AS parent, t.spec AS spec, c.spec AS was, m.a, m.b, p.package AS prim FROM moved m JOIN prim p ON p.project = m.project LEFT JOIN (e_t t FULL JOIN e_c c ON c.project = t.project AND c.package = t.package AND c.dep = t.dep) ON coalesce(t.project, c.project) = m.project AND coalesce(t.dep, c.dep) = m.package),
  ranked AS (SELECT *, CASE WHEN parent = prim AND spec IS DISTINCT FROM was THEN 0 WHEN parent = prim AND {met("b")} AND NOT {met("a")} THEN 1 WHEN spec IS NOT NULL AND {met("b")} AND NOT {met("a")} THEN 2 WHEN spec IS NOT NULL THEN 3 ELSE 4 END AS rank FROM who),
  best AS (SELECT project, package, CASE WHEN min(rank) = 4 THEN any_value(prim) ELSE arg_min(parent, concat(rank, parent)) END AS forced_by FROM ranked GROUP BY ALL)
  SELECT m.project, m.package, a AS from_version, b AS to_version, (SELECT max(layer) FROM far f WHERE f.project = m.project AND f.package = m.package)::INT AS layer, forced_by FROM moved m JOIN best USING (project, package)""")
def cascade_chain(spark, sf):
    return simulated(spark, sf, "chain")


@query("simulated_steps", f"""{SIMULATED}, inside AS (SELECT e.project, e.package, count(*) AS n FROM e_c e JOIN blockers b ON b.project = e.project AND b.package = e.package JOIN blockers d ON d.project = e.project AND d.package = e.dep GROUP BY ALL)
  SELECT b.project, b.package, 'blocker' AS kind, 0 AS part, -coalesce(n, 0) AS place FROM blockers b LEFT JOIN inside USING (project, package) UNION ALL SELECT project, package, 'target', 1, position FROM ups WHERE (project, package) NOT IN (SELECT project, package FROM blockers)""")
def simulated_steps(spark, sf):
    return simulated(spark, sf, "steps")

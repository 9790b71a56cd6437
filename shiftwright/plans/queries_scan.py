"""Registered queries: selection, detection, resolution and rule scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright.catalog import Rule, default_catalog, small_table
from shiftwright.operators import detect, scan
from shiftwright.plans.tables import PAGES_SQL, pages, read

# Rules over web pages whose patterns mean the same to every regex engine.
PAGE_RULES = [
    Rule("script_block", "Inline script", "medium", r"(?s)<script[^>]*>.*?</script>", "", "<script"),
    Rule("style_block", "Inline style sheet", "simple", r"(?s)<style[^>]*>.*?</style>", "", "<style"),
    Rule("nav_block", "Navigation block", "complex", r"(?s)<nav[^>]*>.*?</nav>", "", "<nav"),
    Rule("href", "Link target", "ambiguous", r'href="[^"]*"', None, 'href="'),
    Rule("bold", "Bold element", "simple", r"(?s)<b>.*?</b>", "", "<b>"),
]

_RULE_ROWS = ", ".join(
    f"({i}, '{r.pattern_id}', '{r.classification}', '{r.complexity}', {scan.RANK[r.complexity]})"
    for i, r in enumerate(PAGE_RULES)
)
_FOUND = " UNION ALL ".join(
    f"SELECT project, path, content, {i} AS rule_idx, regexp_extract_all(content, '{r.regex}') AS found, "
    f"string_split_regex(content, '{r.regex}') AS gaps FROM pages_corpus"
    for i, r in enumerate(PAGE_RULES)
)
MATCHES_SQL = f"""
WITH {PAGES_SQL},
rules(rule_idx, pattern_id, classification, complexity, rank) AS (VALUES {_RULE_ROWS}),
found AS ({_FOUND}),
numbered AS (
  SELECT project, path, content, rule_idx, found, gaps, unnest(range(1, len(found) + 1)) AS k FROM found),
placed AS (
  SELECT project, path, content, rule_idx, found[k] AS m,
         (list_sum(list_transform(gaps[1:k], lambda g: length(g)))
          + coalesce(list_sum(list_transform(found[1:k-1], lambda f: length(f))), 0))::BIGINT AS start
  FROM numbered),
lined AS (SELECT *, substr(content, 1, start) AS prefix FROM placed),
matches AS (
  SELECT project, path, rule_idx, pattern_id, classification, complexity, rank, start,
         1 + length(prefix) - length(replace(prefix, chr(10), '')) AS line,
         1 + length(string_split(prefix, chr(10))[-1]) AS "column",
         substr(m, 1, 120) AS snippet
  FROM lined JOIN rules USING (rule_idx))
"""


def _matches(spark, sf):
    return scan.find_matches(pages(spark, sf), PAGE_RULES)


def select_files(spark, sf):
    files = read(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("project"),
        F.regexp_replace("url", "^https?://[^/]+/", "").alias("path"),
        "page_id",
    )
    return scan.select_files(files, [".html", "#top", "/"], ["fr", "node_modules"])


def select_files_by_key(spark, sf):
    framework = F.when(F.col("url").startswith("https:"), "angular").otherwise("react")
    files = read(spark, sf, "pages").select(
        F.regexp_replace("url", "^https?://[^/]+/", "").alias("path"), "page_id",
        framework.alias("framework"), F.lit("site").alias("migration"),
    )
    suffixes = small_table(
        spark,
        [("angular", "site", ".html"), ("angular", "site", "#top"), ("react", "site", "/"), ("react", "other", "feed")],
        "framework STRING, migration STRING, suffix STRING",
    )
    skip = small_table(
        spark, [("angular", "de"), ("react", "fr"), ("react", "en_us")], "framework STRING, dir STRING"
    )
    return scan.select_files_by_key(files, suffixes, skip)


def _project_files(spark, sf):
    """Files of one project per customer; the segment decides what it holds."""
    project = F.concat(F.lit("c"), F.col("c_custkey"))
    segment = F.col("c_mktsegment")

    def file(path: str, content):
        return F.struct(F.lit(path).alias("path"), (content if not isinstance(content, str) else F.lit(content)).alias("content"))

    template = F.concat(F.lit('<p *ngIf="ok">'), F.col("c_name"), F.lit("</p>"))
    files = (
        F.when(segment == "BUILDING", F.array(
            file("package.json", '{"name":"a","devDependencies":{"@angular/core":"17.0.0"},"scripts":{"test":"jest"}}'),
            file("angular.json", "{}"), file("src/main.ts", F.col("c_name"))))
        .when(segment == "MACHINERY", F.array(
            file("package.json", '{"dependencies":{"react":"18.2.0"},"scripts":{"test":"react-scripts test"}}'),
            file("src/app.jsx", F.col("c_name"))))
        .when(segment == "HOUSEHOLD", F.array(
            file("package.json", '{"dependencies": '), file("src/app/a.component.html", template)))
        .when(segment == "AUTOMOBILE", F.array(
            file("package.json", '{"dependencies":{"react":"18.2.0","@angular/core":"17.0.0"}}'),
            file("src/x.ts", F.col("c_name"))))
        .otherwise(F.array(
            file("node_modules/lib/a.html", template), file("pytest.ini", "[pytest]")))
    )
    return read(spark, sf, "customer").select(project.alias("project"), F.inline(files))


def detect_framework(spark, sf):
    facts = detect.with_test_command(detect.project_facts(_project_files(spark, sf), default_catalog()))
    return facts.select("project", "framework", F.array_join("test_command", " ").alias("test_command"))


_PROJECTS_SQL = """
WITH projects AS (
  SELECT 'c' || c_custkey AS project,
    CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'AUTOMOBILE') THEN 'angular'
         WHEN c_mktsegment = 'MACHINERY' THEN 'react' END AS framework,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'npx ng test --watch=false'
      WHEN 'MACHINERY' THEN 'npm test -- --watchAll=false'
      WHEN 'HOUSEHOLD' THEN 'npm test -- --watchAll=false'
      WHEN 'AUTOMOBILE' THEN 'npm test -- --watchAll=false'
      ELSE 'pytest --tb=short' END AS test_command, c_mktsegment AS segment
  FROM customer)
"""


def file_test_commands(spark, sf):
    files = _project_files(spark, sf)
    facts = detect.with_test_command(detect.project_facts(files, default_catalog()))
    # One row per project may be many rows: the join is left to the optimizer.
    return files.select("project", "path").join(facts.select("project", "test_command"), "project").select(
        "project", "path",
        F.array_join(detect.file_test_command(F.col("test_command"), F.col("path")), " ").alias("command"),
    )


def plan_files(spark, sf):
    from shiftwright.plans.migrate import plan_files as plan

    return plan(_project_files(spark, sf), default_catalog()).select("project", "path", "framework", "migration")


def _requests(spark, sf):
    """A migration request per part."""
    names = [
        "angular_control_flow", "control_flow", "react_class_to_hooks",
        "vue_options_api", "standalone-components", "python_f_strings",
    ]
    asked = F.get(F.array(*map(F.lit, names)), F.pmod("p_size", F.lit(6)))
    framework = F.get(F.array(F.lit(None), F.lit("react"), F.lit("Angular"), F.lit("svelte")), F.pmod("p_partkey", F.lit(4)).cast("int"))
    detected = F.when(F.col("p_type") == "ECONOMY", "react").when(F.col("p_type") == "STANDARD", "angular")
    return read(spark, sf, "part").select(
        "p_partkey", asked.alias("migration_type"), framework.alias("framework"), detected.alias("detected")
    )


_REQUESTS_SQL = """
requests AS (
  SELECT p_partkey, p_type,
    ['angular_control_flow', 'control_flow', 'react_class_to_hooks', 'vue_options_api',
     'standalone-components', 'python_f_strings'][(p_size % 6 + 1)::INT] AS migration_type,
    [NULL, 'react', 'Angular', 'svelte'][(p_partkey % 4 + 1)::INT] AS framework,
    CASE p_type WHEN 'ECONOMY' THEN 'react' WHEN 'STANDARD' THEN 'angular' END AS detected
  FROM part)"""


def resolve_migration(spark, sf):
    return detect.resolve_migration(_requests(spark, sf)).select(
        "p_partkey", "resolved_framework", "resolved_migration"
    )


def validate_requests(spark, sf):
    resolved = detect.resolve_migration(_requests(spark, sf)).select(
        "p_partkey", F.col("resolved_framework").alias("framework"),
        # Every other request names no migration and takes the default.
        F.when(F.col("p_partkey") % 2 == 0, F.col("resolved_migration")).alias("migration"),
    )
    return detect.validate_requests(resolved, default_catalog())


_CATALOGUE_ROWS = ", ".join(
    f"({i}, '{fw}', '{mig}', '{name}', {str(d).upper()})"
    for i, (fw, mig, name, _, d) in enumerate(default_catalog().migrations)
)
_RESOLVED_SQL = """
resolved AS (
  SELECT p_partkey,
    coalesce(nullif(regexp_extract(migration_type, '^(angular|react|vue|nextjs|python)_(.*)$', 1), ''),
             framework, detected, 'angular') AS resolved_framework,
    CASE WHEN regexp_matches(migration_type, '^(angular|react|vue|nextjs|python)_')
         THEN regexp_extract(migration_type, '^(angular|react|vue|nextjs|python)_(.*)$', 2)
         ELSE migration_type END AS resolved_migration
  FROM requests)"""


def scan_matches(spark, sf):
    return _matches(spark, sf).withColumn("rule_idx", F.col("rule_idx").cast("bigint"))


def scan_summary(spark, sf):
    return scan.scan_summary(pages(spark, sf), PAGE_RULES)


def file_tasks(spark, sf):
    return scan.file_tasks(pages(spark, sf), PAGE_RULES)


def tasks_from_matches(spark, sf):
    return scan.tasks_from_matches(_matches(spark, sf))


def tasks_without_rules(spark, sf):
    return scan.file_tasks(pages(spark, sf), [], route_unmatched="ambiguous")


def scan_rollup(spark, sf):
    return scan.scan_rollup(_matches(spark, sf))


def first_match(spark, sf):
    return scan.first_applicable(_matches(spark, sf)).withColumn("rule_idx", F.col("rule_idx").cast("bigint"))


def one_pattern(spark, sf):
    found = scan.first_applicable(_matches(spark, sf), "nav_block")
    return found.select("project", "path", "pattern_id", "start", "line", "column")


def scan_json(spark, sf):
    files = pages(spark, sf)
    return scan.scan_documents(scan.find_matches(files, PAGE_RULES), files, "site", "cleanup")


def custom_files(spark, sf):
    """Parts as files of requests that bring their own rules."""
    suffix = F.get(F.array(*map(F.lit, [".html", ".ts", ".js", ".jsx", ".css"])), F.pmod("p_partkey", F.lit(5)).cast("int"))
    files = _requests(spark, sf).select("migration_type", F.concat(F.lit("src/p"), F.col("p_partkey"), suffix).alias("path"))
    return detect.select_custom_files(files, F.col("migration_type"))


QUERIES = {
    "custom_files": custom_files,
    "select_files": select_files,
    "select_files_by_key": select_files_by_key,
    "detect_framework": detect_framework,
    "file_test_commands": file_test_commands,
    "plan_files": plan_files,
    "resolve_migration": resolve_migration,
    "validate_requests": validate_requests,
    "scan_matches": scan_matches,
    "scan_summary": scan_summary,
    "file_tasks": file_tasks,
    "tasks_from_matches": tasks_from_matches,
    "tasks_without_rules": tasks_without_rules,
    "scan_rollup": scan_rollup,
    "first_match": first_match,
    "one_pattern": one_pattern,
    "scan_json": scan_json,
}

_TASKS_SQL = MATCHES_SQL + """
SELECT project, path, CASE WHEN bool_or(classification = 'ambiguous') THEN 'ambiguous' ELSE 'deterministic' END AS strategy,
       ['simple', 'medium', 'complex'][max(rank) + 1] AS complexity
FROM matches GROUP BY project, path"""

ORACLES = {
    "custom_files": f"""WITH {_REQUESTS_SQL},
f AS (SELECT migration_type, ['.html', '.ts', '.js', '.jsx', '.css'][(p_partkey % 5 + 1)::INT] AS suffix, p_partkey FROM requests)
SELECT migration_type, 'src/p' || p_partkey || suffix AS path FROM f
WHERE CASE WHEN migration_type LIKE '%angular%' THEN suffix = '.html'
           WHEN migration_type LIKE '%react%' THEN suffix IN ('.jsx', '.js', '.ts') ELSE suffix IN ('.html', '.ts', '.js') END""",
    "select_files": r"""
WITH f AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project,
         regexp_replace(url, '^https?://[^/]+/', '') AS path, page_id FROM pages)
SELECT * FROM f
WHERE (path LIKE '%.html' OR path LIKE '%#top' OR path LIKE '%/')
  AND NOT list_has_any(string_split(path, '/')[1:-2], ['fr', 'node_modules'])""",
    "select_files_by_key": r"""
WITH f AS (
  SELECT regexp_replace(url, '^https?://[^/]+/', '') AS path, page_id,
         CASE WHEN url LIKE 'https:%' THEN 'angular' ELSE 'react' END AS framework, 'site' AS migration FROM pages)
SELECT * FROM f
WHERE CASE framework
  WHEN 'angular' THEN (path LIKE '%.html' OR path LIKE '%#top') AND NOT list_contains(string_split(path, '/')[1:-2], 'de')
  ELSE path LIKE '%/' AND NOT list_has_any(string_split(path, '/')[1:-2], ['fr', 'en_us']) END""",
    "detect_framework": _PROJECTS_SQL + "SELECT project, framework, test_command FROM projects",
    "file_test_commands": _PROJECTS_SQL + """,
paths(segment, path) AS (VALUES
  ('BUILDING', 'package.json'), ('BUILDING', 'angular.json'), ('BUILDING', 'src/main.ts'),
  ('MACHINERY', 'package.json'), ('MACHINERY', 'src/app.jsx'),
  ('HOUSEHOLD', 'package.json'), ('HOUSEHOLD', 'src/app/a.component.html'),
  ('AUTOMOBILE', 'package.json'), ('AUTOMOBILE', 'src/x.ts'),
  ('FURNITURE', 'node_modules/lib/a.html'), ('FURNITURE', 'pytest.ini'))
SELECT project, path, test_command
  || CASE WHEN segment = 'BUILDING' THEN ' --include=**/' || string_split(path, '/')[-1] ELSE '' END AS command
FROM projects JOIN paths USING (segment)""",
    "plan_files": """
SELECT 'c' || c_custkey AS project, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'src/app/a.component.html' ELSE 'src/app.jsx' END AS path,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'angular' ELSE 'react' END AS framework,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'control_flow' ELSE 'class_to_hooks' END AS migration
FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')""",
    "resolve_migration": f"WITH {_REQUESTS_SQL}, {_RESOLVED_SQL} SELECT * FROM resolved",
    "validate_requests": f"""
WITH {_REQUESTS_SQL}, {_RESOLVED_SQL},
catalogue(idx, framework, id, display_name, is_default) AS (VALUES {_CATALOGUE_ROWS}),
defaults AS (
  SELECT framework, id FROM catalogue
  QUALIFY row_number() OVER (PARTITION BY framework ORDER BY is_default DESC, idx) = 1),
asked AS (
  SELECT p_partkey, lower(resolved_framework) AS fw, resolved_framework AS given,
         CASE WHEN p_partkey % 2 = 0 THEN replace(resolved_migration, '-', '_') END AS mig FROM resolved)
SELECT p_partkey, coalesce(d.framework, given) AS framework, coalesce(mig, d.id) AS migration, c.display_name,
  CASE WHEN d.framework IS NULL THEN 'unknown framework' WHEN c.id IS NULL THEN 'unknown migration' END AS error
FROM asked LEFT JOIN defaults d ON fw = d.framework
LEFT JOIN catalogue c ON c.framework = d.framework AND c.id = coalesce(mig, d.id)""",
    "scan_matches": MATCHES_SQL + """
SELECT project, path, rule_idx::BIGINT AS rule_idx, pattern_id, classification, complexity, start, line, "column", snippet
FROM matches""",
    "scan_summary": MATCHES_SQL + """
SELECT f.project, f.files_scanned, coalesce(m.n, 0) AS patterns_found, coalesce(m.det, 0) AS deterministic_count,
       coalesce(m.amb, 0) AS ambiguous_count
FROM (SELECT project, count(*) AS files_scanned FROM pages_corpus GROUP BY project) f
LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (classification = 'deterministic') AS det,
                  count(*) FILTER (classification = 'ambiguous') AS amb FROM matches GROUP BY project) m USING (project)""",
    "file_tasks": _TASKS_SQL,
    "tasks_from_matches": _TASKS_SQL,
    "tasks_without_rules": f"WITH {PAGES_SQL} SELECT project, path, 'ambiguous' AS strategy, 'simple' AS complexity FROM pages_corpus",
    "scan_rollup": MATCHES_SQL + """
SELECT project, path, count(*) AS matches, count(*) FILTER (classification = 'ambiguous') AS ambiguous,
       grouping(project, path)::BIGINT AS level
FROM matches GROUP BY ROLLUP (project, path)""",
    "first_match": MATCHES_SQL + """
SELECT project, path, rule_idx::BIGINT AS rule_idx, pattern_id, classification, complexity, start, line, "column", snippet
FROM matches WHERE classification = 'deterministic'
QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY start, rule_idx) = 1""",
    "one_pattern": MATCHES_SQL + """
SELECT project, path, pattern_id, start, line, "column" FROM matches WHERE pattern_id = 'nav_block'
QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY start, rule_idx) = 1""",
    "scan_json": MATCHES_SQL + """,
totals AS (SELECT project, count(*) AS total_files_scanned FROM pages_corpus GROUP BY project),
counts AS (
  SELECT project, count(*) AS n, count(*) FILTER (classification = 'deterministic') AS det,
         count(*) FILTER (classification = 'ambiguous') AS amb
  FROM matches GROUP BY project),
per_file AS (
  SELECT project, path,
    list({'file_path': path, 'line': line, 'column': "column", 'pattern_id': pattern_id,
          'classification': classification, 'complexity': complexity, 'snippet': snippet}
         ORDER BY start, rule_idx) AS results
  FROM matches GROUP BY project, path)
SELECT project, path, to_json({'project_path': project, 'migration_type': 'cleanup', 'framework': 'site',
    'results': results})::VARCHAR AS document FROM per_file
UNION ALL
SELECT project, NULL, to_json({'project_path': project, 'migration_type': 'cleanup', 'framework': 'site',
    'total_files_scanned': total_files_scanned, 'total_patterns_found': coalesce(n, 0),
    'deterministic_count': coalesce(det, 0), 'ambiguous_count': coalesce(amb, 0)})::VARCHAR
FROM totals LEFT JOIN counts USING (project)""",
}

"""Table schemas, as DDL strings."""

FILES = "project STRING, path STRING, content STRING"

MATCHES = (
    "project STRING, path STRING, rule_idx INT, pattern_id STRING, classification STRING, "
    "complexity STRING, start BIGINT, line BIGINT, `column` BIGINT, snippet STRING"
)

TASKS = "project STRING, path STRING, strategy STRING, complexity STRING"

CHECKS = (
    "run_id STRING, project STRING, path STRING, attempt INT, stage STRING, "
    "passed BOOLEAN, errors ARRAY<STRING>"
)

TESTS = (
    "run_id STRING, project STRING, path STRING, attempt INT, passed BOOLEAN, "
    "total INT, failed INT, logs STRING"
)

MANIFEST = (
    "name STRING, dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, "
    "scripts MAP<STRING,STRING>"
)

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"

REPORT_FILE = (
    "STRUCT<file: STRING, strategy: STRING, confidence_score: DOUBLE, "
    "validation: STRUCT<ast: STRING, type_check: STRING, lint: STRING, "
    "secrets_scan: STRING, tests: STRING>, retry_count: INT, failure_category: STRING, "
    "human_review_required: BOOLEAN, trace_url: STRING>"
)

REPORT_SUMMARY = (
    "STRUCT<total_files: INT, auto_approved: INT, flagged_for_review: INT, "
    "avg_confidence: DOUBLE, time_saved_estimate_hours: DOUBLE>"
)

REPORTS = (
    "run_id STRING, timestamp STRING, project STRING, framework STRING, migration_type STRING, "
    f"part INT, files ARRAY<{REPORT_FILE}>, summary {REPORT_SUMMARY}"
)

"""Registered queries: reports, tickets, history, and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright.catalog import default_catalog
from shiftwright.operators import report
from shiftwright.plans import migrate
from shiftwright.plans.queries_checks import (
    _SCORE_SQL, _all_checks, _attempts, _decided,
)
from shiftwright.plans.queries_rewrite import _tagged, cat
from shiftwright.plans.queries_rewrite import _DIFF_SQL
from shiftwright.plans.tables import ORDERS_SQL, order_files, read
from shiftwright.operators.diff import diff_text, line_diff
from shiftwright.session import cut, shared_path
from shiftwright.sources import files, sinks


def _stages(spark, sf):
    """What the checks of every document found, for its outcome and its record. Written once."""
    return cut(_all_checks(spark, sf), "stages")


def _results(spark, sf, stages=None):
    """Outcome per document: score, category and whether it completed. Written once."""
    decided = _decided(spark, sf, stages).withColumns({
        "completed": F.col("approved"),
        "failure_category": F.when(~F.col("approved"), F.col("failure_category")),
        "retry_count": F.when(F.col("approved"), 0).otherwise(3),
    })
    return cut(decided.drop("approved"), "results")


def _records(results, stages):
    return report.file_records(results, stages.drop("attempt"))


def _runs(spark, sf):
    """One row per run; its time and project come from its documents."""
    return _attempts(spark, sf).groupBy("run_id").agg(F.max("project").alias("project")).select(
        "run_id", F.lit("2026-01-02T03:04:05").alias("timestamp"), "project",
        F.lit("angular").alias("framework"), F.lit("control_flow").alias("migration_type"),
    )


def report_files(spark, sf):
    stages = _stages(spark, sf)
    return _records(_results(spark, sf, stages), stages).select(
        "run_id", "file", "strategy", "confidence_score", "validation.*",
        F.col("retry_count").cast("bigint").alias("retry_count"), "failure_category", "human_review_required", "trace_url",
    )


def report_summary(spark, sf):
    return report.summaries(_results(spark, sf))


def run_totals(spark, sf):
    return report.run_totals(_results(spark, sf))


def live_counts(spark, sf):
    return report.live_counts(_results(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


def report_markdown(spark, sf):
    stages = _stages(spark, sf)
    results = _results(spark, sf, stages)
    return report.markdown_lines(_runs(spark, sf), _records(results, stages), report.summaries(results)).select(
        "run_id", F.col("section").cast("bigint").alias("section"), "item", F.col("nth").cast("bigint").alias("nth"), "line"
    )


def _stored(spark, sf):
    """Reports written to the shared folder and read back."""
    stages = _stages(spark, sf)
    results = _results(spark, sf, stages)
    path = shared_path(spark, "reports")
    sinks.write_reports(report.report_documents(_runs(spark, sf), _records(results, stages), report.summaries(results)), path)
    return files.read_reports(spark, path)


def report_documents(spark, sf):
    """Stored reports, read back: a row per file and a row per run."""
    return _stored(spark, sf).select("run_id", "summary.total_files", "summary.avg_confidence", F.explode_outer("files").alias("f")).select(
        "run_id", F.col("total_files").cast("bigint").alias("total_files"), "avg_confidence",
        F.col("f.file").alias("file"), F.col("f.validation.tests").alias("tests"), F.col("f.human_review_required").alias("review"),
    )


def stored_report(spark, sf):
    shown = report.stored_records(_stored(spark, sf))
    return shown.withColumn("retry_count", F.col("retry_count").cast("bigint"))


def tickets(spark, sf):
    escalated = _results(spark, sf).filter(~F.col("completed")).withColumn("diff", F.lit(None).cast("string"))
    return report.tickets(escalated).select("run_id", "path", "ticket", "body")


def tickets_with_diff(spark, sf):
    diffs = diff_text(line_diff(_tagged(spark, sf)))
    escalated = diffs.select(
        F.lit("run_x").alias("run_id"), "project", F.concat(F.lit("sites/"), F.col("path")).alias("path"),
        F.lit(55.5).alias("confidence_score"), F.lit("ambiguous").alias("strategy"),
        F.array(F.lit("one"), F.lit("two")).alias("errors"), F.lit("").alias("test_logs"), "diff",
    )
    return report.tickets(escalated).select("path", "ticket", "body")


def run_history(spark, sf):
    """Customers as projects, order days as runs."""
    totals = read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("at"),
        F.lit(1).cast("bigint").alias("total_files"),
        (F.col("o_orderstatus") == "F").cast("bigint").alias("auto_approved"),
        (F.col("o_orderstatus") != "F").cast("bigint").alias("flagged_for_review"),
    )
    return report.run_history(totals, ["project"], F.to_date("at")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def run_metrics(spark, sf):
    from shiftwright.operators import score
    from shiftwright.plans.queries_checks import _steps

    routed = score.retry_routing(_steps(spark, sf), ["user_id"], ["ts", "event_id"])
    per_month = routed.withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    # A failure of a file that was approved is taken for the fix that it needed.
    fixes = _steps(spark, sf).where("NOT passed")
    metrics = report.run_metrics(per_month, fixes, ["user_id"], ["ts", "event_id"])
    rates = ["automatic_rate", "review_rate", "retry_success_rate", "false_confidence_rate"]
    return metrics.select("run_id", "files", *[F.round(r, 6).alias(r) for r in rates])


# -- a whole run over templates made from orders --------------------------------------


def _run_files(spark, sf):
    def content(key, total, status):
        return cat(
            F.when(status == "F", cat('<p *ngIf="a">', key, "</p>"))
            .when(status == "O", cat('<p *ngIf="a$ | async as a">', key, "</p>"))
            .otherwise(cat('<p *ngIf="b; else gone">', key, "</p>")),
            F.when(F.col("o_orderkey") % 11 == 0, cat("AKIA", F.lpad(key, 16, "0"))).otherwise(""),
        )

    return order_files(spark, sf, content)


def _canned_model():
    """Stands in for a model: aliases move behind a semicolon.

    A function made here travels to the workers by value, without this package.
    """
    def model(prompts):
        answers = []
        for messages in prompts:
            text = messages[-1][1].split("\n", 1)[1]
            key = text.split(">", 1)[1].replace("</p>", "")
            answers.append(f"```html\n@if (a$ | async; as a) {{\n  <p>{key}</p>\n}}\n```")
        return answers

    return model


def migrate_records(spark, sf):
    run = migrate.Run("run_orders", "angular", "control_flow", max_retries=1)
    tables = migrate.migrate(_run_files(spark, sf), default_catalog(), run, _canned_model())
    texts = tables["texts"].select("project", "path", "after")
    return tables["records"].join(texts, ["project", "path"]).select(
        "project", "path", "strategy", "confidence_score", F.col("validation.ast").alias("ast"),
        F.col("validation.secrets_scan").alias("secrets_scan"), F.col("retry_count").cast("bigint").alias("retry_count"),
        "failure_category", "human_review_required", "after",
    )


def migrate_dry_run(spark, sf):
    run = migrate.Run("run_orders", "angular", "control_flow")
    planned = migrate.dry_run(_run_files(spark, sf), default_catalog(), run)
    return planned.select("project", "path", "strategy", "complexity", "confidence_score", "completed")


# -- one run over customers whose projects show different frameworks -------------------


def _mixed_catalog():
    """The built-in frameworks, and one whose rules are replacements."""
    from shiftwright.catalog import Rule

    catalog = default_catalog()
    catalog.register_framework(
        "classic", "Classic", [("modern", "Modern", "From say to tell", True)],
        lambda: F.bool_or(F.col("path") == "classic.json"), {"*": [".cls"]}, prompts={"*": "Rewrite.\n{context}"},
    )
    catalog.register_rule("classic", "modern", Rule("say", "say becomes tell", "simple", r"\bsay\(", "tell(", "say("))
    catalog.register_rule("classic", "modern", Rule("old", "needs a model", "ambiguous", r"\bold\b", None, "old"))
    return catalog


def _mixed_files(spark, sf):
    """A file per order; its customer is the project and has a manifest. Every text holds what other frameworks' rules match."""
    kind = F.col("o_custkey") % 4
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    project = cat("c", F.col("o_custkey").cast("string")).alias("project")
    orders = read(spark, sf, "orders")
    template = F.when(status == "F", cat('<p *ngIf="a">say(', key, ")</p>")).when(
        status == "O", cat('<p *ngIf="a$ | async as a">old ', key, "</p>")).otherwise(cat("<p>", key, "</p>"))
    classic = F.when(status == "F", cat("say(say(", key, '))<b [ngSwitch]="s"></b>')).when(
        status == "O", cat("say(old ", key, ")")).otherwise(cat("told ", key))
    sources = orders.select(
        project,
        F.when(kind == 0, cat("src/app/o", key, ".component.html")).when(kind == 1, cat("src/o", key, ".jsx"))
        .otherwise(cat("src/o", key, ".cls")).alias("path"),
        F.when(kind == 0, template).when(kind == 1, cat("say(old ", key, ")")).otherwise(classic).alias("content"),
    )
    manifests = orders.select("o_custkey").distinct().filter(kind < 3).select(
        project, F.when(kind == 2, "classic.json").otherwise("package.json").alias("path"),
        F.when(kind == 0, '{"dependencies": {"@angular/core": "1"}}').when(kind == 1, '{"dependencies": {"react": "1"}}')
        .otherwise("{}").alias("content"),
    )
    return sources.unionByName(manifests)


def _plain_model():
    """Stands in for a model: the text of the file without asterisks, behind a mark."""
    def model(prompts):
        return ["done " + messages[-1][1].split("\n", 1)[1].replace("*", "") for messages in prompts]

    return model


def migrate_projects(spark, sf):
    run = migrate.Run("run_mixed", max_retries=1, route_unmatched="ambiguous")
    tables = migrate.migrate_projects(_mixed_files(spark, sf), _mixed_catalog(), run, _plain_model())
    texts = tables["texts"].select("project", "path", "after")
    return tables["records"].join(texts, ["project", "path"]).join(tables["projects"], "project").select(
        "project", "path", "framework", "migration", "strategy", "confidence_score",
        F.col("retry_count").cast("bigint").alias("retry_count"), "failure_category", "human_review_required", "after",
    )


QUERIES = {
    "migrate_projects": migrate_projects,
    "report_files": report_files,
    "report_summary": report_summary,
    "run_totals": run_totals,
    "live_counts": live_counts,
    "report_markdown": report_markdown,
    "report_documents": report_documents,
    "stored_report": stored_report,
    "tickets": tickets,
    "tickets_with_diff": tickets_with_diff,
    "run_history": run_history,
    "run_metrics": run_metrics,
    "migrate_records": migrate_records,
    "migrate_dry_run": migrate_dry_run,
}

_RESULTS_SQL = _SCORE_SQL + """,
results_all AS (
  SELECT *, (CASE strategy WHEN 'deterministic' THEN 40 ELSE 0 END + CASE WHEN ast = '' THEN 10 ELSE 0 END
    + CASE WHEN ast = '' AND type_ok THEN 15 ELSE 0 END + CASE WHEN ast = '' AND type_ok AND lint_ok THEN 10 ELSE 0 END
    + CASE WHEN va = '' THEN 5 ELSE 0 END + CASE WHEN tests_ok THEN 20 ELSE 0 END)::DOUBLE AS score FROM classified),
r AS (SELECT *, score >= 90 AS completed FROM results_all),
totals AS (
  SELECT run_id, count(*) AS total_files, count(*) FILTER (completed) AS auto_approved, count(*) FILTER (NOT completed) AS flagged_for_review,
    round_even(avg(score), 1) AS avg_confidence, round_even(count(*) FILTER (completed) * 15 / 60, 2) AS time_saved_estimate_hours,
    avg(score) AS raw_avg, max(project) AS project
  FROM r GROUP BY run_id)
"""

_DIGIT = "printf('%.1f', round_even({0}, 1))"
_HEAD = [
    "'# Migration Report — `' || run_id || '`'", "''", "'**Timestamp:** 2026-01-02T03:04:05  '",
    "'**Project:** `' || project || '`  '", "'**Migration:** `control_flow`'", "''", "'## Summary'", "''",
    "'| Metric | Value |'", "'|---|---|'", "'| Total files | ' || total_files || ' |'",
    "'| Auto-approved (≥90) | ' || auto_approved || ' |'", "'| Flagged for review | ' || flagged_for_review || ' |'",
    f"'| Avg confidence | ' || {_DIGIT.format('avg_confidence')} || ' |'",
    f"'| Estimated time saved | ' || {_DIGIT.format('time_saved_estimate_hours')} || ' h |'",
    "''", "'## File Details'", "''", "'| File | Strategy | Confidence | Status |'", "'|---|---|---|---|'",
]
_REVIEW_HEAD = [
    "''", "'## Review Required'", "''",
    "'The following files need human review (see `reports/' || run_id || '/review/`):'", "''",
]


def _line_rows(lines: list, section: int, where: str) -> str:
    items = ", ".join(lines)
    return (
        f"SELECT run_id, {section}::BIGINT AS section, '' AS item, unnest(range(0, {len(lines)})) AS nth, unnest([{items}]) AS line "
        f"FROM totals {where}"
    )


_SCORE_TEXT = "printf('%.1f', score)"

ORACLES = {
    "report_files": _RESULTS_SQL + """
SELECT run_id, path AS file, strategy, round_even(score, 1) AS confidence_score,
  CASE WHEN ast = '' THEN 'pass' ELSE 'fail' END AS ast,
  CASE WHEN ast <> '' THEN NULL WHEN type_ok THEN 'pass' ELSE 'fail' END AS type_check,
  CASE WHEN ast <> '' OR NOT type_ok THEN NULL WHEN lint_ok THEN 'pass' ELSE 'fail' END AS lint,
  CASE WHEN sec = '' THEN 'pass' ELSE 'fail' END AS secrets_scan, NULL::VARCHAR AS tests,
  (CASE WHEN completed THEN 0 ELSE 3 END)::BIGINT AS retry_count, CASE WHEN NOT completed THEN category END AS failure_category,
  NOT completed AS human_review_required, NULL::VARCHAR AS trace_url
FROM r""",
    "report_summary": _RESULTS_SQL + """
SELECT run_id, total_files, auto_approved, flagged_for_review, avg_confidence, time_saved_estimate_hours FROM totals""",
    "run_totals": _RESULTS_SQL + """
SELECT run_id, total_files, auto_approved AS successful_files, flagged_for_review AS escalated_files,
       auto_approved * 15 AS estimated_time_saved_minutes FROM totals""",
    "live_counts": _RESULTS_SQL + """
SELECT run_id, total_files AS processed, auto_approved, flagged_for_review AS flagged, round(raw_avg, 6) AS avg_confidence FROM totals""",
    "report_markdown": _RESULTS_SQL + f"""
{_line_rows(_HEAD, 1, '')} UNION ALL
{_line_rows(_REVIEW_HEAD, 3, 'WHERE flagged_for_review > 0')} UNION ALL
SELECT run_id, 2, CASE WHEN completed THEN '0/' ELSE '1/' END || project || '/' || path, 0,
  '| `' || path || '` | ' || strategy || ' | ' || {_SCORE_TEXT} || ' | '
  || CASE WHEN completed THEN '✅ Auto-approved' ELSE '⚠️ Review required' END || ' |' FROM r UNION ALL
SELECT run_id, 4, '1/' || project || '/' || path, 0,
  '- `' || path || '` (confidence ' || {_SCORE_TEXT} || ', ' || category || ')' FROM r WHERE NOT completed""",
    "report_documents": _RESULTS_SQL + """
SELECT run_id, NULL::BIGINT AS total_files, NULL::DOUBLE AS avg_confidence, path AS file, NULL::VARCHAR AS tests,
  NOT completed AS review FROM r
UNION ALL SELECT run_id, total_files, avg_confidence, NULL, NULL, NULL FROM totals""",
    "stored_report": _RESULTS_SQL + """
SELECT run_id, path AS file, strategy, round_even(score, 1) AS confidence_score,
  (CASE WHEN completed THEN 0 ELSE 3 END)::BIGINT AS retry_count, CASE WHEN completed THEN 'Approved' ELSE 'Review' END AS status
FROM r""",
    "tickets": _RESULTS_SQL + f"""
SELECT run_id, path, 'REVIEW_' || path || '.md' AS ticket,
  '# Migration Review Required: `' || path || '`' || chr(10) || chr(10) || '**Confidence Score:** ' || {_SCORE_TEXT} || '/100' || chr(10)
  || '**Strategy Used:** ' || strategy || chr(10) || chr(10) || '## Validation Errors' || chr(10)
  || CASE WHEN shown_errors = '' THEN 'None' ELSE '- ' || replace(shown_errors, '|', chr(10) || '- ') END
  || chr(10) || chr(10) || '## Test Output' || chr(10) || '```text' || chr(10)
  || CASE WHEN ran AND NOT tests_ok THEN 'FAIL ' || path || chr(10) || repeat('at line' || chr(10), 40) || path || chr(10)
          WHEN ran THEN 'ok' ELSE '[SKIPPED] Could not determine test command for this project.' END
  || chr(10) || '```' || chr(10) || chr(10) || '## Proposed Diff' || chr(10) || '```diff' || chr(10) || 'No changes proposed.' || chr(10) || '```' || chr(10) AS body
FROM r WHERE NOT completed""",
    "tickets_with_diff": _DIFF_SQL + """,
d AS (
  SELECT path, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || string_agg(
    CASE change WHEN 'removed' THEN '-' ELSE '+' END || text, chr(10)
    ORDER BY coalesce(before_line, after_line), change = 'added', text) AS diff
  FROM diff WHERE change <> 'kept' GROUP BY project, path)
SELECT 'sites/' || path AS path, 'REVIEW_sites_' || path || '.md' AS ticket,
  '# Migration Review Required: `sites/' || path || '`' || chr(10) || chr(10) || '**Confidence Score:** 55.5/100' || chr(10)
  || '**Strategy Used:** ambiguous' || chr(10) || chr(10) || '## Validation Errors' || chr(10) || '- one' || chr(10) || '- two'
  || chr(10) || chr(10) || '## Test Output' || chr(10) || '```text' || chr(10) || 'No tests run / passed.' || chr(10) || '```' || chr(10) || chr(10)
  || '## Proposed Diff' || chr(10) || '```diff' || chr(10) || diff || chr(10) || '```' || chr(10) AS body
FROM d""",
    "run_history": """
WITH daily AS (
  SELECT o_orderpriority AS project, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS runs, count(*) AS total_files,
    count(*) FILTER (o_orderstatus = 'F') AS auto_approved, count(*) FILTER (o_orderstatus <> 'F') AS flagged_for_review
  FROM orders GROUP BY 1, 2)
SELECT *, auto_approved - lag(auto_approved) OVER (PARTITION BY project ORDER BY day) AS approved_change FROM daily""",
    "run_metrics": """
WITH s AS (
  SELECT event_id, user_id, ts, event_type <> 'error' AS passed,
    event_type = 'error' AND (props->>'$.k')::INT % 5 = 0 AS secret FROM events),
n AS (
  SELECT *, row_number() OVER w AS attempt,
    coalesce(bool_or(passed OR secret) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS decided
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, attempt, user_id, ts, event_id,
    CASE WHEN decided OR attempt > 4 THEN 'closed' WHEN passed THEN 'approve' WHEN secret THEN 'escalate'
         WHEN attempt <= 3 THEN 'retry' ELSE 'escalate' END AS action FROM n),
late AS (
  SELECT a.event_id, any_value(a.run_id) AS run_id FROM a JOIN s ON s.user_id = a.user_id AND NOT s.passed
    AND (s.ts, s.event_id) > (a.ts, a.event_id) WHERE action = 'approve' GROUP BY a.event_id),
l AS (SELECT run_id, count(*) AS fixed FROM late GROUP BY run_id),
g AS (
  SELECT run_id, count(*) FILTER (action IN ('approve', 'escalate')) AS files, count(*) FILTER (action = 'approve') AS ok,
    count(*) FILTER (action IN ('approve', 'escalate') AND attempt > 1) AS retried,
    count(*) FILTER (action = 'approve' AND attempt > 1) AS retried_ok FROM a GROUP BY run_id)
SELECT run_id, files, round(ok / nullif(files, 0), 6) AS automatic_rate, round((files - ok) / nullif(files, 0), 6) AS review_rate,
       round(retried_ok / nullif(retried, 0), 6) AS retry_success_rate,
       round(CASE WHEN ok > 0 THEN coalesce(fixed, 0) / ok END, 6) AS false_confidence_rate
FROM g LEFT JOIN l USING (run_id)""",
    "migrate_records": f"""
WITH {ORDERS_SQL},
t AS (SELECT *, k::BIGINT % 11 = 0 AS secret, CASE WHEN k::BIGINT % 11 = 0 THEN 'AKIA' || lpad(k, 16, '0') ELSE '' END AS tail FROM o)
SELECT project, path, CASE s WHEN 'O' THEN 'ambiguous' ELSE 'deterministic' END AS strategy,
  (CASE WHEN secret THEN 0 WHEN s = 'F' THEN 100 WHEN s = 'O' THEN 60 ELSE 65 END)::DOUBLE AS confidence_score,
  CASE WHEN s IN ('F', 'O') THEN 'pass' ELSE 'fail' END AS ast, CASE WHEN secret THEN 'fail' ELSE 'pass' END AS secrets_scan,
  (CASE WHEN secret OR s = 'F' THEN 0 ELSE 1 END)::BIGINT AS retry_count,
  CASE WHEN secret THEN 'secrets_detected' WHEN s = 'F' THEN NULL WHEN s = 'O' THEN 'unknown' ELSE 'syntax_failure' END AS failure_category,
  secret OR s <> 'F' AS human_review_required,
  CASE s WHEN 'F' THEN '@if (a) {{' || chr(10) || '  <p>' || k || '</p>' || chr(10) || '}}' || tail
         WHEN 'O' THEN '@if (a$ | async; as a) {{' || chr(10) || '  <p>' || k || tail || '</p>' || chr(10) || '}}'
         ELSE '@if (b) {{' || chr(10) || '  <p>' || k || '</p>' || chr(10) || '}} @else {{' || chr(10)
              || '  <!-- WARNING: ng-template #gone not found -->' || chr(10) || '}}' || tail END AS after
FROM t""",
    "migrate_dry_run": f"""
WITH {ORDERS_SQL}
SELECT project, path, CASE s WHEN 'O' THEN 'ambiguous' ELSE 'deterministic' END AS strategy,
  CASE WHEN s IN ('F', 'O') THEN 'simple' ELSE 'medium' END AS complexity,
  (CASE s WHEN 'O' THEN 40 ELSE 90 END)::DOUBLE AS confidence_score, s <> 'O' AS completed FROM o""",
    "migrate_projects": """
WITH f AS (
  SELECT 'c' || o_custkey AS project, (o_custkey % 4)::INT AS kind, o_orderkey::VARCHAR AS k, o_orderstatus AS s FROM orders
  WHERE o_custkey % 4 < 3),
t AS (
  SELECT *, kind <> 1 AND s = 'F' AS direct,
    CASE kind WHEN 0 THEN CASE s WHEN 'F' THEN '' WHEN 'O' THEN '<p ngIf="a$ | async as a">old ' || k || '</p>' ELSE '<p>' || k || '</p>' END
      WHEN 1 THEN 'say(old ' || k || ')'
      ELSE CASE s WHEN 'O' THEN 'say(old ' || k || ')' ELSE 'told ' || k END END AS asked FROM f)
SELECT project,
  CASE kind WHEN 0 THEN 'src/app/o' || k || '.component.html' WHEN 1 THEN 'src/o' || k || '.jsx' ELSE 'src/o' || k || '.cls' END AS path,
  ['angular', 'react', 'classic'][kind + 1] AS framework, ['control_flow', 'class_to_hooks', 'modern'][kind + 1] AS migration,
  CASE WHEN direct THEN 'deterministic' ELSE 'ambiguous' END AS strategy,
  CASE WHEN direct THEN 100 ELSE 60 END::DOUBLE AS confidence_score, CASE WHEN direct THEN 0 ELSE 1 END::BIGINT AS retry_count,
  CASE WHEN NOT direct THEN 'unknown' END AS failure_category, NOT direct AS human_review_required,
  CASE WHEN NOT direct THEN 'done ' || asked
       WHEN kind = 0 THEN '@if (a) {' || chr(10) || '  <p>say(' || k || ')</p>' || chr(10) || '}'
       ELSE 'tell(tell(' || k || '))<b [ngSwitch]="s"></b>' END AS after
FROM t""",
}

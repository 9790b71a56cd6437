"""Registered queries: checks, scores, failure texts, routing and merged state."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.catalog import default_catalog
from shiftwright.operators import checks, score, state
from shiftwright.plans.tables import DOCUMENTS_SQL, ORDERS_SQL, PAGES_SQL, documents, order_files, pages, read
from shiftwright.session import cut
from shiftwright.sources.sinks import run_id

VERIFY = [c for c in checks.BUILT_IN if c.stage != "SecretsScan"]
SECRETS = [c for c in checks.BUILT_IN if c.stage == "SecretsScan"]


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rewritten(key, total, status):
    """Rewritten text per order: O keeps a directive, P lacks a brace, every 7th a marker."""
    return _cat(
        F.when(status == "F", "@if (a) {").when(status == "O", "@if(a) {").otherwise("@if (a) "),
        F.when(status == "O", '<b *ngFor="let x of xs">').otherwise("<b>"), key, "</b>}",
        F.when(F.col("o_orderkey") % 7 == 0, "<!-- WARNING: ng-template #x not found -->").otherwise(""),
        F.when(F.col("o_orderkey") % 11 == 0, _cat("AKIA", F.lpad(key, 16, "0"))).otherwise(""),
    )


_REWRITTEN_SQL = ORDERS_SQL + """,
texts AS (
  SELECT project, path, CASE s WHEN 'F' THEN '@if (a) {' WHEN 'O' THEN '@if(a) {' ELSE '@if (a) ' END
    || CASE WHEN s = 'O' THEN '<b *ngFor="let x of xs">' ELSE '<b>' END || k || '</b>}'
    || CASE WHEN k::BIGINT % 7 = 0 THEN '<!-- WARNING: ng-template #x not found -->' ELSE '' END
    || CASE WHEN k::BIGINT % 11 = 0 THEN 'AKIA' || lpad(k, 16, '0') ELSE '' END AS content FROM o)"""


def _flat(df):
    return df.withColumn("errors", F.array_join("errors", "|")).withColumn(
        "stage_order", F.col("stage_order").cast("bigint")
    )


def _corpus(spark, sf):
    docs = documents(spark, sf).select("project", "path", "content")
    return order_files(spark, sf, _rewritten).unionByName(pages(spark, sf)).unionByName(docs)


_CORPUS_SQL = f"""
WITH {_REWRITTEN_SQL}, {PAGES_SQL}, {DOCUMENTS_SQL},
corpus AS (
  SELECT project, path, content FROM texts UNION ALL
  SELECT 'h:' || project, path, content FROM pages_corpus UNION ALL
  SELECT 'd:' || project, path, content FROM docs)"""


def verify_text(spark, sf):
    return _flat(checks.run_checks(_corpus(spark, sf), VERIFY, "content")).groupBy("stage", "passed", "errors").agg(
        F.count(F.lit(1)).alias("files")
    )


def verify_files(spark, sf):
    return _flat(checks.run_checks(order_files(spark, sf, _rewritten), VERIFY, "content"))


_VERIFY_SQL = """
results AS (
  SELECT project, path, 'VerificationAgent' AS stage, 10 AS stage_order, concat_ws('|',
      CASE WHEN contains(content, '*ngIf=') OR contains(content, '*ngFor=') THEN 'Legacy structural directives still present.' END,
      CASE WHEN length(content) - length(replace(content, '{', '')) <> length(content) - length(replace(content, '}', ''))
           THEN 'Unbalanced braces detected.' END,
      CASE WHEN contains(content, '@if') AND NOT contains(content, '@if (') THEN 'Malformed @if syntax, missing parentheses.' END) AS errors
  FROM {0} UNION ALL
  SELECT project, path, 'AST', 20, CASE WHEN contains(content, '<!-- WARNING:') THEN 'Orphaned ng-template reference found in output' ELSE '' END
  FROM {0})"""


def secrets_scan(spark, sf):
    talks = read(spark, sf, "conversations").select(
        F.lit("talks").alias("project"), F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("path"),
        F.col("text").alias("content"),
    )
    # Values far longer than any usual one, by construction.
    value = F.repeat(F.lit("a1B2"), (F.col("s_suppkey") % 60 + 5).cast("int"))
    long = read(spark, sf, "supplier").select(
        F.lit("talks").alias("project"), F.concat(F.lit("s/"), F.col("s_suppkey")).alias("path"),
        F.concat(F.lit('x\ntoken = "'), value, F.lit('"; xoxb-'), value).alias("content"),
    )
    everything = _corpus(spark, sf).unionByName(talks).unionByName(long)
    return _flat(checks.run_checks(everything, SECRETS, "content")).filter(~F.col("passed")).select("path", "errors")


_SECRETS_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN regexp_matches(content, '{regex.replace(chr(39), chr(39) * 2)}') THEN 'Secret detected: {name}' END"
    for name, regex in fixed.SECRET_RULES
) + ")"


def _labels(spark, sf):
    return read(spark, sf, "labels")


def _attempts(spark, sf):
    """One finished attempt per document."""
    return documents(spark, sf).withColumn("attempt", F.lit(0))


def _external(spark, sf):
    """Labels as type and lint results; documents without labels have none."""
    labelled = documents(spark, sf).join(_labels(spark, sf), "doc_id")
    results = F.array(
        F.struct(F.lit("TypeCheck").alias("stage"), (F.col("quality") == 1).alias("passed"),
                 F.when(F.col("quality") == 0, F.array(_cat("TS", F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("errors")),
        F.struct(F.lit("Lint").alias("stage"), (F.col("toxic") == 0).alias("passed"),
                 F.when(F.col("toxic") == 1, F.array(F.lit("semi"))).otherwise(F.array().cast("array<string>")).alias("errors")),
    )
    return labelled.select("run_id", "project", "path", F.lit(0).alias("attempt"), F.inline(results))


def _all_checks(spark, sf):
    texts = _attempts(spark, sf)
    # Both branches below read these rows: the texts are checked once.
    # They are dealt out by file first, as a scan of few large pieces would leave them to few tasks.
    dealt = texts.repartition("run_id", "project", "path")
    own = cut(checks.run_checks(dealt, checks.BUILT_IN, "content"), "checks")
    static = own.filter(F.col("stage") == "AST").unionByName(checks.external_results(texts, _external(spark, sf)))
    return own.filter(F.col("stage") != "AST").unionByName(checks.gate(static))


def stage_gate(spark, sf):
    return _flat(_all_checks(spark, sf)).drop("attempt")


def _tests(spark, sf):
    """Test logs of documents that mention a secret, and of toxic ones."""
    labelled = documents(spark, sf).join(_labels(spark, sf), "doc_id")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labelled.filter(F.length("content") % 3 != 0).select(
        "run_id", "project", "path", F.lit(0).alias("attempt"), (~bad).alias("passed"), F.lit(1).alias("total"),
        bad.cast("int").alias("failed"),
        F.when(bad, F.concat(F.lit("FAIL "), F.col("path"), F.lit("\n"), F.repeat(F.lit("at line\n"), 40), F.col("path"), F.lit("\n")))
        .otherwise("ok").alias("logs"),
    )


def test_results(spark, sf):
    texts = _attempts(spark, sf)
    out = checks.test_results(texts, _tests(spark, sf), documents(spark, sf).filter(F.col("run_id") != "run_en"))
    return out.select("path", "passed", F.col("total").cast("bigint").alias("total"), F.col("failed").cast("bigint").alias("failed"), "logs")


def _tasks(spark, sf):
    return _attempts(spark, sf).select(
        "run_id", "project", "path", "attempt", "doc_id",
        F.when(F.contains("content", F.lit("token")), "ambiguous").otherwise("deterministic").alias("strategy"),
    )


def _scored(spark, sf, mode="signals"):
    return score.confidence(
        _tasks(spark, sf), _all_checks(spark, sf), checks.test_results(_attempts(spark, sf), _tests(spark, sf)), mode
    )


def _decided(spark, sf, stages=None):
    stages = _all_checks(spark, sf) if stages is None else stages
    return score.decide(
        _tasks(spark, sf), stages, checks.test_results(_attempts(spark, sf), _tests(spark, sf))
    )


def confidence(spark, sf):
    return _scored(spark, sf).select("path", "strategy", "confidence_score", "approved")


def confidence_collapsed(spark, sf):
    return _scored(spark, sf, "collapsed").select("path", "strategy", "confidence_score", "approved")


def dry_run(spark, sf):
    return score.dry_run(_tasks(spark, sf)).select("run_id", "path", "strategy", "confidence_score", "completed")


def _failures(spark, sf):
    return score.classify_failures(
        _tasks(spark, sf), _all_checks(spark, sf), checks.test_results(_attempts(spark, sf), _tests(spark, sf))
    )


def failure_category(spark, sf):
    return _failures(spark, sf).select("path", "failure_category", F.array_join("errors", "|").alias("errors"))


def failure_context(spark, sf):
    failures = _failures(spark, sf).withColumns({
        "framework": F.when(F.col("run_id") == "run_en", "angular").when(F.col("run_id") == "run_fr", "react").otherwise("svelte"),
        "migration": F.when(F.col("run_id") == "run_en", "control_flow").otherwise("cra_to_vite"),
    })
    return score.failure_context(failures, default_catalog().hints_table(spark)).select("path", "failure_context")


_SCORE_SQL = f"""
WITH {DOCUMENTS_SQL},
d AS (
  SELECT docs.*, quality, toxic, quality IS NOT NULL AS labelled,
    CASE WHEN contains(content, 'token') THEN 'ambiguous' ELSE 'deterministic' END AS strategy,
    quality IS NOT NULL AND length(content) % 3 <> 0 AS ran
  FROM docs LEFT JOIN labels USING (doc_id)),
corpus AS (SELECT run_id || chr(0) || project AS project, path, content FROM d),
{_VERIFY_SQL.replace('{0}', 'corpus')},
own AS (
  SELECT d.*, v.errors AS va, a.errors AS ast, {_SECRETS_SQL} AS sec
  FROM d JOIN results v ON v.path = d.path AND v.stage = 'VerificationAgent'
  JOIN results a ON a.path = d.path AND a.stage = 'AST'),
e AS (
  SELECT *, NOT labelled OR quality = 1 AS type_ok, NOT labelled OR toxic = 0 AS lint_ok,
    CASE WHEN ran THEN NOT (toxic = 1 OR quality = 0) ELSE true END AS tests_ok,
    CASE WHEN NOT labelled THEN '[SKIPPED] No tsconfig.json found' WHEN quality = 0 THEN 'TS' || doc_id ELSE '' END AS type_err,
    CASE WHEN NOT labelled THEN '[SKIPPED] No eslint config found' WHEN toxic = 1 THEN 'semi' ELSE '' END AS lint_err
  FROM own),
stages AS (
  SELECT run_id, project, path, 'VerificationAgent' AS stage, 10 AS stage_order, va = '' AS passed, va AS errors FROM e UNION ALL
  SELECT run_id, project, path, 'SecretsScan', 90, sec = '', sec FROM e UNION ALL
  SELECT run_id, project, path, 'AST', 20, ast = '', ast FROM e UNION ALL
  SELECT run_id, project, path, 'TypeCheck', 30, type_ok, type_err FROM e WHERE ast = '' UNION ALL
  SELECT run_id, project, path, 'Lint', 40, lint_ok, lint_err FROM e WHERE ast = '' AND type_ok),
failed AS (
  SELECT path, arg_min(stage, stage_order) FILTER (NOT passed) AS bad_stage, arg_min(errors, stage_order) FILTER (NOT passed) AS bad_errors,
         arg_max(errors, stage_order) AS last_errors, arg_max(passed, stage_order) AS last_passed
  FROM stages GROUP BY path),
classified AS (
  SELECT e.*, coalesce(bad_errors, last_errors) AS shown_errors,
    CASE WHEN bad_stage IN ('AST', 'VerificationAgent') THEN 'syntax_failure' WHEN bad_stage = 'TypeCheck' THEN 'type_error'
         WHEN bad_stage = 'Lint' THEN 'lint_error' WHEN bad_stage = 'SecretsScan' THEN 'secrets_detected'
         WHEN NOT tests_ok THEN 'test_failure' ELSE 'unknown' END AS category, last_passed
  FROM e JOIN failed USING (path))
"""

_HINT_ROWS = ", ".join(
    f"('{fw}', '{mig}', '{cat}', '{hint.replace(chr(39), chr(39) * 2)}')" for fw, mig, cat, hint in fixed.HINTS
)


def with_outcome(events):
    """Events as attempts: the user is the file, an error a failure of some category."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") != "error").alias("passed"),
        F.when((F.col("event_type") == "error") & (k % 5 == 0), "secrets_detected").alias("category"),
    )


def _steps(spark, sf):
    return with_outcome(read(spark, sf, "events"))


def retry_routing(spark, sf):
    routed = score.retry_routing(_steps(spark, sf), ["user_id"], ["ts", "event_id"])
    return routed.select("event_id", "user_id", "attempt", "retry_count", "action")


def routes(spark, sf):
    tasks = _tasks(spark, sf).join(_labels(spark, sf), "doc_id", "left")
    dry = F.col("run_id") == "run_es"
    where = score.route(
        F.when(F.col("quality").isNotNull(), F.col("strategy")), dry, F.coalesce(F.col("toxic") == 1, F.lit(False))
    )
    return tasks.select("path", where.alias("route"))


def merge_latest(spark, sf):
    return state.merge_latest(_steps(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


def append_list(spark, sf):
    return state.append_list(_steps(spark, sf), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "place", "event_id", "event_type"
    )


def run_ids(spark, sf):
    return _steps(spark, sf).groupBy(run_id(F.col("ts")).alias("run_id")).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("passed")).alias("failures")
    )


QUERIES = {
    "verify_text": verify_text,
    "verify_files": verify_files,
    "secrets_scan": secrets_scan,
    "stage_gate": stage_gate,
    "test_results": test_results,
    "confidence": confidence,
    "confidence_collapsed": confidence_collapsed,
    "dry_run": dry_run,
    "failure_category": failure_category,
    "failure_context": failure_context,
    "retry_routing": retry_routing,
    "routes": routes,
    "merge_latest": merge_latest,
    "append_list": append_list,
    "run_ids": run_ids,
}

ORACLES = {
    "verify_text": _CORPUS_SQL + ", " + _VERIFY_SQL.replace("{0}", "corpus") + """
SELECT stage, errors = '' AS passed, errors, count(*) AS files FROM results GROUP BY ALL""",
    "verify_files": f"WITH {_REWRITTEN_SQL}, " + _VERIFY_SQL.replace("{0}", "texts") + """
SELECT project, path, stage, stage_order::BIGINT AS stage_order, errors = '' AS passed, errors FROM results""",
    "secrets_scan": _CORPUS_SQL + f""",
everything AS (
  SELECT path, content FROM corpus UNION ALL SELECT 'c/' || conv_id || '/' || turn, text FROM conversations)
SELECT path, {_SECRETS_SQL} AS errors FROM everything WHERE {_SECRETS_SQL} <> ''
UNION ALL SELECT 's/' || s_suppkey, 'Secret detected: Slack Token|Secret detected: Credential Assignment' FROM supplier""",
    "stage_gate": _SCORE_SQL + "SELECT run_id, project, path, stage, stage_order::BIGINT AS stage_order, passed, errors FROM stages",
    "test_results": _SCORE_SQL + """
SELECT path, CASE WHEN ran THEN tests_ok ELSE known END AS passed,
  (CASE WHEN ran OR known THEN 1 ELSE 0 END)::BIGINT AS total,
  (CASE WHEN ran THEN (NOT tests_ok)::INT WHEN known THEN 0 ELSE 1 END)::BIGINT AS failed,
  CASE WHEN ran AND NOT tests_ok THEN 'FAIL ' || path || chr(10) || repeat('at line' || chr(10), 40) || path || chr(10)
       WHEN ran THEN 'ok' WHEN known THEN '[SKIPPED] Could not determine test command for this project.'
       ELSE 'Project path not found.' END AS logs
FROM (SELECT *, project IN (SELECT project FROM docs WHERE run_id <> 'run_en') AS known FROM e)""",
    "confidence": _SCORE_SQL + """,
s AS (
  SELECT path, strategy, (CASE strategy WHEN 'deterministic' THEN 40 ELSE 0 END + CASE WHEN ast = '' THEN 10 ELSE 0 END
    + CASE WHEN ast = '' AND type_ok THEN 15 ELSE 0 END + CASE WHEN ast = '' AND type_ok AND lint_ok THEN 10 ELSE 0 END
    + CASE WHEN va = '' THEN 5 ELSE 0 END + CASE WHEN tests_ok THEN 20 ELSE 0 END)::DOUBLE AS confidence_score FROM e)
SELECT *, confidence_score >= 90 AS approved FROM s""",
    "confidence_collapsed": _SCORE_SQL + """,
s AS (
  SELECT path, strategy, (CASE strategy WHEN 'deterministic' THEN 40 ELSE 0 END + CASE WHEN last_passed THEN 40 ELSE 0 END
    + CASE WHEN tests_ok THEN 20 ELSE 0 END)::DOUBLE AS confidence_score FROM classified)
SELECT *, confidence_score >= 90 AS approved FROM s""",
    "dry_run": f"""WITH {DOCUMENTS_SQL}
SELECT run_id, path, CASE WHEN contains(content, 'token') THEN 'ambiguous' ELSE 'deterministic' END AS strategy,
       CASE WHEN contains(content, 'token') THEN 40.0 ELSE 90.0 END::DOUBLE AS confidence_score,
       NOT contains(content, 'token') AS completed FROM docs""",
    "failure_category": _SCORE_SQL + "SELECT path, category AS failure_category, shown_errors AS errors FROM classified",
    "failure_context": _SCORE_SQL + f""",
hints(framework, migration, category, hint) AS (VALUES {_HINT_ROWS}),
f AS (
  SELECT *, CASE run_id WHEN 'run_en' THEN 'angular' WHEN 'run_fr' THEN 'react' ELSE 'svelte' END AS framework,
         CASE run_id WHEN 'run_en' THEN 'control_flow' ELSE '*' END AS migration FROM classified)
SELECT path, concat_ws(chr(10), 'Previous attempt failed with category: ' || f.category || '.',
    CASE WHEN shown_errors <> '' THEN 'Validation errors:' END,
    CASE WHEN shown_errors <> '' THEN '  - ' || replace(shown_errors, '|', chr(10) || '  - ') END,
    CASE WHEN f.category = 'test_failure' THEN 'Test failure output:' || repeat(chr(10) || '  at line', 29) || chr(10) || '  ' || path END,
    'Correction guidance: ' || coalesce(h.hint, u.hint, 'Review the full file carefully and ensure the migration is complete.')) AS failure_context
FROM f LEFT JOIN hints h ON h.framework = f.framework AND h.migration = f.migration AND h.category = f.category
LEFT JOIN hints u ON u.framework = f.framework AND u.migration = f.migration AND u.category = 'unknown'""",
    "retry_routing": """
WITH s AS (
  SELECT event_id, user_id, ts, event_type <> 'error' AS passed,
    event_type = 'error' AND (props->>'$.k')::INT % 5 = 0 AS secret FROM events),
n AS (
  SELECT *, row_number() OVER w AS attempt,
    coalesce(bool_or(passed OR secret) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS decided
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, attempt, attempt - 1 AS retry_count,
  CASE WHEN decided OR attempt > 4 THEN 'closed' WHEN passed THEN 'approve' WHEN secret THEN 'escalate'
       WHEN attempt <= 3 THEN 'retry' ELSE 'escalate' END AS action
FROM n""",
    "routes": f"""WITH {DOCUMENTS_SQL}
SELECT path, CASE WHEN run_id = 'run_es' THEN 'record' WHEN toxic = 1 THEN 'next'
  WHEN quality IS NOT NULL AND contains(content, 'token') THEN 'model' ELSE 'rewrite' END AS route
FROM docs LEFT JOIN labels USING (doc_id)""",
    "merge_latest": """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "append_list": """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_id, event_type FROM events""",
    "run_ids": """
SELECT strftime(ts, 'run_%Y_%m_%d_%H%M') AS run_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS failures
FROM events GROUP BY 1""",
}

"""Run reports, review tickets, run totals and history.

Reports of one run can hold a large share of all files, so nothing gathers a
run in one task: Markdown is a table of lines with a sort key, and the nested
document is split into parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed

def _outcome(passed: Column) -> Column:
    return F.when(passed, "pass").when(~passed, "fail")


def file_records(results: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """One record per finished file, completed or escalated.

    ``results`` has run_id, project, path, strategy, confidence_score,
    retry_count, failure_category, completed. ``stages`` (run_id, project,
    path, stage, passed) fills the validation columns.
    """
    keys = ["run_id", "project", "path"]
    if stages is not None:
        passed = {
            "ast": "AST", "type_check": "TypeCheck", "lint": "Lint",
            "secrets_scan": "SecretsScan", "tests": "Tests",
        }
        per_file = stages.groupBy(*keys).agg(
            *[F.bool_and(F.when(F.col("stage") == s, F.col("passed"))).alias(f"_{n}") for n, s in passed.items()]
        )
        results = results.join(per_file, keys, "left")
        validation = F.struct(*[_outcome(F.col(f"_{n}")).alias(n) for n in passed])
    else:
        none = F.lit(None).cast("string")
        validation = F.struct(*[none.alias(n) for n in ("ast", "type_check", "lint", "secrets_scan", "tests")])
    completed = F.col("completed")
    return results.select(
        *keys,
        F.col("path").alias("file"),
        "strategy",
        F.bround(F.coalesce("confidence_score", F.lit(0.0)), 1).alias("confidence_score"),
        validation.alias("validation"),
        F.coalesce("retry_count", F.lit(0)).cast("int").alias("retry_count"),
        F.when(completed, F.col("failure_category"))
        .otherwise(F.coalesce("failure_category", F.lit("unknown"))).alias("failure_category"),
        (~completed).alias("human_review_required"),
        F.lit(None).cast("string").alias("trace_url"),
    )


def summaries(results: DataFrame, by: list | None = None) -> DataFrame:
    """Totals per run: approved, flagged, average of scored files, hours saved."""
    by = by or ["run_id"]
    completed = F.count_if("completed")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_files"),
        completed.alias("auto_approved"),
        F.count_if(~F.col("completed")).alias("flagged_for_review"),
        F.bround(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 1).alias("avg_confidence"),
        F.bround(completed * fixed.MINUTES_PER_FILE / 60, 2).alias("time_saved_estimate_hours"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    """The four totals a run ends with."""
    completed = F.count_if("completed")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        completed.alias("successful_files"),
        F.count_if(~F.col("completed")).alias("escalated_files"),
        (completed * fixed.MINUTES_PER_FILE).alias("estimated_time_saved_minutes"),
    )


def live_counts(results: DataFrame) -> DataFrame:
    """Counts and the unrounded average confidence while a run goes on."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("completed").alias("auto_approved"),
        F.count_if(~F.col("completed")).alias("flagged"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
    )


def report_documents(runs: DataFrame, records: DataFrame, totals: DataFrame) -> DataFrame:
    """Report rows, ready for the JSON sink: one per file, and one per run with its summary.

    ``runs`` has run_id, timestamp, project, framework, migration_type. A row of a file has that file alone in ``files``
    and no summary, and part 1; a row of a run has no files, and part 0. A run is never gathered in one row, whatever its size.
    """
    fields = [
        "file", "strategy", "confidence_score", "validation", "retry_count",
        "failure_category", "human_review_required", "trace_url",
    ]
    head = ["run_id", "timestamp", "project", "framework", "migration_type"]
    summary = F.struct(
        *[F.col(c).cast("int").alias(c) for c in ("total_files", "auto_approved", "flagged_for_review")],
        "avg_confidence", "time_saved_estimate_hours",
    )
    per_file = records.select("run_id", F.array(F.struct(*fields)).alias("files")).join(runs, "run_id")
    per_run = runs.join(totals, "run_id").select(*head, F.lit(0).alias("part"), summary.alias("summary"))
    return per_file.select(*head, F.lit(1).alias("part"), "files").unionByName(per_run, allowMissingColumns=True).withColumn(
        "files", F.coalesce("files", F.array())
    )


def _score_text(score: Column) -> Column:
    return score.cast("double").cast("string")


def _one_decimal(value: Column) -> Column:
    """One decimal, ties to even."""
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def markdown_lines(
    runs: DataFrame, records: DataFrame, totals: DataFrame,
    threshold: float = fixed.AUTO_APPROVE_THRESHOLD, output_dir: str = "reports",
    title: str = "Migration Report",
) -> DataFrame:
    """The Markdown report as lines: (run_id, section, item, nth, line).

    Sorting by section, item, nth gives the text. Head lines come from the
    run's totals; table rows come straight from the records, one per file.
    """
    s = F.col

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    head = [
        text(f"# {title} — `", s("run_id"), "`"),
        text(""),
        text("**Timestamp:** ", s("timestamp"), "  "),
        text("**Project:** `", s("project"), "`  "),
        text("**Migration:** `", s("migration_type"), "`"),
        text(""),
        text("## Summary"),
        text(""),
        text("| Metric | Value |"),
        text("|---|---|"),
        text("| Total files | ", s("total_files").cast("string"), " |"),
        text(f"| Auto-approved (≥{threshold:.0f}) | ", s("auto_approved").cast("string"), " |"),
        text("| Flagged for review | ", s("flagged_for_review").cast("string"), " |"),
        text("| Avg confidence | ", _one_decimal(s("avg_confidence")), " |"),
        text("| Estimated time saved | ", _one_decimal(s("time_saved_estimate_hours")), " h |"),
        text(""),
        text("## File Details"),
        text(""),
        text("| File | Strategy | Confidence | Status |"),
        text("|---|---|---|---|"),
    ]
    review_head = [
        text(""),
        text("## Review Required"),
        text(""),
        text("The following files need human review (see `", F.lit(output_dir), "/", s("run_id"), "/review/`):"),
        text(""),
    ]

    def numbered(lines: list, section: int) -> Column:
        return F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit("").alias("item"), F.lit(i).alias("nth"), l.alias("line"))
            for i, l in enumerate(lines)
        ])

    blocks = F.when(
        s("flagged_for_review") > 0, F.concat(numbered(head, 1), numbered(review_head, 3))
    ).otherwise(numbered(head, 1))
    fixed_part = runs.join(totals, "run_id").select("run_id", F.inline(blocks))

    review = s("human_review_required")
    status = F.when(review, fixed.STATUS_REVIEW).otherwise(fixed.STATUS_APPROVED)
    score = _score_text(s("confidence_score"))
    row = text("| `", s("file"), "` | ", s("strategy"), " | ", score, " | ", status, " |")
    entry = text(
        "- `", s("file"), "` (confidence ", score, ", ", F.coalesce("failure_category", F.lit("n/a")), ")"
    )
    # Completed files sort before escalated ones, each by project and path.
    item = F.concat(F.when(review, "1").otherwise("0"), F.lit("/"), s("project"), F.lit("/"), s("path"))
    listed = F.struct(F.lit(2).alias("section"), item.alias("item"), F.lit(0).alias("nth"), row.alias("line"))
    asked = F.struct(F.lit(4).alias("section"), item.alias("item"), F.lit(0).alias("nth"), entry.alias("line"))
    file_part = records.select(
        "run_id", F.inline(F.when(review, F.array(listed, asked)).otherwise(F.array(listed)))
    )
    return fixed_part.unionByName(file_part)


def in_text_order(lines: DataFrame) -> DataFrame:
    """Markdown lines range-partitioned and sorted, for a text sink."""
    return lines.repartitionByRange("run_id", "section", "item", "nth").sortWithinPartitions(
        "run_id", "section", "item", "nth"
    )


def tickets(escalated: DataFrame) -> DataFrame:
    """One review ticket per escalated file: its name and Markdown body.

    ``escalated`` has run_id, project, path, confidence_score, strategy,
    errors, test_logs, diff; the last three may be null.
    """
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    listed = F.when(F.size(errors) == 0, fixed.NO_ERRORS).otherwise(
        F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    )

    def or_default(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    body = F.concat(
        F.lit("# Migration Review Required: `"), F.col("path"), F.lit("`\n\n**Confidence Score:** "),
        _score_text(F.coalesce("confidence_score", F.lit(0.0))), F.lit("/100\n**Strategy Used:** "),
        F.col("strategy"), F.lit("\n\n## Validation Errors\n"), listed,
        F.lit("\n\n## Test Output\n```text\n"), or_default("test_logs", fixed.NO_LOGS),
        F.lit("\n```\n\n## Proposed Diff\n```diff\n"), or_default("diff", fixed.NO_DIFF), F.lit("\n```\n"),
    )
    name = F.concat(F.lit("REVIEW_"), F.translate("path", "/\\", "__"), F.lit(".md"))
    return escalated.select("run_id", "project", "path", name.alias("ticket"), body.alias("body"))


def stored_records(reports: DataFrame) -> DataFrame:
    """File rows of stored reports, as their tables show them."""
    f = F.col("f")
    return reports.select("run_id", F.explode("files").alias("f")).select(
        "run_id",
        f["file"].alias("file"),
        f["strategy"].alias("strategy"),
        f["confidence_score"].alias("confidence_score"),
        F.coalesce(f["retry_count"], F.lit(0)).alias("retry_count"),
        F.when(F.coalesce(f["human_review_required"], F.lit(False)), "Review").otherwise("Approved").alias("status"),
    )


def stored_summaries(reports: DataFrame) -> DataFrame:
    """Summary rows of stored reports, missing fields as 0 or n/a."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(f"summary.{name}"), F.lit(0))

    names = ["total_files", "auto_approved", "flagged_for_review", "avg_confidence", "time_saved_estimate_hours"]
    return reports.filter(F.coalesce("part", F.lit(0)) == 0).select(
        "run_id", "timestamp", "project",
        *[F.coalesce(c, F.lit("n/a")).alias(c) for c in ("framework", "migration_type")],
        *[number(n).alias(n) for n in names],
    )


def run_history(totals: DataFrame, by: list, day: Column) -> DataFrame:
    """Run totals per project and day, with the change since the day before it.

    ``totals`` has one row per run. The window sees one row per day and project.
    """
    daily = totals.withColumn("day", day).groupBy(*by, "day").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_files").alias("total_files"),
        F.sum("auto_approved").alias("auto_approved"),
        F.sum("flagged_for_review").alias("flagged_for_review"),
    )
    previous = F.lag("auto_approved").over(Window.partitionBy(*by).orderBy("day"))
    return daily.withColumn("approved_change", F.col("auto_approved") - previous)


def next_fixes(approvals: DataFrame, fixes: DataFrame, keys: list, order: list) -> DataFrame:
    """``approvals`` with ``fixed_at``, the order of the first fix or roll-back of the file after it; null without one.

    A file is approved once, so the match of a busy file has as many rows as it has fixes, of which the smallest is
    taken within tasks first.
    """
    at, approved = F.struct(*order), "_approved_at"
    asked = approvals.select(*keys, at.alias(approved))
    first = fixes.select(*keys, at.alias("fixed_at")).join(asked, keys).where(F.col("fixed_at") > F.col(approved)).groupBy(
        *keys).agg(F.min("fixed_at").alias("fixed_at"))
    return approvals.join(first, keys, "left")


def false_confidence(approvals: DataFrame) -> DataFrame:
    """Per run the share of approved files that needed a later fix, from approvals with ``fixed_at``."""
    return approvals.groupBy("run_id").agg(
        (F.count("fixed_at") / F.count(F.lit(1))).alias("false_confidence_rate"))


def run_metrics(attempts: DataFrame, fixes: DataFrame | None = None, keys: list | None = None, order: list | None = None) -> DataFrame:
    """Per run: automatic rate, review rate, retry success rate and, with ``fixes``, false confidence rate.

    ``attempts`` has run_id and action, as retry routing gives them, and retry_count. ``fixes`` are later fixes and
    roll-backs by the same ``keys`` and ``order``; a run without approvals has no false confidence rate.
    """
    if fixes is not None:
        approvals = attempts.where("action = 'approve'").select("run_id", *keys, *order)
        return run_metrics(attempts).join(false_confidence(next_fixes(approvals, fixes, keys, order)), "run_id", "left")
    final = F.col("action").isin("approve", "escalate")
    approved = F.col("action") == "approve"
    decided = F.count_if(final)
    retried = F.count_if(final & (F.col("retry_count") > 0))
    return attempts.groupBy("run_id").agg(
        decided.alias("files"),
        (F.count_if(approved) / F.nullif(decided, F.lit(0))).alias("automatic_rate"),
        (F.count_if(F.col("action") == "escalate") / F.nullif(decided, F.lit(0))).alias("review_rate"),
        (F.count_if(approved & (F.col("retry_count") > 0)) / F.nullif(retried, F.lit(0))).alias("retry_success_rate"),
    )

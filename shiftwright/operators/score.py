"""Confidence scores, failure categories and what happens to a file next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.functions.text import strip, tail_lines
from shiftwright.operators.state import running_totals

ATTEMPT = ["run_id", "project", "path", "attempt"]


def _keys(df: DataFrame) -> list:
    return [c for c in ATTEMPT if c in df.columns]


def check_outcomes(checks: DataFrame) -> DataFrame:
    """Per text, in one aggregation: points of its passed stages, the last recorded
    stage, the first failed one, and the errors of a failed secrets scan."""
    entry = F.struct("stage", "passed", "errors")
    place = F.struct("stage_order", "stage")
    failed = ~F.col("passed")
    points = reduce(
        lambda a, b: a + b,
        [
            F.coalesce(F.max(F.when((F.col("stage") == s) & F.col("passed"), p)), F.lit(0.0))
            for s, p in fixed.STAGE_SCORES.items()
        ],
    )
    secret = failed & (F.col("stage") == "SecretsScan")
    return checks.groupBy(*_keys(checks)).agg(
        points.alias("points"),
        F.max_by(entry, place).alias("last"),
        F.min_by(F.when(failed, entry), F.when(failed, place)).alias("failed"),
        F.max(F.when(secret, F.col("errors"))).alias("secret_errors"),
    )


def decide(
    tasks: DataFrame, checks: DataFrame, tests: DataFrame, mode: str = "signals",
    threshold: float = fixed.AUTO_APPROVE_THRESHOLD,
) -> DataFrame:
    """Score, approval, failure category and errors of every task.

    ``signals`` adds points per stage; ``collapsed`` looks at the last recorded
    stage only and gives it one weight. A stage without a result gives none.
    """
    keys = _keys(tasks)
    if mode == "signals":
        points = F.coalesce("points", F.lit(0.0))
    elif mode == "collapsed":
        points = F.when(F.col("last.passed"), fixed.COLLAPSED_SCORE).otherwise(0.0)
    else:
        raise ValueError("mode is 'signals' or 'collapsed'")
    tested = tests.select(
        *_keys(tests), F.col("passed").alias("test_passed"), F.col("logs").alias("test_logs")
    )
    strategy = F.coalesce("strategy", F.lit("ambiguous"))
    score = (
        F.when(strategy == "deterministic", fixed.DETERMINISTIC_SCORE).otherwise(0.0)
        + points
        + F.when(F.col("test_passed"), fixed.TESTS_SCORE).otherwise(0.0)
    )
    shown = F.coalesce("failed", "last")
    return (
        tasks.join(check_outcomes(checks), keys, "left")
        .join(tested, keys, "left")
        .withColumns({
            "confidence_score": score,
            "approved": score >= threshold,
            "failure_category": failure_category(shown["stage"], shown["passed"], F.col("test_passed")),
            "errors": F.coalesce(shown["errors"], F.array().cast("array<string>")),
        })
        .drop("points", "last", "failed")
    )


def confidence(
    tasks: DataFrame, checks: DataFrame, tests: DataFrame, mode: str = "signals",
    threshold: float = fixed.AUTO_APPROVE_THRESHOLD,
) -> DataFrame:
    """Score of every task, and whether it is approved."""
    return decide(tasks, checks, tests, mode, threshold).select(
        *tasks.columns, "confidence_score", "approved"
    )


def dry_run(tasks: DataFrame) -> DataFrame:
    """Estimated score per task, and whether it would complete."""
    deterministic = F.coalesce("strategy", F.lit("deterministic")) == "deterministic"
    score = F.when(deterministic, fixed.DRY_RUN_DETERMINISTIC).otherwise(fixed.DRY_RUN_AMBIGUOUS)
    return tasks.withColumn("confidence_score", score).withColumn(
        "completed", F.col("confidence_score") >= fixed.QUICK_REVIEW_THRESHOLD
    )


def failure_category(stage: Column, check_passed: Column, test_passed: Column) -> Column:
    """Category of a failure: by the failed stage, else by the failed test, else unknown."""
    by_stage = reduce(
        lambda acc, item: acc.when(F.lower(stage) == item[0], item[1]),
        fixed.STAGE_CATEGORY.items(), F.when(F.lit(False), ""),
    )
    return F.coalesce(
        F.when(~check_passed, by_stage), F.when(~test_passed, F.lit("test_failure")), F.lit("unknown")
    )


def classify_failures(tasks: DataFrame, checks: DataFrame, tests: DataFrame) -> DataFrame:
    """Per task the category of its failure, the errors of the first failed stage
    (else of the last one), and the test outcome."""
    return decide(tasks, checks, tests).select(
        *tasks.columns, "test_passed", "test_logs", "failure_category", "errors"
    )


def failure_context(failures: DataFrame, hints: DataFrame) -> DataFrame:
    """Add ``failure_context``, the text a retry prompt carries.

    ``failures`` has framework, migration, failure_category, errors, test_logs.
    ``hints`` is the catalogue table; its "unknown" hint stands in for others.
    """
    by_migration = F.broadcast(
        hints.groupBy("framework", "migration").agg(
            F.map_from_entries(F.collect_list(F.struct("category", "hint"))).alias("_hints")
        )
    )
    category = F.col("failure_category")
    hint = F.coalesce(
        F.try_element_at("_hints", category), F.try_element_at("_hints", F.lit("unknown")),
        F.lit(fixed.FALLBACK_HINT),
    )
    errors = F.when(
        F.size("errors") > 0,
        F.concat(F.array(F.lit("Validation errors:")), F.transform("errors", lambda e: F.concat(F.lit("  - "), e))),
    )
    logs = F.when(
        (category == "test_failure") & (F.coalesce("test_logs", F.lit("")) != ""),
        F.concat(
            F.array(F.lit("Test failure output:")),
            F.transform(tail_lines(strip(F.col("test_logs")), fixed.LOG_TAIL), lambda l: F.concat(F.lit("  "), l)),
        ),
    )
    nothing = F.array().cast("array<string>")
    text = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("Previous attempt failed with category: "), category, F.lit("."))),
            F.coalesce(errors, nothing), F.coalesce(logs, nothing),
            F.array(F.concat(F.lit("Correction guidance: "), hint)),
        ),
        "\n",
    )
    return failures.join(by_migration, ["framework", "migration"], "left").withColumn(
        "failure_context", text
    ).drop("_hints")


def route(strategy: Column, is_dry_run: Column, escalated: Column) -> Column:
    """Where a task goes first; a task without a strategy counts as deterministic."""
    return (
        F.when(is_dry_run, "record")
        .when(escalated, "next")
        .when(F.coalesce(strategy, F.lit("deterministic")) == "ambiguous", "model")
        .otherwise("rewrite")
    )


def retry_routing(
    attempts: DataFrame, keys: list, order: list, max_retries: int = fixed.MAX_RETRIES
) -> DataFrame:
    """What follows each attempt: approve, retry, escalate, or closed if already decided.

    ``attempts`` has ``passed`` and ``category`` (may be null). Found secrets
    escalate at once; other failures retry until the budget is spent. The log of
    one file may be of any length, see running_totals.
    """
    failed = ~F.col("passed")
    secret = failed & (F.coalesce("category", F.lit("")) == "secrets_detected")
    final = F.col("passed") | secret
    counted = running_totals(
        attempts, keys, order,
        {"attempt": F.lit(1), "_decided": F.when(final, 1).otherwise(0)},
    )
    decided_before = F.col("_decided") - F.when(final, 1).otherwise(0)
    closed = (decided_before > 0) | (F.col("attempt") > max_retries + 1)
    action = (
        F.when(closed, "closed")
        .when(F.col("passed"), "approve")
        .when(secret, "escalate")
        .when(F.col("attempt") <= max_retries, "retry")
        .otherwise("escalate")
    )
    return counted.withColumn("action", action).withColumn(
        "retry_count", F.col("attempt") - 1
    ).drop("_decided")

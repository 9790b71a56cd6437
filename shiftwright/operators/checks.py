"""Checks of rewritten text, external results, and the stop after the first failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.catalog import Check
from shiftwright.functions.text import contains_any, occurrences

FILE = ["project", "path"]
ATTEMPT = ["run_id", "project", "path", "attempt"]
# Order in which external tools report.
EXTERNAL_STAGES = ["TypeCheck", "Lint"]
STAGE_ORDER = {"VerificationAgent": 10, "AST": 20, "TypeCheck": 30, "Lint": 40, "SecretsScan": 90}


def _verification(text: Column) -> Column:
    return F.array(
        F.when(contains_any(text, fixed.LEGACY_MARKERS), F.lit(fixed.MSG_LEGACY)),
        F.when(occurrences(text, "{") != occurrences(text, "}"), F.lit(fixed.MSG_BRACES)),
        F.when(text.contains("@if") & ~text.contains("@if ("), F.lit(fixed.MSG_MALFORMED_IF)),
    )


def _markers(text: Column) -> Column:
    return F.array(F.when(text.contains(fixed.WARNING_MARKER), F.lit(fixed.MSG_ORPHAN)))


def _secrets(text: Column) -> Column:
    """Literal tests come first: most texts hold no needle, so no pattern runs over them."""
    plain = F.lower(text)
    return F.array(*[
        F.when(contains_any(plain, fixed.SECRET_NEEDLES[name]) & text.rlike(regex), F.lit(f"Secret detected: {name}"))
        for name, regex in fixed.SECRET_RULES
    ])


BUILT_IN = [
    Check("VerificationAgent", STAGE_ORDER["VerificationAgent"], _verification),
    Check("AST", STAGE_ORDER["AST"], _markers),
    Check("SecretsScan", STAGE_ORDER["SecretsScan"], _secrets),
]


def run_checks(texts: DataFrame, checks: list, content: str = "after") -> DataFrame:
    """One row per text and check, in the scanning task. Rows without text are skipped."""
    keys = [c for c in ATTEMPT if c in texts.columns]
    results = F.array(*[
        F.struct(
            F.lit(c.stage).alias("stage"), F.lit(c.order).alias("stage_order"),
            F.array_compact(c.errors(F.col(content))).cast("array<string>").alias("errors"),
        )
        for c in checks
    ])
    # Passing is read off the errors after they are built, so no pattern runs twice.
    found = texts.filter(F.col(content).isNotNull()).select(*keys, F.inline(results))
    return found.select(
        *keys, "stage", "stage_order", (F.size("errors") == 0).alias("passed"), "errors"
    )


def external_results(
    files: DataFrame, external: DataFrame, framework: str | None = "angular", stages: list | None = None
) -> DataFrame:
    """Ingested type and lint results per file; a missing one counts as passed, with a note.

    ``files`` holds the keys, ``external`` (keys, stage, passed, errors). Without
    ``framework``, ``files`` has it as a column.
    """
    keys = [c for c in ATTEMPT if c in files.columns]
    stages = EXTERNAL_STAGES if stages is None else stages

    def note(stage: str) -> Column:
        other = f"[SKIPPED] No {stage} result"
        if framework is not None:
            return F.lit(fixed.SKIPPED_NOTES.get((framework, stage), other))
        out = F.when(F.lit(False), other)
        for (name, s), text in fixed.SKIPPED_NOTES.items():
            if s == stage:
                out = out.when(F.col("framework") == name, text)
        return out.otherwise(other)

    expected = files.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("stage"), F.lit(STAGE_ORDER.get(s, 50)).alias("stage_order"), note(s).alias("_note"))
            for s in stages
        ])),
    )
    return expected.join(external, [*keys, "stage"], "left").select(
        *keys, "stage", "stage_order",
        F.coalesce("passed", F.lit(True)).alias("passed"),
        F.when(F.col("passed").isNull(), F.array("_note"))
        .otherwise(F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"),
    )


def gate(checks: DataFrame) -> DataFrame:
    """Stages in order up to and including the first failure, per text."""
    keys = [c for c in ATTEMPT if c in checks.columns]
    before = Window.partitionBy(*keys).orderBy("stage_order", "stage").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        checks.withColumn("_clean", F.bool_and("passed").over(before))
        .filter(F.coalesce("_clean", F.lit(True)))
        .drop("_clean")
    )


def test_results(files: DataFrame, tests: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Ingested test results per file, with the outcomes of files that have none.

    No result counts as skipped and passed. With ``projects`` (their known
    ``project`` values), a file of an unknown project fails.
    """
    keys = [c for c in ATTEMPT if c in files.columns]
    joined = files.select(*keys).join(tests.withColumn("_ran", F.lit(True)), keys, "left")
    if projects is None:
        joined = joined.withColumn("_missing", F.lit(False))
    else:
        joined = joined.join(
            projects.select("project").distinct().withColumn("_known", F.lit(True)), "project", "left"
        ).withColumn("_missing", F.col("_known").isNull() & F.col("_ran").isNull())
    ran, missing = F.col("_ran").isNotNull(), F.col("_missing")
    return joined.select(
        *keys,
        F.when(ran, F.col("passed")).otherwise(~missing).alias("passed"),
        F.when(ran, F.col("total")).when(missing, 0).otherwise(1).alias("total"),
        F.when(ran, F.col("failed")).when(missing, 1).otherwise(0).alias("failed"),
        F.when(ran, F.col("logs")).when(missing, fixed.MISSING_PROJECT_LOG)
        .otherwise(fixed.SKIPPED_TESTS_LOG).alias("logs"),
    )

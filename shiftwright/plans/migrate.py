"""A whole run: select, scan, rewrite or ask the model, check, score, route, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.catalog import Catalog, default_migration
from shiftwright.operators import checks as checks_op
from shiftwright.operators.diff import ordered_diff, unified_text
from shiftwright.operators import detect, report, retrieve, rewrite, scan, score
from shiftwright.session import cut

FILE = ["project", "path"]
KEYS = ["run_id", "project", "path", "attempt"]
# Checks that always run; the others stop after the first failure.
ALWAYS = ["VerificationAgent", "SecretsScan"]


@dataclass
class Run:
    """What one run covers and how it decides. A run over many projects names no framework and migration."""

    run_id: str
    framework: str | None = None
    migration: str | None = None
    max_retries: int = fixed.MAX_RETRIES
    threshold: float = fixed.AUTO_APPROVE_THRESHOLD
    route_unmatched: str = "skip"
    score_mode: str = "signals"


def plan_files(files: DataFrame, catalog: Catalog) -> DataFrame:
    """The files to scan of many projects at once, with framework and migration.

    Each project gets the framework its files show and that framework's default
    migration; projects without one drop out. Detection is written before it is
    counted for a broadcast; with too many projects the join shuffles.
    """
    spark = files.sparkSession
    detected = cut(detect.detect_framework(files, catalog).filter(F.col("framework").isNotNull()), "projects")
    defaults = default_migration(catalog.migrations_table(spark)).select("framework", "migration")
    placed = files.join(detected, "project").join(F.broadcast(defaults), "framework")
    return scan.select_files_by_key(placed, catalog.suffixes_table(spark), catalog.skip_dirs_table(spark))


def scan_tasks(files: DataFrame, catalog: Catalog, run: Run) -> DataFrame:
    """The run's tasks, each with its content."""
    suffixes = catalog.suffixes.get((run.framework, run.migration)) or catalog.suffixes.get((run.framework, "*"), [])
    skip = sorted({*fixed.DEFAULT_SKIP_DIRS, *catalog.skip_dirs.get(run.framework, [])})
    selected = scan.select_files(files, suffixes, skip)
    return scan.file_tasks(
        selected, catalog.rules_for(run.framework, run.migration), run.route_unmatched, ["content"]
    )


def dry_run(files: DataFrame, catalog: Catalog, run: Run) -> DataFrame:
    """Estimated result per file, without any rewrite."""
    tasks = score.dry_run(scan_tasks(files, catalog, run).drop("content"))
    return tasks.select(
        F.lit(run.run_id).alias("run_id"), *FILE, "strategy", "complexity", "confidence_score",
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("failure_category"), "completed",
    )


def evaluate(
    texts: DataFrame, places: DataFrame, catalog: Catalog, run: Run, external: DataFrame | None, tests: DataFrame | None
) -> tuple:
    """Check, test and score one attempt of each text: (scored rows, check rows).

    ``texts`` has the attempt keys, strategy, after and error and must be cheap
    to read again (a written table); ``places`` has the framework of each file.
    Found secrets leave no score.
    """
    own = checks_op.run_checks(texts, catalog.checks).unionByName(
        # No text because reading or rewriting failed: the static stage fails with that error.
        texts.filter(F.col("after").isNull() & F.col("error").isNotNull()).select(
            *KEYS, F.lit("AST").alias("stage"), F.lit(checks_op.STAGE_ORDER["AST"]).alias("stage_order"),
            F.lit(False).alias("passed"), F.array("error").alias("errors"),
        )
    )
    spark = texts.sparkSession
    if external is None:
        external = spark.createDataFrame(
            [], "run_id STRING, project STRING, path STRING, attempt INT, stage STRING, passed BOOLEAN, errors ARRAY<STRING>"
        )
    if tests is None:
        tests = spark.createDataFrame(
            [], "run_id STRING, project STRING, path STRING, attempt INT, passed BOOLEAN, total INT, failed INT, logs STRING"
        )
    keyed = texts.select(*KEYS, "strategy")
    static = checks_op.gate(
        own.filter(~F.col("stage").isin(ALWAYS)).unionByName(
            checks_op.external_results(keyed.join(places, FILE), external, None)
            if run.framework is None else checks_op.external_results(keyed, external, run.framework)
        )
    )
    # Scores and reports read these rows: checks and their order are worked out once.
    results = cut(own.filter(F.col("stage").isin(ALWAYS)).unionByName(static), "checks")
    tested = checks_op.test_results(keyed, tests)
    secret = F.col("secret_errors").isNotNull()
    decided = score.decide(keyed, results, tested, run.score_mode, run.threshold).withColumns({
        "secret": secret,
        "confidence_score": F.when(~secret, F.col("confidence_score")),
        "approved": F.col("approved") & ~secret,
        "failure_category": F.when(secret, "secrets_detected").when(~F.col("approved"), F.col("failure_category")),
        "errors": F.coalesce("secret_errors", "errors"),
    }).drop("secret_errors")
    return decided, results


def migrate(
    files: DataFrame, catalog: Catalog, run: Run, model=None,
    external: DataFrame | None = None, tests: DataFrame | None = None,
) -> dict:
    """Run one migration over all files and return the tables of the run, see run_tasks."""
    # Dealt out by file, as a scan of few large pieces would leave the rules to few tasks.
    tasks = scan_tasks(files.repartition(*FILE), catalog, run).withColumns(
        {"framework": F.lit(run.framework), "migration": F.lit(run.migration)})
    return run_tasks(tasks, catalog, run, model, external, tests)


def migrate_projects(
    files: DataFrame, catalog: Catalog, run: Run, model=None,
    external: DataFrame | None = None, tests: DataFrame | None = None,
) -> dict:
    """One run over projects of many frameworks, each with the default migration of the framework its files show.

    All rule sets are dispatched by key within one projection: no loop over frameworks or projects, and
    no exchange of content by project. Beside the tables of run_tasks there are ``projects`` (what was chosen) and
    ``by_migration`` (outcomes per migration).
    """
    placed = plan_files(files, catalog).repartition(*FILE)
    tables = run_tasks(
        scan.file_tasks_by_key(placed, catalog, run.route_unmatched, ["content"]), catalog, run, model, external, tests)
    approved = F.col("completed")
    places = tables["tasks"].select(*FILE, "framework", "migration")
    return tables | {
        "projects": places.select("project", "framework", "migration").distinct(),
        "by_migration": tables["results"].join(places, FILE).groupBy("run_id", "framework", "migration").agg(
            F.count(F.lit(1)).alias("total_files"), F.count_if(approved).alias("auto_approved"),
            F.count_if(~approved).alias("flagged_for_review"),
        ),
    }


def run_tasks(
    tasks: DataFrame, catalog: Catalog, run: Run, model=None,
    external: DataFrame | None = None, tests: DataFrame | None = None,
) -> dict:
    """Run ``tasks``, each with content, framework and migration, and return the tables of the run.

    Every attempt is written to the shared folder once and read from there, so
    that neither a rewrite nor a model call is repeated when an executor is
    lost. Attempts are few (the retry budget), and rounds end when no file is left.
    Without ``model``, tasks for the model are escalated.
    """
    spark = tasks.sparkSession
    tasks = cut(tasks, "tasks")
    places = tasks.select(*FILE, "framework", "migration")
    run_id = F.lit(run.run_id).alias("run_id")
    direct = tasks.filter(F.col("strategy") == "deterministic")
    for_model = tasks.filter(F.col("strategy") == "ambiguous")

    def attempt_rows(texts: DataFrame, attempt: int) -> DataFrame:
        return texts.select(
            run_id, *FILE, F.lit(attempt).alias("attempt"), "strategy", "before", "after", "error"
        )

    rewritten = rewrite.rewrite_by_key(direct, catalog).withColumn("strategy", F.lit("deterministic"))
    texts = cut(attempt_rows(rewritten, 0), "attempts")
    scored, results = evaluate(texts, places, catalog, run, external, tests)
    scored = cut(scored, "scored")
    # A rewrite gives the same text every time: a failed one has no retry to gain from.
    finished = [
        scored.withColumn(
            "retry_count", F.when(F.col("approved") | F.col("secret"), 0).otherwise(run.max_retries)
        )
    ]
    all_texts, all_results = [texts], [results]

    if model is None:
        unanswered = for_model.select(
            run_id, *FILE, F.lit(0).alias("attempt"), "strategy",
            F.lit(None).cast("double").alias("confidence_score"), F.lit(False).alias("approved"),
            F.lit(None).cast("boolean").alias("test_passed"), F.lit(None).cast("string").alias("test_logs"),
            F.lit("unknown").alias("failure_category"), F.array().cast("array<string>").alias("errors"),
            F.lit(False).alias("secret"), F.lit(0).alias("retry_count"),
        )
        finished.append(unanswered)
    else:
        prompt_table, hints = catalog.prompts_table(spark), catalog.hints_table(spark)
        pending = for_model.withColumn("failure_context", F.lit(None).cast("string"))
        for attempt in range(run.max_retries + 1):
            if pending.isEmpty():
                break
            asked = retrieve.prompts(pending.withColumn("before", F.col("content")), prompt_table)
            answered = retrieve.infer(asked.select(*FILE, "strategy", "before", "messages"), model)
            answers = answered.withColumn("after", retrieve.strip_fence(F.col("text")))
            texts = cut(attempt_rows(answers, attempt), "attempts")
            scored, results = evaluate(texts, places, catalog, run, external, tests)
            scored = cut(scored, "scored").withColumn("retry_count", F.lit(attempt))
            all_texts.append(texts)
            all_results.append(results)
            final = F.col("approved") | F.col("secret") | F.lit(attempt == run.max_retries)
            finished.append(scored.filter(final))
            retry = score.failure_context(scored.filter(~final).join(places, FILE), hints).select(*FILE, "failure_context")
            pending = cut(pending.drop("failure_context").join(retry, FILE), "pending")

    def union(parts: list) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    outcome = union(finished).withColumn("completed", F.col("approved"))
    # The attempt that decided a file, by its keys: no text goes through an aggregation.
    last_texts = union(all_texts).join(outcome.select(*KEYS), KEYS, "left_semi").select(
        "run_id", *FILE, "before", "after", "error")
    stages = union(all_results).join(outcome.select(*KEYS), KEYS, "left_semi").unionByName(
        outcome.filter(F.col("test_passed").isNotNull()).select(
            *KEYS, F.lit("Tests").alias("stage"), F.lit(100).alias("stage_order"),
            F.col("test_passed").alias("passed"), F.array().cast("array<string>").alias("errors"),
        )
    )
    open_files = outcome.filter(~F.col("completed"))
    # Only files that somebody must look at are compared.
    open_texts = last_texts.join(open_files.select("run_id", *FILE), ["run_id", *FILE], "left_semi")
    escalated = open_files.join(_diffs(open_texts), ["run_id", *FILE], "left")
    return {
        "tasks": tasks.drop("content"),
        "attempts": union(all_texts),
        "checks": union(all_results),
        "results": outcome,
        "texts": last_texts,
        "records": report.file_records(outcome, stages),
        "summary": report.summaries(outcome),
        "totals": report.run_totals(outcome),
        "tickets": report.tickets(escalated),
    }


def _diffs(texts: DataFrame) -> DataFrame:
    run_of = texts.select("run_id", *FILE)
    return run_of.join(unified_text(ordered_diff(texts)), FILE)

"""Framework detection, migration resolution and test commands, per project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright import schemas
from shiftwright.functions.text import contains_any, file_name, file_stem



def _dirs(path: Column) -> Column:
    """Directory names of a path, without the file name."""
    return F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")


def with_signals(files: DataFrame) -> DataFrame:
    """Add ``manifest`` (the parsed root package.json, null elsewhere) and ``dirs``."""
    is_manifest = F.col("path") == "package.json"
    return files.withColumn(
        "manifest", F.when(is_manifest, F.from_json(F.col("content"), schemas.MANIFEST))
    ).withColumn("dirs", _dirs(F.col("path")))


def depends_on(package: str) -> Column:
    """True on a manifest row that lists ``package`` in either dependency map."""
    return F.coalesce(
        F.map_contains_key("manifest.dependencies", package), F.lit(False)
    ) | F.coalesce(F.map_contains_key("manifest.devDependencies", package), F.lit(False))


def _angular() -> Column:
    template = (
        F.col("path").endswith(".html")
        & ~F.arrays_overlap("dirs", F.array(*map(F.lit, fixed.DETECT_SKIP_DIRS)))
        & contains_any(F.make_valid_utf8(F.col("content")), fixed.DETECT_MARKERS)
    )
    return F.bool_or(
        depends_on("@angular/core")
        | (F.col("path") == "angular.json")
        | F.col("path").startswith(".angular/")
        | template
    )


def _react() -> Column:
    return F.bool_or(depends_on("react") & ~depends_on("@angular/core"))


# framework -> aggregate, in registration order
BUILT_IN = {"angular": _angular, "react": _react}


def project_facts(files: DataFrame, catalog) -> DataFrame:
    """One row per project: framework (null if none fits) and facts for the test command.

    A single aggregation with partial sums: a project with a third of all
    files costs no more than many small ones.
    """
    signals = {name: detector() for name, detector in catalog.detectors.items()}
    script = F.try_element_at("manifest.scripts", F.lit("test"))
    aggregated = with_signals(files).groupBy("project").agg(
        *[F.coalesce(s, F.lit(False)).alias(f"is_{name}") for name, s in signals.items()],
        F.bool_or(F.col("path") == "angular.json").alias("has_workspace"),
        F.bool_or(F.col("path") == "package.json").alias("has_manifest"),
        F.max(script).alias("test_script"),
        F.bool_or(F.col("path").isin("pytest.ini", "pyproject.toml")).alias("has_pytest"),
    )
    framework = F.coalesce(
        *[F.when(F.col(f"is_{name}"), F.lit(name)) for name in signals], F.lit(None)
    )
    return aggregated.select(
        "project", framework.alias("framework"),
        "has_workspace", "has_manifest", "test_script", "has_pytest",
    )


def detect_framework(files: DataFrame, catalog) -> DataFrame:
    return project_facts(files, catalog).select("project", "framework")


def _command(words: list) -> Column:
    return F.array(*map(F.lit, words))


def with_test_command(facts: DataFrame) -> DataFrame:
    """Add ``test_command``: the words of the project's test command, null if unknown."""
    script = F.col("test_script")
    react = F.when(
        script.contains("jest") | script.contains("react-scripts"), _command(fixed.NPM_TEST_ONCE)
    ).when(script.isNotNull(), _command(fixed.NPM_TEST))
    by_framework = F.when(
        F.col("framework") == "angular",
        F.when(F.col("has_workspace"), _command(fixed.NG_TEST)).when(
            F.col("has_manifest"), _command(fixed.NPM_TEST_ONCE)
        ),
    ).when(F.col("framework") == "react", react)
    by_files = (
        F.when(F.col("has_workspace"), _command(fixed.NG_TEST))
        .when(script.isNotNull(), _command(fixed.NPM_TEST_ONCE))
        .when(F.col("has_pytest"), _command(fixed.PYTEST))
    )
    return facts.withColumn("test_command", F.coalesce(by_framework, by_files))


def file_test_command(command: Column, path: Column) -> Column:
    """The command with the selector for one file appended, where the runner has one."""
    joined = F.array_join(command, " ")
    jest = joined.contains("jest") | joined.contains("react-scripts")
    selector = F.when(jest, file_stem(path)).when(
        F.array_contains(command, "ng"), F.concat(F.lit("--include=**/"), file_name(path))
    )
    return F.when(
        (F.size(command) > 1) & selector.isNotNull(), F.array_append(command, selector)
    ).otherwise(command)


def resolve_migration(requests: DataFrame, default_framework: str = "angular") -> DataFrame:
    """Resolve ``framework`` and ``migration_type`` of each request.

    ``requests`` has ``migration_type``, ``framework`` (explicit, may be null)
    and ``detected`` (may be null). A known prefix beats an explicit framework.
    """
    pattern = f"^({'|'.join(fixed.KNOWN_PREFIXES)})_(.*)$"
    asked = F.col("migration_type")
    prefix = F.nullif(F.regexp_extract(asked, pattern, 1), F.lit(""))
    rest = F.regexp_extract(asked, pattern, 2)
    return requests.withColumns(
        {
            "resolved_framework": F.coalesce(
                prefix, F.nullif(F.col("framework"), F.lit("")), F.col("detected"),
                F.lit(default_framework),
            ),
            "resolved_migration": F.when(prefix.isNotNull(), rest).otherwise(asked),
        }
    )


def validate_requests(requests: DataFrame, catalog) -> DataFrame:
    """Look up requested (framework, migration) pairs in the catalogue.

    Names fold case, ``-`` becomes ``_``, a missing migration takes the
    framework's default. ``error`` says what is unknown, null if nothing is.
    """
    from shiftwright.catalog import default_migration

    spark = requests.sparkSession
    migrations = catalog.migrations_table(spark)
    known = catalog.frameworks_table(spark).select(
        F.col("framework").alias("_framework"), "framework_name"
    )
    defaults = default_migration(migrations).select(
        F.col("framework").alias("_default_framework"), F.col("migration").alias("_default")
    )
    pairs = migrations.select(
        F.col("framework").alias("_pair_framework"), F.col("id").alias("_pair_id"), "display_name"
    )
    joined = (
        requests.join(F.broadcast(known), F.lower("framework") == F.col("_framework"), "left")
        .join(F.broadcast(defaults), F.col("_framework") == F.col("_default_framework"), "left")
        .withColumn(
            "_migration", F.coalesce(F.translate("migration", "-", "_"), F.col("_default"))
        )
        .join(
            F.broadcast(pairs),
            (F.col("_framework") == F.col("_pair_framework"))
            & (F.col("_migration") == F.col("_pair_id")),
            "left",
        )
    )
    error = F.when(F.col("_framework").isNull(), "unknown framework").when(
        F.col("_pair_id").isNull(), "unknown migration"
    )
    return joined.select(
        *[c for c in requests.columns if c not in ("framework", "migration")],
        F.coalesce("_framework", "framework").alias("framework"),
        F.col("_migration").alias("migration"),
        "display_name",
        error.alias("error"),
    )


def custom_suffixes(migration: Column) -> Column:
    """Suffixes of the files to read when the caller brings a rule set: by a word in the migration's name."""
    def listed(word: str) -> Column:
        return F.array(*map(F.lit, fixed.LEGACY_SUFFIXES[word]))

    words = [w for w in fixed.LEGACY_SUFFIXES if w != "*"]
    found = reduce(lambda acc, w: acc.when(migration.contains(w), listed(w)), words, F.when(F.lit(False), listed("*")))
    return found.otherwise(listed("*"))


def select_custom_files(files: DataFrame, migration: Column) -> DataFrame:
    """Files with a suffix that the migration's name asks for; only the path is looked at."""
    return files.filter(F.exists(custom_suffixes(migration), lambda s: F.endswith(F.col("path"), s)))

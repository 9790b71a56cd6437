"""Rule scan: where each rule matches, and what that means per file and project.

The content of a file is read once, in the task that scans it. Per-file counts
need no shuffle at all; positions shuffle one small row per match, never text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.catalog import same_key
from shiftwright.functions.text import normalize_newlines

FILE = ["project", "path"]
RANK = {"simple": 0, "medium": 1, "complex": 2, "ambiguous": 0}
BY_RANK = ["simple", "medium", "complex"]

# Separators put around matches. Content characters equal to them are replaced
# one for one first, so that no offset moves.
_GAP_END, _MATCH_END, _SUBSTITUTE = "\u0002", "\u0001", "�"


def prepared(content: Column) -> Column:
    """Content as the rules see it."""
    text = normalize_newlines(content)
    used = text.contains(_GAP_END) | text.contains(_MATCH_END)
    return F.when(
        used, F.translate(text, _GAP_END + _MATCH_END, _SUBSTITUTE * 2)
    ).otherwise(text)


def directories(path: Column) -> Column:
    """Directory names of a path, without the file name."""
    return F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")


def select_files(files: DataFrame, suffixes: list, skip_dirs: list) -> DataFrame:
    """Files with a wanted suffix outside skipped directories.

    Only the path is looked at, so a column store reads no content for
    dropped files.
    """
    path = F.col("path")
    wanted = reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes], F.lit(False))
    skipped = F.arrays_overlap(directories(path), F.array(*map(F.lit, skip_dirs)).cast("array<string>"))
    return files.filter(wanted & ~skipped)


def select_files_by_key(files: DataFrame, suffixes: DataFrame, skip_dirs: DataFrame) -> DataFrame:
    """The same for files of many projects, by their ``framework`` and ``migration`` columns.

    ``suffixes`` and ``skip_dirs`` are catalogue tables, small by construction.
    """
    skip = F.broadcast(skip_dirs.groupBy("framework").agg(F.collect_set("dir").alias("_skip")))
    wanted = files.join(
        suffixes.distinct(),
        (files["framework"] == suffixes["framework"])
        & (files["migration"] == suffixes["migration"])
        & F.endswith(files["path"], suffixes["suffix"]),
        "left_semi",
    )
    skipped = F.coalesce(F.arrays_overlap(directories(F.col("path")), "_skip"), F.lit(False))
    return wanted.join(skip, "framework", "left").filter(~skipped).select(files.columns)


def _any_needle(text: Column, rules: list) -> Column:
    """True if some rule can match. Plain substring tests, before any regex."""
    if not rules:
        return F.lit(False)
    needles = {r.needle for r in rules}
    if None in needles:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [text.contains(n) for n in sorted(needles)])


def _marked(text: Column, rule) -> Column:
    """Array of ``gap + separator + match`` items, one per match of ``rule``."""
    marked = F.regexp_replace(text, rule.regex, f"{_GAP_END}$0{_MATCH_END}")
    items = F.filter(F.split(marked, _MATCH_END), lambda s: s.contains(_GAP_END))
    if rule.needle is None:
        return items
    return F.when(text.contains(rule.needle), items)


def _measured(items: Column, rule_idx: int) -> Column:
    """Per match: lengths and line counts of the gap before it and of itself."""
    parts = F.transform(
        items,
        lambda s: F.struct(
            F.substring_index(s, _GAP_END, 1).alias("gap"),
            F.substring_index(s, _GAP_END, -1).alias("match"),
        ),
    )

    def measure(part: Column, i: Column) -> Column:
        gap, match = part["gap"], part["match"]

        def newlines(t: Column) -> Column:
            return F.length(t) - F.length(F.replace(t, F.lit("\n")))

        def tail(t: Column) -> Column:
            return F.length(F.substring_index(t, "\n", -1))

        return F.struct(
            F.lit(rule_idx).alias("rule_idx"),
            i.alias("nth"),
            F.length(gap).cast("bigint").alias("gap_len"),
            newlines(gap).cast("bigint").alias("gap_lines"),
            tail(gap).cast("bigint").alias("gap_tail"),
            F.length(match).cast("bigint").alias("match_len"),
            newlines(match).cast("bigint").alias("match_lines"),
            tail(match).cast("bigint").alias("match_tail"),
            F.substring(match, 1, fixed.SNIPPET_CHARS).alias("snippet"),
        )

    return F.coalesce(F.transform(parts, measure), F.array().cast(_MEASURED))


_MEASURED = (
    "array<struct<rule_idx:int,nth:int,gap_len:bigint,gap_lines:bigint,gap_tail:bigint,"
    "match_len:bigint,match_lines:bigint,match_tail:bigint,snippet:string>>"
)


def find_matches(files: DataFrame, rules: list, applies: list | None = None) -> DataFrame:
    """All matches of all rules, with class, offset, line, column and snippet.

    Matches of one rule do not overlap; matches of different rules may. The
    offset counts code points from 0, line and column from 1. ``applies`` has a
    condition per rule: on other files the rule is not looked for.
    """
    spark = files.sparkSession
    if not rules:
        return spark.createDataFrame([], _schema(files))
    text = files.filter(_any_needle(F.col("content"), rules)).select(
        *FILE, prepared(F.col("content")).alias("_text"), *([F.array(*applies).alias("_applies")] if applies else [])
    )

    def items(i: int, rule) -> Column:
        marked = _marked(F.col("_text"), rule)
        return F.when(F.get("_applies", F.lit(i)), marked) if applies else marked

    measured = [_measured(items(i, r), i) for i, r in enumerate(rules)]
    rows = text.select(*FILE, F.inline(F.flatten(F.array(*measured)))).repartition(*FILE)

    by_match = Window.partitionBy(*FILE, "rule_idx").orderBy("nth")
    so_far = by_match.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_match.rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("gap_len") + F.col("match_len")
    newlines = F.col("gap_lines") + F.col("match_lines")
    placed = rows.withColumn("_end", F.sum(length).over(so_far)).withColumn(
        "_lines_before",
        F.coalesce(F.sum(newlines).over(before), F.lit(0)) + F.col("gap_lines"),
    )
    start = F.col("_end") - F.col("match_len")
    gap_line_start = F.when(F.col("gap_lines") > 0, start - F.col("gap_tail"))
    last_line_start = F.when(
        F.col("match_lines") > 0, F.col("_end") - F.col("match_tail")
    ).otherwise(gap_line_start)
    line_start = F.coalesce(
        gap_line_start, F.last(last_line_start, ignorenulls=True).over(before), F.lit(0)
    )
    return placed.select(
        *FILE,
        "rule_idx",
        _by_rule(rules, lambda r: r.pattern_id).alias("pattern_id"),
        _by_rule(rules, lambda r: r.classification).alias("classification"),
        _by_rule(rules, lambda r: r.complexity).alias("complexity"),
        start.alias("start"),
        (F.col("_lines_before") + 1).alias("line"),
        (start - line_start + 1).alias("column"),
        "snippet",
    )


def _schema(files: DataFrame) -> str:
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    return (
        f"project {types['project']}, path {types['path']}, rule_idx INT, pattern_id STRING, "
        "classification STRING, complexity STRING, start BIGINT, line BIGINT, "
        "`column` BIGINT, snippet STRING"
    )


def _by_rule(rules: list, value) -> Column:
    """The value of the row's rule, as a literal array lookup."""
    return F.get(F.array(*[F.lit(value(r)) for r in rules]), F.col("rule_idx"))


def ordered(matches: DataFrame) -> DataFrame:
    """Matches by file, then offset, ties by rule order."""
    return matches.orderBy(*FILE, "start", "rule_idx")


def find_matches_by_key(files: DataFrame, catalog) -> DataFrame:
    """The matches of files of many migrations, by their ``framework`` and ``migration``, in one pass.

    Every file meets the rules of its own migration, numbered as there.
    """
    keyed = catalog.keyed_rules()
    found = find_matches(files, [r for *_, r in keyed], [same_key(fw, mig) for fw, mig, *_ in keyed])
    if not keyed:
        return found
    return found.withColumn("rule_idx", F.get(F.array(*[F.lit(i) for _, _, i, _ in keyed]), F.col("rule_idx")))


def count_matches(
    files: DataFrame, rules: list, keep: list | None = None, applies: list | None = None
) -> DataFrame:
    """Per file: matches, deterministic and ambiguous ones, and the highest complexity rank.

    A projection. Files without any match keep their row, with zeros. ``applies``
    has a condition per rule, see find_matches.
    """
    text = prepared(F.col("content"))
    can_match = F.coalesce(_any_needle(F.col("content"), rules), F.lit(False))

    def usable(i: int, rule) -> Column:
        held = can_match if rule.needle is None else F.col("content").contains(rule.needle)
        return applies[i] & held if applies else held

    counts = [
        F.when(usable(i, r), F.regexp_count(text, F.lit(r.regex))).otherwise(0).alias(f"_n{i}")
        for i, r in enumerate(rules)
    ]
    keep = keep or []
    # A one-row inline keeps the optimizer from copying the pattern counts into
    # each place that uses them, filters included.
    generated = F.inline(F.array(F.struct(*counts, F.lit(0).alias("_none"))))
    counted = files.select(*FILE, *keep, generated)

    def total(wanted) -> Column:
        parts = [F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i, r in enumerate(rules) if wanted(r)]
        return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("bigint")

    ranks = [
        F.when(F.col(f"_n{i}") > 0, F.lit(RANK[r.complexity])).otherwise(0)
        for i, r in enumerate(rules)
    ]
    return counted.select(
        *FILE,
        *keep,
        total(lambda r: True).alias("matches"),
        total(lambda r: r.rewrite is not None).alias("deterministic"),
        total(lambda r: r.rewrite is None).alias("ambiguous"),
        (F.greatest(*ranks, F.lit(0)) if ranks else F.lit(0)).cast("int").alias("rank"),
    )


def scan_summary(files: DataFrame, rules: list) -> DataFrame:
    """Per project: files scanned, matches, deterministic and ambiguous counts.

    Unreadable files count as scanned; projects without matches stay.
    """
    return (
        count_matches(files, rules)
        .groupBy("project")
        .agg(
            F.count(F.lit(1)).alias("files_scanned"),
            F.sum("matches").alias("patterns_found"),
            F.sum("deterministic").alias("deterministic_count"),
            F.sum("ambiguous").alias("ambiguous_count"),
        )
    )


def scan_rollup(matches: DataFrame) -> DataFrame:
    """Match counts per file, per project and overall, in one aggregation."""
    return matches.rollup("project", "path").agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_if(F.col("classification") == "ambiguous").alias("ambiguous"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def file_tasks(
    files: DataFrame, rules: list, route_unmatched: str = "skip", keep: list | None = None, applies: list | None = None
) -> DataFrame:
    """One task per file with matches: strategy and complexity, no shuffle.

    ``route_unmatched="ambiguous"`` also makes a task for each file without
    matches, for migrations that have no rules. Columns in ``keep`` (such as
    content) stay on the row, which spares a join back to the files.
    """
    keep = keep or []
    counted = count_matches(files, rules, keep, applies)
    if route_unmatched == "skip":
        counted = counted.filter(F.col("matches") > 0)
    elif route_unmatched != "ambiguous":
        raise ValueError("route_unmatched is 'skip' or 'ambiguous'")
    model = (F.col("ambiguous") > 0) | (F.col("matches") == 0)
    return counted.select(
        *FILE, *keep,
        F.when(model, "ambiguous").otherwise("deterministic").alias("strategy"),
        F.get(F.array(*map(F.lit, BY_RANK)), F.col("rank")).alias("complexity"),
    )


def file_tasks_by_key(files: DataFrame, catalog, route_unmatched: str = "skip", keep: list | None = None) -> DataFrame:
    """The tasks of files of many migrations, by their ``framework`` and ``migration``: one projection, no shuffle."""
    keyed = catalog.keyed_rules()
    return file_tasks(
        files, [r for *_, r in keyed], route_unmatched, ["framework", "migration", *(keep or [])],
        [same_key(fw, mig) for fw, mig, *_ in keyed],
    )


def tasks_from_matches(matches: DataFrame) -> DataFrame:
    """The same tasks from an existing match table."""
    rank = reduce(
        lambda acc, item: acc.when(F.col("complexity") == item[0], item[1]),
        RANK.items(),
        F.when(F.lit(False), 0),
    )
    return matches.groupBy(*FILE).agg(
        F.when(F.bool_or(F.col("classification") == "ambiguous"), "ambiguous")
        .otherwise("deterministic")
        .alias("strategy"),
        F.get(F.array(*map(F.lit, BY_RANK)), F.max(rank)).alias("complexity"),
    )


def first_applicable(matches: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """Per file the deterministic match a rewrite takes first, optionally of one pattern."""
    usable = matches.filter(F.col("classification") == "deterministic")
    if pattern_id is not None:
        usable = usable.filter(F.col("pattern_id") == pattern_id)
    rest = [c for c in matches.columns if c not in FILE]
    first = F.min_by(F.struct(*rest), F.struct("start", "rule_idx"))
    return usable.groupBy(*FILE).agg(first.alias("m")).select(*FILE, "m.*")


def scan_documents(matches: DataFrame, files: DataFrame, framework: str, migration: str) -> DataFrame:
    """Scan results as JSON: one document per file with matches, and one summary per project, whose path is null.

    The shape does not depend on how many files a project has, and a project is never gathered in one row. Totals are
    counted within tasks first.
    """
    head = (F.col("project").alias("project_path"), F.lit(migration).alias("migration_type"), F.lit(framework).alias("framework"))
    found = F.array_sort(
        F.collect_list(
            F.struct("start", "rule_idx", F.struct(
                F.col("path").alias("file_path"), "line", "column", "pattern_id",
                "classification", "complexity", "snippet",
            ).alias("r"))
        )
    )["r"]
    per_file = matches.groupBy(*FILE).agg(found.alias("results")).select(
        "project", "path", F.to_json(F.struct(*head, "results")).alias("document")
    )
    totals = files.groupBy("project").agg(F.count(F.lit(1)).alias("total_files_scanned"))
    counts = matches.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_patterns_found"),
        F.count_if(F.col("classification") == "deterministic").alias("deterministic_count"),
        F.count_if(F.col("classification") == "ambiguous").alias("ambiguous_count"),
    )
    names = ["total_patterns_found", "deterministic_count", "ambiguous_count"]
    summary = totals.join(counts, "project", "left").fillna(0, names).select(
        "project", F.lit(None).cast("string").alias("path"),
        F.to_json(F.struct(*head, "total_files_scanned", *names)).alias("document"),
    )
    return per_file.unionByName(summary)

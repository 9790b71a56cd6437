"""The catalogue: frameworks, migrations, rules, checks, prompts and hints as rows.

A catalogue is plain data on the driver and becomes small tables when a job
needs it. Plug-ins add rows; no job code changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.session import BROADCAST_ROW_LIMIT

# Marks a rule whose rewrite is the balanced element edit of operators.rewrite.
ELEMENT_EDIT = "element-edit"
ANY = "*"
DOCS_DIR = Path(__file__).parent / "docs"


@dataclass(frozen=True)
class Rule:
    """One pattern. ``rewrite`` is ELEMENT_EDIT, a replacement text, a function
    from the content Column to a Column, or None for an ambiguous pattern."""

    pattern_id: str
    description: str
    complexity: str
    regex: str
    rewrite: str | Callable[[Column], Column] | None = None
    # A text every match holds; files without it skip the regex.
    needle: str | None = None

    @property
    def classification(self) -> str:
        return "ambiguous" if self.rewrite is None else "deterministic"


@dataclass(frozen=True)
class Check:
    """One check of rewritten text: a function from the content Column to an
    array of error texts (nulls are dropped). It passes if none is left."""

    stage: str
    order: int
    errors: Callable[[Column], Column]


@dataclass
class Catalog:
    frameworks: list = field(default_factory=list)
    migrations: list = field(default_factory=list)
    suffixes: dict = field(default_factory=dict)
    skip_dirs: dict = field(default_factory=dict)
    prompts: list = field(default_factory=list)
    examples: list = field(default_factory=list)
    hints: list = field(default_factory=list)
    docs: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)
    checks: list = field(default_factory=list)
    # framework -> function giving the aggregate that is true for its projects
    detectors: dict = field(default_factory=dict)

    # -- plug-ins -----------------------------------------------------------

    def register_rule(self, framework: str, migration: str, rule: Rule) -> None:
        self.rules.setdefault((framework, migration), []).append(rule)

    def register_check(self, check: Check) -> None:
        self.checks.append(check)
        self.checks.sort(key=lambda c: c.order)

    def register_framework(
        self,
        name: str,
        display_name: str,
        migrations: list,
        detector: Callable[[], Column],
        suffixes: dict,
        skip_dirs: list | None = None,
        docs: dict | None = None,
        prompts: dict | None = None,
        hints: dict | None = None,
        examples: dict | None = None,
    ) -> None:
        """Add a framework. Per-migration arguments are keyed by migration or "*"."""
        self.frameworks.append((name, display_name))
        self.migrations += [(name, *m) for m in migrations]
        self.detectors[name] = detector
        self.suffixes.update({(name, m): s for m, s in suffixes.items()})
        self.skip_dirs[name] = list(skip_dirs or [])
        self.docs.update({(name, m): text for m, text in (docs or {}).items()})
        self.prompts += [(name, m, text) for m, text in (prompts or {}).items()]
        self.hints += [(name, m, c, text) for (m, c), text in (hints or {}).items()]
        for m, pairs in (examples or {}).items():
            self.examples += [(name, m, i, u, a) for i, (u, a) in enumerate(pairs, 1)]

    # -- rules ----------------------------------------------------------------

    def rules_for(self, framework: str, migration: str) -> list[Rule]:
        """Rules in registration order; none for a migration without rules."""
        return list(self.rules.get((framework, migration), []))

    def rule(self, framework: str, migration: str, pattern_id: str) -> Rule | None:
        found = [r for r in self.rules_for(framework, migration) if r.pattern_id == pattern_id]
        return found[0] if found else None

    def keyed_rules(self) -> list:
        """The rules of all migrations: (framework, migration, number within the migration, rule)."""
        return [(fw, mig, i, r) for (fw, mig), rules in self.rules.items() for i, r in enumerate(rules)]

    # -- tables ---------------------------------------------------------------

    def migrations_table(self, spark: SparkSession) -> DataFrame:
        display = dict(self.frameworks)
        rows = [
            (i, fw, display[fw], mig, name, text, default)
            for i, (fw, mig, name, text, default) in enumerate(self.migrations)
        ]
        return small_table(
            spark, rows,
            "idx INT, framework STRING, framework_name STRING, id STRING, "
            "display_name STRING, description STRING, is_default BOOLEAN",
        )

    def frameworks_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, display) for i, (name, display) in enumerate(self.frameworks)]
        return small_table(spark, rows, "idx INT, framework STRING, framework_name STRING")

    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (fw, mig, i, r.pattern_id, r.description, r.complexity, r.regex, r.classification)
            for (fw, mig), rules in self.rules.items()
            for i, r in enumerate(rules)
        ]
        return small_table(
            spark, rows,
            "framework STRING, migration STRING, rule_idx INT, pattern_id STRING, "
            "description STRING, complexity STRING, regex STRING, classification STRING",
        )

    def _per_migration(self, table: dict) -> list:
        """(framework, migration, value) rows, the "*" value standing in where none is given."""
        rows = []
        for fw, mig, *_ in self.migrations:
            if (fw, mig) in table:
                rows.append((fw, mig, table[fw, mig]))
            elif (fw, ANY) in table:
                rows.append((fw, mig, table[fw, ANY]))
        rows += [(fw, mig, v) for (fw, mig), v in table.items() if mig == ANY]
        return rows

    def suffixes_table(self, spark: SparkSession) -> DataFrame:
        rows = [(fw, mig, s) for fw, mig, all_ in self._per_migration(self.suffixes) for s in all_]
        return small_table(spark, rows, "framework STRING, migration STRING, suffix STRING")

    def skip_dirs_table(self, spark: SparkSession) -> DataFrame:
        rows = sorted(
            (fw, name)
            for fw, _ in self.frameworks
            for name in {*fixed.DEFAULT_SKIP_DIRS, *self.skip_dirs.get(fw, [])}
        )
        return small_table(spark, rows, "framework STRING, dir STRING")

    def docs_table(self, spark: SparkSession) -> DataFrame:
        """One row per migration; a migration without a bundled guide gets a placeholder."""
        display = dict(self.frameworks)
        rows = [
            (
                fw, mig,
                self.docs.get((fw, mig))
                or f"# {display[fw]} {mig} Migration\n\nNo bundled docs found.",
            )
            for fw, mig, *_ in self.migrations
        ]
        return small_table(spark, rows, "framework STRING, migration STRING, text STRING")

    def prompts_table(self, spark: SparkSession) -> DataFrame:
        """System prompt, docs and example messages per migration."""
        docs = {(fw, mig): self.docs.get((fw, mig)) for fw, mig, *_ in self.migrations}
        display = dict(self.frameworks)
        rows = []
        for fw, mig, prompt in self._per_migration({(f, m): t for f, m, t in self.prompts}):
            if mig == ANY:
                continue
            text = docs[fw, mig] or f"# {display[fw]} {mig} Migration\n\nNo bundled docs found."
            pairs = sorted((o, u, a) for f, m, o, u, a in self.examples if (f, m) == (fw, mig))
            messages = []
            for _, user, assistant in pairs:
                messages.append({"role": "user", "content": user})
                messages.append({"role": "assistant", "content": assistant})
            rows.append((fw, mig, prompt.replace(fixed.DOCS_SLOT, text), messages))
        return small_table(
            spark, rows,
            "framework STRING, migration STRING, system STRING, "
            "examples ARRAY<STRUCT<role: STRING, content: STRING>>",
        )

    def hints_table(self, spark: SparkSession) -> DataFrame:
        """A hint per (framework, migration, category), "unknown" filling categories without one."""
        table: dict = {}
        for fw, mig, category, hint in self.hints:
            table.setdefault((fw, mig), {})[category] = hint
        rows = [
            (fw, mig, category, hint)
            for fw, mig, by_category in self._per_migration(table)
            for category, hint in by_category.items()
        ]
        return small_table(
            spark, rows, "framework STRING, migration STRING, category STRING, hint STRING"
        )


def small_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A local table of driver rows. Up to the row limit it is marked for broadcast."""
    schema = spark.createDataFrame([], ddl).schema
    columns = {
        f.name: [row[i] for row in rows] for i, f in enumerate(schema.fields)
    }
    arrow = pa.table(columns, schema=_arrow_schema(schema))
    df = spark.createDataFrame(arrow, schema=schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROW_LIMIT else df


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def same_key(framework: str, migration: str) -> Column:
    """True on rows of one migration, by their ``framework`` and ``migration``; false where either is null."""
    return F.coalesce((F.col("framework") == framework) & (F.col("migration") == migration), F.lit(False))


def default_migration(migrations: DataFrame) -> DataFrame:
    """Per framework the first migration flagged as default, else the first one."""
    first = F.min_by(
        F.struct("id", "display_name"), F.struct(~F.col("is_default"), F.col("idx"))
    )
    return migrations.groupBy("framework").agg(first.alias("m")).select(
        "framework", F.col("m.id").alias("migration"), F.col("m.display_name").alias("display_name")
    )


def load_docs(folder: Path = DOCS_DIR) -> dict:
    """Bundled guides, keyed by the ``framework__migration`` of their file names."""
    found = {}
    for file in sorted(folder.glob("*__*.md")):
        framework, migration = file.stem.split("__", 1)
        found[framework, migration] = file.read_text(encoding="utf-8")
    return found


def template_rules(wide_lookahead: bool = False) -> list[Rule]:
    """The rules for structural template directives.

    By default the look-ahead of ``ngif_simple`` ends with the attribute;
    ``wide_lookahead`` lets it see the rest of the file, where one aliased
    async pipe hides every earlier simple match.
    """
    rules = []
    for pattern_id, text, complexity, has_rewrite, needle, directive in fixed.TEMPLATE_RULES:
        if wide_lookahead and pattern_id == "ngif_simple":
            directive = fixed.NGIF_SIMPLE_WIDE_LOOKAHEAD
        rules.append(
            Rule(
                pattern_id, text, complexity, fixed.element_pattern(directive),
                ELEMENT_EDIT if has_rewrite else None, needle,
            )
        )
    return rules


def default_catalog() -> Catalog:
    """A fresh catalogue with the two built-in frameworks."""
    from shiftwright.operators import checks, detect

    catalog = Catalog(
        frameworks=list(fixed.FRAMEWORKS),
        migrations=list(fixed.MIGRATIONS),
        suffixes=dict(fixed.SUFFIXES),
        skip_dirs={k: list(v) for k, v in fixed.SKIP_DIRS.items()},
        prompts=list(fixed.SYSTEM_PROMPTS),
        examples=list(fixed.EXAMPLES),
        hints=list(fixed.HINTS),
        docs=load_docs(),
        rules={("angular", "control_flow"): template_rules()},
        detectors=dict(detect.BUILT_IN),
    )
    for check in checks.BUILT_IN:
        catalog.register_check(check)
    return catalog

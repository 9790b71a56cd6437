import pytest
from pyspark.sql import functions as F

from shiftwright import Rule, default_catalog
from shiftwright.catalog import default_migration
from shiftwright.operators import detect
from shiftwright.sources import files as sources

PROJECTS = {
    "ng": {"package.json": '{"devDependencies": {"@angular/core": "17"}}'},
    "re": {"package.json": '{"dependencies": {"react": "18"}, "scripts": {"test": "react-scripts test"}}'},
    "both": {"package.json": '{"dependencies": {"react": "18", "@angular/core": "17"}}'},
    "none": {"readme.md": "x", "sub/package.json": '{"dependencies": {"react": "18"}}'},
    "workspace": {"angular.json": "{}", "package.json": "{bad"},
    "cache": {".angular/cache/x": ""},
    "template": {"src/a.html": '<p [(ngModel)]="x">'},
    "hidden": {"node_modules/a.html": '<p *ngIf="x">', "pytest.ini": ""},
    "plain-react": {"package.json": '{"dependencies": {"react": "18"}, "scripts": {"test": "vitest"}}'},
    "no-script": {"package.json": '{"dependencies": {"react": "18"}}'},
}


@pytest.fixture(scope="module")
def facts(spark, catalog):
    rows = [(p, path, text) for p, files in PROJECTS.items() for path, text in files.items()]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    out = detect.with_test_command(detect.project_facts(files, catalog)).collect()
    return {r.project: (r.framework, " ".join(r.test_command) if r.test_command else None) for r in out}


def test_detection_and_test_commands(facts):
    once = "npm test -- --watchAll=false"
    assert facts == {
        "ng": ("angular", once), "re": ("react", once), "both": ("angular", once), "none": (None, None),
        "workspace": ("angular", "npx ng test --watch=false"), "cache": ("angular", None), "template": ("angular", None),
        "hidden": (None, "pytest --tb=short"), "plain-react": ("react", "npm test"), "no-script": ("react", None),
    }


def test_file_selectors(spark):
    df = spark.createDataFrame([
        (["npx", "ng", "test"], "src/a.component.html"), (["npx", "jest"], "src/a.test.ts"), (["npm", "test"], "b.ts"), (["ng"], "b.ts"),
    ], "c array<string>, p string")
    out = [" ".join(r[0]) for r in df.select(detect.file_test_command(F.col("c"), F.col("p"))).collect()]
    assert out == ["npx ng test --include=**/a.component.html", "npx jest a.test", "npm test", "ng"]


def test_resolution(spark):
    rows = [
        ("angular_control_flow", "react", None), ("control_flow", "react", "angular"), ("control_flow", None, "react"),
        ("control_flow", "", None), ("vue_", None, None),
    ]
    df = spark.createDataFrame(rows, "migration_type string, framework string, detected string")
    out = [(r.resolved_framework, r.resolved_migration) for r in detect.resolve_migration(df).collect()]
    assert out == [
        ("angular", "control_flow"), ("react", "control_flow"), ("react", "control_flow"), ("angular", "control_flow"), ("vue", ""),
    ]


def test_catalogue_lookup(spark, catalog):
    df = spark.createDataFrame(
        [(1, "Angular", "control-flow"), (2, "react", None), (3, "vue", "x"), (4, "react", "control_flow")],
        "id int, framework string, migration string",
    )
    out = {r.id: (r.framework, r.migration, r.error) for r in detect.validate_requests(df, catalog).collect()}
    assert out == {
        1: ("angular", "control_flow", None), 2: ("react", "class_to_hooks", None),
        3: ("vue", "x", "unknown framework"), 4: ("react", "control_flow", "unknown migration"),
    }


def test_catalogue_tables(spark, catalog):
    assert [r.id for r in catalog.migrations_table(spark).orderBy("idx").collect()] == [
        "control_flow", "standalone_components", "class_to_hooks", "cra_to_vite", "router_v5_to_v6"
    ]
    docs = {(r.framework, r.migration): r.text for r in catalog.docs_table(spark).collect()}
    assert docs["react", "cra_to_vite"] == "# React cra_to_vite Migration\n\nNo bundled docs found."
    assert docs["angular", "control_flow"].startswith("# Angular")
    suffixes = {r.suffix for r in catalog.suffixes_table(spark).filter("migration = 'cra_to_vite'").collect()}
    assert ".json" in suffixes
    skip = {r.dir for r in catalog.skip_dirs_table(spark).filter("framework = 'react'").collect()}
    assert {".next", "venv", "node_modules"} <= skip
    rules = catalog.rules_table(spark).orderBy("rule_idx").collect()
    assert [r.pattern_id for r in rules][:2] == ["ngif_then_else", "ngif_else"] and len(rules) == 7
    assert catalog.rule("angular", "control_flow", "ngswitch").complexity == "medium"
    assert catalog.rule("angular", "control_flow", "nope") is None
    assert catalog.rules_for("react", "class_to_hooks") == []


def test_plug_in_framework(spark):
    catalog = default_catalog()
    catalog.register_framework(
        "vue", "Vue", [("options_api", "Options", "Options to composition", False), ("vue3", "Vue 3", "Vue 2 to 3", False)],
        lambda: F.bool_or(detect.depends_on("vue")), {"*": [".vue"]}, ["dist"], hints={("*", "unknown"): "look again"},
    )
    catalog.register_rule("vue", "vue3", Rule("filter", "", "simple", r"\|\s*\w+"))
    files = spark.createDataFrame(
        [("v", "package.json", '{"dependencies": {"vue": "2"}}')], "project string, path string, content string"
    )
    assert detect.detect_framework(files, catalog).first().framework == "vue"
    assert catalog.rules_for("vue", "vue3")[0].classification == "ambiguous"
    defaults = {r.framework: r.migration for r in default_migration(catalog.migrations_table(spark)).collect()}
    assert defaults == {"angular": "control_flow", "react": "class_to_hooks", "vue": "options_api"}
    assert default_catalog().frameworks == [("angular", "Angular"), ("react", "React")]


def test_manifests(spark):
    df = spark.createDataFrame([
        ("ok", '{"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"a": "2"}}'), ("bad", "{"), ("list", "[1]"), ("empty", "{}"),
    ], "id string, c string").withColumn("m", sources.parse_manifest(F.col("c")))
    out = {r.id: r for r in df.withColumn("d", F.when(F.col("m").isNotNull(), sources.merged_dependencies(F.col("m")))).collect()}
    assert out["ok"].d == {"a": "2", "b": "1"}
    assert out["bad"].m is None and out["list"].m is None and out["empty"].d == {}


def test_custom_suffixes_follow_the_name(spark):
    files = spark.createDataFrame([("my_angular_rules", p) for p in ("a.html", "a.ts")] + [
        ("react_x", p) for p in ("a.tsx", "a.html")] + [("other", p) for p in ("a.html", "a.ts", "a.py")], "m string, path string")
    kept = {tuple(r) for r in detect.select_custom_files(files, F.col("m")).collect()}
    assert kept == {("my_angular_rules", "a.html"), ("react_x", "a.tsx"), ("other", "a.html"), ("other", "a.ts")}

import re

import pytest
from pyspark.sql import functions as F

from shiftwright import Rule, template_rules
from shiftwright.operators import scan

GOLDEN = """<p *ngIf="isLoggedIn">Welcome</p>

<div *ngIf="ok; else no">
  <h2>x</h2>
</div>
<div *ngIf="busy; then wait; else done"></div>
<li *ngFor="let i of items; trackBy: t">1</li><li *ngFor="
  let i of items">missed</li>
<div [ngSwitch]="s"><p *ngSwitchCase="1">a</p></div>
<b *ngFor="let q of a.b">é😀
</b><b *ngIf="d$ | async as d">x</b>
"""


def found(df):
    return [
        (r.pattern_id, r.line, r.column)
        for r in scan.ordered(df).collect()
    ]


def test_rules_in_order_with_double_counts(corpus):
    matches = scan.find_matches(corpus({"a.html": GOLDEN}), template_rules())
    assert found(matches) == [
        ("ngif_simple", 1, 1),
        ("ngif_else", 3, 1), ("ngif_simple", 3, 1),
        ("ngif_then_else", 6, 1), ("ngif_simple", 6, 1),
        ("ngfor_trackby", 7, 1),
        ("ngswitch", 9, 1),
        ("ngfor_simple", 10, 1),
        ("ngif_async_pipe", 11, 5),
    ]


def test_wide_lookahead_hides_earlier_matches(corpus):
    matches = scan.find_matches(corpus({"a.html": GOLDEN}), template_rules(wide_lookahead=True))
    assert "ngif_simple" not in [m[0] for m in found(matches)]


@pytest.mark.parametrize("text", [
    "a\r\nb<x>\r<x>y\n\n<x>", "<x><x>", "😀<x>\n😀é<x>z", "", "\u0001<x>\u0002\n\u0001<x>", "no match", "<x>\n" * 50,
])
def test_offsets_equal_finditer(corpus, text):
    rules = [Rule("x", "", "simple", "(?s)<x>", ""), Rule("line", "", "simple", r"\n.", None)]
    rows = scan.ordered(scan.find_matches(corpus({"f": text}), rules)).collect()
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    expected = sorted(
        (m.start(), i, plain[: m.start()].count("\n") + 1, m.start() - plain.rfind("\n", 0, m.start()))
        for i, pattern in enumerate([r"(?s)<x>", r"\n."])
        for m in re.finditer(pattern, plain)
    )
    assert [(r.start, r.rule_idx, r.line, r.column) for r in rows] == expected


def test_snippet_is_cut_and_text_kept_apart(corpus):
    text = "<p *ngIf=\"a\">" + "x" * 500 + "</p>"
    row = scan.find_matches(corpus({"f.html": text}), template_rules()).first()
    assert row.snippet == text[:120]


def test_no_rules_no_matches_no_tasks(corpus):
    files = corpus({"a.tsx": "class A extends Component {}"})
    assert scan.find_matches(files, []).count() == 0
    assert scan.file_tasks(files, []).count() == 0
    routed = scan.file_tasks(files, [], route_unmatched="ambiguous").first()
    assert (routed.strategy, routed.complexity) == ("ambiguous", "simple")


def test_tasks_and_summary(corpus, spark):
    files = corpus({
        "det.html": '<p *ngIf="a">x</p>', "amb.html": '<p *ngIf="a | async as b; else c">x</p>', "none.html": "x",
    }).unionByName(spark.createDataFrame([("q", "bad.html", None)], "project string, path string, content string"))
    tasks = {r.path: (r.strategy, r.complexity) for r in scan.file_tasks(files, template_rules()).collect()}
    # The alias with an else matches the else rule as well: ambiguous, yet of medium complexity.
    assert tasks == {"det.html": ("deterministic", "simple"), "amb.html": ("ambiguous", "medium")}
    again = scan.tasks_from_matches(scan.find_matches(files, template_rules()))
    assert {r.path: (r.strategy, r.complexity) for r in again.collect()} == tasks
    summary = {r.project: tuple(r)[1:] for r in scan.scan_summary(files, template_rules()).collect()}
    assert summary == {"p": (3, 3, 2, 1), "q": (1, 0, 0, 0)}


def test_first_applicable_skips_ambiguous(corpus):
    matches = scan.find_matches(
        corpus({"f.html": '<b *ngIf="a | async as c">1</b><i *ngIf="x">2</i><u *ngIf="y">3</u>'}), template_rules()
    )
    row = scan.first_applicable(matches).first()
    assert (row.pattern_id, row.column) == ("ngif_simple", 32)
    assert scan.first_applicable(matches, "ngswitch").count() == 0


def test_select_files(corpus):
    files = corpus({
        "a.html": "", "src/b.html": "", "node_modules/x/c.html": "", "dist.html": "", "a/dist/d.html": "", "e.ts": "",
    })
    kept = {r.path for r in scan.select_files(files, [".html"], ["node_modules", "dist"]).collect()}
    assert kept == {"a.html", "src/b.html", "dist.html"}
    assert scan.select_files(files, [], []).count() == 0


def test_scan_reads_content_once_and_shuffles_no_text(corpus):
    plan = scan.find_matches(corpus({"a.html": GOLDEN}), template_rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    counted = scan.file_tasks(corpus({"a.html": GOLDEN}), template_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted
    # Each pattern is counted once, whatever uses the counts.
    for rule in template_rules():
        assert counted.count(rule.regex) == 1


def test_scan_documents_by_file(corpus):
    files = corpus({f"f{i}.html": '<p *ngIf="a">x</p>' for i in range(30)})
    documents = scan.scan_documents(scan.find_matches(files, template_rules()), files, "angular", "control_flow")
    rows = documents.withColumn(
        "d", F.from_json("document", "total_files_scanned INT, results ARRAY<STRUCT<file_path: STRING>>")
    ).collect()
    assert [r.d.total_files_scanned for r in rows if r.path is None] == [30]
    assert sorted(x.file_path for r in rows if r.path for x in r.d.results) == sorted(f"f{i}.html" for i in range(30))

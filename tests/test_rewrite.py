import random

import pytest
from pyspark.sql import functions as F

from shiftwright import Rule
from shiftwright.operators import diff, rewrite


def run(corpus, texts, pattern_id=None):
    out = rewrite.rewrite_templates(corpus(texts), pattern_id).collect()
    return {r.path: r for r in out}


def one(corpus, text, pattern_id=None):
    return run(corpus, {"f.html": text}, pattern_id)["f.html"]


CASES = {
    "simple": ('<div *ngIf="isVisible"><p>Hello</p></div>', "@if (isVisible) {\n  <div><p>Hello</p></div>\n}"),
    "both sides": ('<p class="a" *ngIf="x" id="b">y</p>', '@if (x) {\n  <p class="a"  id="b">y</p>\n}'),
    "same tag nested": (
        '<div *ngFor="let u of us; trackBy: t"><div *ngIf="u.a" class="c"><span *ngIf="!u.b">m</span></div></div>',
        '@for (u of us; track t($index, u)) {\n  <div>@if (u.a) {\n  <div class="c">@if (!u.b) {\n  <span>m</span>\n}</div>\n}</div>\n}',
    ),
    "else": (
        '<div *ngIf="in; else out">\n  <p>Hi</p>\n</div>\n<ng-template #out>\n  <p>Log in.</p>\n</ng-template>',
        "@if (in) {\n  <div>\n  <p>Hi</p>\n</div>\n} @else {\n  <p>Log in.</p>\n}\n",
    ),
    "then else": (
        'a <div *ngIf="x; then t; else e"></div>\n\n<ng-template #t>1</ng-template>\n<ng-template #e>2</ng-template>\n\nz',
        "a @if (x) {\n  1\n} @else {\n  2\n}\nz",
    ),
    "missing template": (
        '<i *ngIf="x; else nope">b</i>',
        "@if (x) {\n  <i>b</i>\n} @else {\n  <!-- WARNING: ng-template #nope not found -->\n}",
    ),
    "unused template": ('<i *ngIf="x">b</i><ng-template #t>1</ng-template>', "@if (x) {\n  <i>b</i>\n}<ng-template #t>1</ng-template>"),
    "for": ('<li *ngFor="let item of items">{{ item.name }}</li>', "@for (item of items; track item) {\n  <li>{{ item.name }}</li>\n}"),
    "for locals": (
        '<li *ngFor="let a of b.c; let i = index; trackBy: f; let odd=odd; nothing">x</li>',
        "@for (a of b.c; track f($index, a); let i = $index; let odd = $odd) {\n  <li>x</li>\n}",
    ),
    "switch": (
        "<div [ngSwitch]=\"status\">\n  <p *ngSwitchDefault>?</p>\n  <p *ngSwitchCase=\"'a'\" class=\"k\">A</p> stray\n</div>",
        "@switch (status) {\n  @case ('a') {\n    <p class=\"k\">A</p>\n  }\n  @default {\n    <p>?</p>\n  }\n}",
    ),
    "empty switch": ('<p [ngSwitch]="z">w</p>', "@switch (z) {\n\n}"),
    "greater sign in quotes": ('<p title="a > b" *ngIf="n > 0">x</p>', '@if (n > 0) {\n  <p title="a > b">x</p>\n}'),
    "comment and script": (
        '<!-- <p *ngIf="a">b</p> --><script>"<p *ngIf=\'x\'>"</script><p *ngIf="q">r</p>',
        '<!-- <p *ngIf="a">b</p> --><script>"<p *ngIf=\'x\'>"</script>@if (q) {\n  <p>r</p>\n}',
    ),
    "windows lines": ('<p *ngIf="a">x\r\ny</p>\r\n', "@if (a) {\n  <p>x\ny</p>\n}\n"),
    "dollar and backslash": ('<p *ngIf="a$">\\1 $2</p>', "@if (a$) {\n  <p>\\1 $2</p>\n}"),
}


def test_cases(corpus):
    out = run(corpus, {name: text for name, (text, _) in CASES.items()})
    for name, (_, expected) in CASES.items():
        assert out[name].after == expected, name
        assert out[name].success and out[name].was_modified, name


def test_ambiguous_is_skipped(corpus):
    row = one(corpus, '<div *ngIf="data$ | async as data"><p>{{ data }}</p></div>')
    assert row.after == row.before and row.skipped == ["ngif_async_pipe"] and row.applied == [] and row.success


@pytest.mark.parametrize("text,error", [
    ('<b *ngIf="a"><i *ngIf="c"></b></i>', "misnested directives"),
    ('<i *ngIf="x; else a">b</i><ng-template #a><b *ngIf="y; else a">q</b></ng-template>', "template reference cycle"),
    ('<i *ngIf="x; else a">b</i><br *ngIf="x; else a"><ng-template #a>1</ng-template>', "template shared with an element left as it is"),
    ('<a [ngSwitch]="x"><b [ngSwitch]="y"></b></a>', "switch inside a switch but outside its cases"),
])
def test_errors_leave_the_file(corpus, text, error):
    row = one(corpus, text)
    assert row.error == error and not row.success and row.after == row.before


def test_unreadable_file_fails_alone(spark, corpus):
    files = corpus({"ok.html": '<p *ngIf="a">x</p>'}).unionByName(
        spark.createDataFrame([("p", "bad.html", None)], "project string, path string, content string")
    )
    out = {r.path: r for r in rewrite.rewrite_templates(files).collect()}
    assert out["bad.html"].error == "unreadable text" and out["bad.html"].after is None
    assert out["ok.html"].success


def test_one_pattern_only(corpus):
    row = one(corpus, '<p *ngIf="a">x</p><q *ngFor="let x of y">z</q>', "ngif_simple")
    assert row.after == '@if (a) {\n  <p>x</p>\n}<q *ngFor="let x of y">z</q>'
    assert row.applied == ["ngif_simple"] and row.unresolved == 0


def test_unresolved_are_counted(corpus):
    row = one(corpus, '<br *ngIf="a"><p *ngIf="z">w <li *ngFor=" let q of r">1</li><b *ngIf="x" *ngFor="let a of b">2</b>')
    assert row.unresolved == 4 and row.after == row.before


def _random_template(rng, depth):
    """A random template and what it must become, side by side."""
    source, expected = [], []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["text", "plain", "if", "for", "switch"] if depth else ["text"])
        tag = rng.choice(["div", "p", "span"])
        if kind == "text":
            word = rng.choice(["x", " ", "é😀", "{{ a }}", "\n", "<br>", "<!-- <div> -->"])
            source.append(word)
            expected.append(word)
            continue
        inner_source, inner_expected = _random_template(rng, depth - 1)
        if kind == "plain":
            source.append(f"<{tag}>{inner_source}</{tag}>")
            expected.append(f"<{tag}>{inner_expected}</{tag}>")
        elif kind == "if":
            source.append(f'<{tag} *ngIf="c > 1" id="k">{inner_source}</{tag}>')
            expected.append(f'@if (c > 1) {{\n  <{tag} id="k">{inner_expected}</{tag}>\n}}')
        elif kind == "for":
            source.append(f'<{tag} *ngFor="let a of b">{inner_source}</{tag}>')
            expected.append(f"@for (a of b; track a) {{\n  <{tag}>{inner_expected}</{tag}>\n}}")
        else:
            cases = [(str(i), *_random_template(rng, depth - 1)) for i in range(rng.randint(0, 2))]
            blocks = [(f'<{tag} *ngSwitchCase="{v}">{s}</{tag}>', f"  @case ({v}) {{\n    <{tag}>{e}</{tag}>\n  }}") for v, s, e in cases]
            sources, results = [b[0] for b in blocks], [b[1] for b in blocks]
            if rng.random() < 0.5:
                sources.insert(rng.randint(0, len(sources)), f"<{tag} *ngSwitchDefault>{inner_source}</{tag}>")
                results.append(f"  @default {{\n    <{tag}>{inner_expected}</{tag}>\n  }}")
            source.append(f'<{tag} [ngSwitch]="v">' + " stray <i>s</i>".join(sources) + f"</{tag}>")
            expected.append("@switch (v) {\n" + "\n".join(results) + "\n}")
    return "".join(source), "".join(expected)


def test_random_nesting(corpus):
    rng = random.Random(7)
    made = {f"f{i}": _random_template(rng, 4) for i in range(300)}
    out = run(corpus, {name: source for name, (source, _) in made.items()})
    for name, (source, expected) in made.items():
        assert out[name].after == expected, source


def test_one_shuffle(corpus):
    df = rewrite.rewrite_templates(corpus({"f": CASES["else"][0]}))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The second mention is the reuse of the first.
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1


def test_control_characters_stay(corpus):
    texts = {c: f'<p *ngIf="a{c}">x{c}e</p>' for c in "\u0001\u0003\u0004\u0005"}
    for row in rewrite.rewrite_templates(corpus(texts)).collect():
        assert row.after == f"@if (a{row.path}) {{\n  <p>x{row.path}e</p>\n}}" and row.before == texts[row.path]


def test_plug_in_rules(corpus):
    rules = [
        Rule("nested", "", "simple", r"\(\(([a-z]*)\)\)", r"($1)"),
        Rule("upper", "", "simple", "x", lambda c: F.replace(c, F.lit("x"), F.lit("y"))),
        Rule("grow", "", "simple", "g", "gg"),
        Rule("look", "", "ambiguous", "q"),
    ]
    out = {r.path: r for r in rewrite.apply_rules(corpus({"a": "((((a)))) x q", "b": "none", "c": "g"}), rules, rounds=5).collect()}
    assert out["a"].after == "(a) y q" and out["a"].applied == ["nested", "upper"] and out["a"].skipped == ["look"]
    assert not out["b"].was_modified
    assert out["c"].exhausted == ["grow"] and out["c"].after == "g"
    assert out["c"].error == "rules that do not settle: grow" and not out["c"].success and out["c"].applied == []
    deep = {"d": "(" * 90 + "a" + ")" * 90, "c": "g" * 50}
    out = {r.path: r for r in rewrite.apply_rules(corpus(deep), rules).collect()}
    assert out["d"].after == "(a)" and out["d"].success
    assert out["c"].after == "g" * 50 and not out["c"].success


def test_callable_errors_stay_with_their_file(corpus):
    def edit(text):
        if "bad" in text:
            raise ValueError("no")
        return text.upper()

    out = {r.path: r for r in rewrite.map_rewrite(corpus({"a": "ok", "b": "bad"}), edit).collect()}
    assert out["a"].after == "OK" and out["b"].error == "no" and out["b"].after == "bad"


def test_line_diff(spark):
    rows = [("p", "f", "a\nb\na\nc\n", "a\na\na\nd"), ("p", "same", "x", "x")]
    df = spark.createDataFrame(rows, "project string, path string, before string, after string")
    changes = {(r.text, r.nth, r.change) for r in diff.line_diff(df).collect()}
    assert changes == {("a", 1, "kept"), ("a", 2, "kept"), ("a", 3, "added"), ("b", 1, "removed"), ("c", 1, "removed"), ("d", 1, "added")}
    text = diff.diff_text(diff.line_diff(df)).first().diff
    assert text.splitlines() == ["--- a/f", "+++ b/f", "-b", "+a", "-c", "+d"]


def test_a_settling_rule_may_grow_a_text_at_every_size(corpus):
    rules = [Rule("widen", "Widen", "simple", "abcd", "x" * 120)]
    texts = {f"f{n}": "abcd" * n for n in (1, 500, 20_000)}
    for r in rewrite.apply_rules(corpus(texts), rules).collect():
        assert r.success and r.after == "x" * (30 * len(texts[r.path]))


def test_rules_that_do_not_settle_end_with_an_error(corpus):
    swap = Rule("swap", "Swap", "simple", "^(a|b|c)", lambda t: F.translate(t, "abc", "bca"))
    double = Rule("double", "Double", "simple", "g", "gg")
    texts = {"cycle": "a" * 5000, "grow": "g" * 300, "fine": "zzz"}
    out = {r.path: r for r in rewrite.apply_rules(corpus(texts), [swap, double]).collect()}
    assert out["cycle"].exhausted == ["swap"] and out["cycle"].after == texts["cycle"]
    assert out["grow"].exhausted == ["double"] and out["grow"].after == texts["grow"] and out["grow"].applied == []
    assert out["fine"].success


PIECES = [
    '<div *ngIf="a">', '<div *ngIf="b; else t">', '<i *ngIf="c; then t; else u">', '<i *ngIf="d$ | async as d; else t">', '<div [ngSwitch]="s">',
    '<b *ngSwitchCase="1">', '<b *ngSwitchDefault>', '<i *ngFor="let x of xs">', "<ng-template #t>", "<ng-template #u>", "<br *ngIf='e'>",
    '<b *ngIf="g" *ngFor="let y of ys">', "</div>", "</div>", "</b>", "</b>", "</i>", "</i>", "</ng-template>", "</ng-template>", " x ", "<p>",
]


def test_windows_and_rows_plan_the_same_edits(spark, monkeypatch):
    rng = random.Random(11)

    def nested(depth):
        if depth == 0:
            return rng.choice(["x", " ", "<p>y</p>"])
        opening = rng.choice([p for p in PIECES if p.startswith("<") and not p.startswith(("</", "<br", "<p"))])
        inner = "".join(nested(depth - rng.randint(1, depth)) for _ in range(rng.randint(0, 4)))
        return f"{opening}{inner}</{opening[1:].split(' ')[0].rstrip('>')}>"

    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(300)]
    texts += ["".join(nested(4) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    files = spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], "project string, path string, content string")
    for pattern in (None, "ngswitch"):
        within = {r.path: r for r in rewrite.rewrite_templates(files, pattern).collect()}
        with monkeypatch.context() as m:
            m.setattr(rewrite, "FEW_DIRECTIVES", 0)
            assert {r.path: r for r in rewrite.rewrite_templates(files, pattern).collect()} == within
        assert {r.error for r in within.values()} > {None, "misnested directives"}


def test_files_of_few_directives_are_planned_without_windows(corpus):
    files = corpus({"f": '<div *ngIf="a">x</div>'}).select("project", "path", F.col("content").alias("before"))
    plan = rewrite.row_plans(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_files_of_few_directives_take_no_steps_over_arrays(corpus):
    files = corpus({"f": '<div *ngIf="a">x</div>'}).select("project", "path", F.col("content").alias("before"))
    plan = rewrite.row_plans(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_files_with_directives_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = spark.range(100).selectExpr("'p' AS project", "'f' || id AS path", """'<p *ngIf="a">' || id || '</p>' AS content""")
    files = texts.mapInArrow(rows, "project string, path string, content string")
    assert rewrite.rewrite_templates(files).where("was_modified").count() == 100
    assert read.value == 100


ODD_PIECES = [
    '<b *ngIf="é; else tü">', "<ng-template #tü>", '<i *ngIf="x; else@NBSPt">', '<i *ngIf="x;@FSelse t">', '<i *ngFor="let @CIRCLED of xs">',
    '<i *ngFor="let x of xs; trackBy: né; let ² = a; let o=odd">', '<script@E *ngIf="q">', "</script>", '<@LONGS *ngIf="k">', "<B *ngIf='h'>", "</B>",
    "<ng-template #@ACUTE>", '<div *ngIf="a@MARK; else t"/>', "@MARK", "<!--", "-->", "@THIN", '<b *ngIf="r">', '<div [ngSwitch]=" s ">', "$1@BACK",
]
ODD = {"NBSP": 0xA0, "FS": 0x1C, "CIRCLED": 0x24B6, "E": 0xE9, "LONGS": 0x17F, "ACUTE": 0x301, "MARK": 0x4, "THIN": 0x2009, "BACK": 0x5C}


def test_windows_and_rows_read_odd_characters_alike(spark, monkeypatch):
    pieces = list(ODD_PIECES)
    for name, code in ODD.items():
        pieces = [p.replace(f"@{name}", chr(code)) for p in pieces]
    rng = random.Random(5)
    texts = ["".join(rng.choices(pieces + PIECES, k=rng.randint(1, 16))) for _ in range(400)]
    files = spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], "project string, path string, content string")
    # Some with bytes that are no UTF-8.
    broken = F.concat(F.col("content").cast("binary"), F.unhex(F.lit("C3E282")), F.lit('<b *ngIf="a">').cast("binary"), F.unhex(F.lit("FF")))
    files = files.unionByName(files.limit(50).select("project", F.concat(F.lit("b"), "path").alias("path"), broken.cast("string").alias("content")))

    def found():
        out = rewrite.rewrite_templates(files).withColumns({c: F.hex(c) for c in ("before", "after")})
        return {r.path: r for r in out.collect()}

    within = found()
    monkeypatch.setattr(rewrite, "FEW_DIRECTIVES", 0)
    assert found() == within and len(within) == 450


def test_long_results_leave_a_worker_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rewrite, "ROW_BATCH_CHARS", 50)
    files = spark.range(40).coalesce(1).selectExpr("'p' AS project", "'f' || id AS path", """'<p *ngIf="a">' || id || '</p>' AS content""")
    out = {r.path: r.after for r in rewrite.rewrite_templates(files).collect()}
    assert out == {f"f{i}": f"@if (a) {{\n  <p>{i}</p>\n}}" for i in range(40)}


def test_rules_work_on_files_of_one_piece_in_many_tasks(spark):
    files = spark.range(400).coalesce(1).selectExpr("'p' AS project", "'f' || id AS path", "repeat('(', 60) || repeat(')', 60) AS content")
    out = rewrite.apply_rules(files, [Rule("brackets", "Brackets", "simple", r"\(\(\)\)", "()")])
    tasks = out.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("after") == "()").alias("n")).collect()
    assert sum(r.n for r in tasks) == 400 and len(tasks) > 1


def test_each_rule_is_folded_once_in_the_plan(corpus):
    rules = [Rule("a", "A", "simple", "<b>", "<i>"), Rule("b", "B", "simple", "</b>", "</i>")]
    out = rewrite.apply_rules(corpus({"a": "<b>x</b>"}), rules)
    plan = out.filter("after <> before").groupBy("project").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 * len(rules)


def patched(before, text):
    """What a patch program makes of a unified diff."""
    lines, out, at = before.splitlines(keepends=True), [], 0
    for line in text.replace("\n\\ No newline at end of file\n", "\x00").split("\n")[2:]:
        for part in [x + ("" if i < line.count("\x00") else "\n") for i, x in enumerate(line.split("\x00"))]:
            if part.startswith("@@"):
                begin, size = map(int, part.split()[1][1:].split(","))
                start = begin - (size > 0)
                out += lines[at:start]
                at = start
            elif part.startswith("+"):
                out.append(part[1:])
            elif part[0] in " -":
                assert lines[at] == part[1:], (lines[at], part)
                out += [part[1:]] * (part[0] == " ")
                at += 1
    return "".join(out + lines[at:])


def test_ordered_diff_applies(spark):
    rng = random.Random(4)
    rows = [("p", "empty", "", "a\nb"), ("p", "gone", "a\nb\n", None), ("p", "end", "a\nb", "a\nb\n"), ("p", "same", "x", "x"),
            ("p", "moved", "a\nb\nc\nd\ne\n", "d\ne\na\nb\nc\n"), ("p", "null", None, "x\n")]
    for k in range(60):
        before = [rng.choice("abcdefghij{}") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))]
        after = [x for x in before if rng.random() > 0.1]
        for _ in range(rng.randint(0, 4)):
            after.insert(rng.randint(0, len(after)), rng.choice(["new", "}", "x"]))
        rows.append(("p", f"f{k}", "\n".join(before) + rng.choice(["", "\n"]), "\n".join(after) + rng.choice(["", "\n"])))
    df = spark.createDataFrame(rows, "project string, path string, before string, after string")
    text = diff.unified_text(diff.ordered_diff(df))
    texts = {r.path: r.diff for r in text.collect()}
    assert "same" not in texts
    for _, path, before, after in rows:
        if (before or "") != (after or ""):
            assert patched(before or "", texts[path]) == (after or "")
    done = {r.path: r for r in diff.apply_unified(df.drop("after").join(text, ["project", "path"], "left")).collect()}
    assert all(done[path].clean and done[path].after == (after or "") for _, path, _, after in rows)
    wrong = diff.apply_unified(df.select("project", "path", F.lit("other\n").alias("before")).join(text, ["project", "path"]))
    assert not {r.path: r.clean for r in wrong.collect()}["moved"]


def test_ordered_diff_hunks(spark):
    before = "".join(f"line {i}\n" for i in range(30))
    after = before.replace("line 3\n", "LINE 3\n").replace("line 9\n", "").replace("line 25\n", "line 25\nmore\n")
    df = spark.createDataFrame([("p", "f", before, after)], "project string, path string, before string, after string")
    hunks = [tuple(r)[2:7] for r in diff.ordered_diff(df).orderBy("hunk").collect()]
    assert hunks == [(1, 1, 13, 1, 12), (2, 24, 6, 23, 7)]
    assert diff.ordered_diff(df).where("hunk = 2").first().body == " line 23\n line 24\n line 25\n+more\n line 26\n line 27\n line 28\n"

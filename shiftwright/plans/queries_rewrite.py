"""Registered queries: corpus rewrite, line differences, history.

The templates are put together from table columns, and so is the text each
rewrite must give: the SQL side uses no regular expression for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright.catalog import Rule
from shiftwright.operators import diff, rewrite, state
from shiftwright.plans.tables import ORDERS_SQL, PAGES_SQL, PARTS_SQL, order_files, pages, part_files, read
from shiftwright.session import shared_path
from shiftwright.sources import sinks


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def by_status(status, f, o, other):
    def column(value):
        return F.lit(value) if isinstance(value, str) else value

    return F.when(status == "F", column(f)).when(status == "O", column(o)).otherwise(column(other))


def result(files, pattern_id=None):
    return rewrite.rewrite_templates(files, pattern_id).select(
        "project", "path", "after", F.array_join("applied", ",").alias("applied"),
        F.array_join("skipped", ",").alias("skipped"), "unresolved", "was_modified", "error",
    )


def expected(source: str, text: str, applied: str, skipped: str = "''", unresolved: str = "0",
             error: str = "NULL", modified: str = "true") -> str:
    return (
        f"SELECT project, path, {text} AS after, {applied} AS applied, {skipped} AS skipped, "
        f"({unresolved})::BIGINT AS unresolved, {modified} AS was_modified, {error}::VARCHAR AS error FROM {source}"
    )


# -- conditions ------------------------------------------------------------------


def _if_content(key, total, status):
    tag = by_status(status, "div", "section", "span")
    return cat(
        "<h1>", key, "</h1>\r\n<", tag, by_status(status, ' class="o"', "", ' id="x"'), ' *ngIf=" total > ', total, ' "',
        by_status(status, "", ' class="late" [title]="a > b"', ' class="z"'), "><p>Order ", key, "</p><br></", tag, ">\n",
    )


def rewrite_if(spark, sf):
    return result(order_files(spark, sf, _if_content))


_IF_TAG = "CASE s WHEN 'F' THEN 'div' WHEN 'O' THEN 'section' ELSE 'span' END"
_IF_TEXT = f"""'<h1>' || k || '</h1>' || chr(10) || '@if (total > ' || t || ') {{' || chr(10) || '  <' || {_IF_TAG}
  || CASE s WHEN 'F' THEN ' class="o"' WHEN 'O' THEN ' class="late" [title]="a > b"' ELSE ' id="x"  class="z"' END
  || '><p>Order ' || k || '</p><br></' || {_IF_TAG} || '>' || chr(10) || '}}' || chr(10)"""


def _else_content(key, total, status):
    """Orders in status P name a template that is not there."""
    return cat(
        '<div *ngIf="paid', key, "; else ", by_status(status, "due", "due", "none"), '">paid ', total, "</div>\n\n",
        '<ng-template #due>\n  <i *ngIf="late">', key, "</i> due\n</ng-template>\n\n<p>", total, "</p>",
    )


def rewrite_else(spark, sf):
    return result(order_files(spark, sf, _else_content))


_ELSE_TEXT = """'@if (paid' || k || ') {' || chr(10) || '  <div>paid ' || t || '</div>' || chr(10) || '} @else {' || chr(10) || '  '
  || CASE WHEN s = 'P' THEN '<!-- WARNING: ng-template #none not found -->'
     ELSE '@if (late) {' || chr(10) || '  <i>' || k || '</i>' || chr(10) || '} due' END
  || chr(10) || '}'
  || CASE WHEN s = 'P' THEN chr(10) || chr(10) || '<ng-template #due>' || chr(10) || '  @if (late) {' || chr(10) || '  <i>' || k
          || '</i>' || chr(10) || '} due' || chr(10) || '</ng-template>' || chr(10) || chr(10) ELSE chr(10) END
  || '<p>' || t || '</p>'"""


def _then_else_content(key, total, status):
    return cat(
        "<p>", key, '</p><div *ngIf="busy; then wait; else ', by_status(status, "done", "wait", "done"),
        '"><b *ngIf="dropped">gone</b></div>\n<ng-template #wait> wait ', key, " </ng-template>\n",
        "<ng-template #done><u>", total, "</u></ng-template>\n",
    )


def rewrite_then_else(spark, sf):
    return result(order_files(spark, sf, _then_else_content))


_THEN_ELSE_TEXT = """'<p>' || k || '</p>@if (busy) {' || chr(10) || '  wait ' || k || chr(10) || '} @else {' || chr(10) || '  '
  || CASE s WHEN 'O' THEN 'wait ' || k ELSE '<u>' || t || '</u>' END || chr(10) || '}'
  || chr(10) || CASE s WHEN 'O' THEN '<ng-template #done><u>' || t || '</u></ng-template>' || chr(10) ELSE '' END"""


def _chain_content(key, total, status):
    """Templates that use templates; in status P they use each other in a circle."""
    return cat(
        '<i *ngIf="a; else one">', key, '</i><ng-template #one>[<b *ngIf="b; else two">', total,
        "</b>]</ng-template><ng-template #two>(",
        by_status(
            status, '<u *ngIf="c; else three">u</u>', cat("<u>", key, "</u>"), '<u *ngIf="c; else one">u</u>'
        ),
        ")</ng-template><ng-template #three>end ", key, "</ng-template>.",
    )


def rewrite_chain(spark, sf):
    return result(order_files(spark, sf, _chain_content))


_CHAIN_SOURCE = """'<i *ngIf="a; else one">' || k || '</i><ng-template #one>[<b *ngIf="b; else two">' || t
  || '</b>]</ng-template><ng-template #two>(<u *ngIf="c; else one">u</u>)</ng-template><ng-template #three>end ' || k || '</ng-template>.'"""
_CHAIN_TEXT = f"""CASE s WHEN 'P' THEN {_CHAIN_SOURCE} ELSE
  '@if (a) {{' || chr(10) || '  <i>' || k || '</i>' || chr(10) || '}} @else {{' || chr(10) || '  [@if (b) {{' || chr(10) || '  <b>' || t
  || '</b>' || chr(10) || '}} @else {{' || chr(10) || '  (' ||
  CASE s WHEN 'F' THEN '@if (c) {{' || chr(10) || '  <u>u</u>' || chr(10) || '}} @else {{' || chr(10) || '  end ' || k || chr(10) || '}}'
         ELSE '<u>' || k || '</u>' END
  || ')' || chr(10) || '}}]' || chr(10) || '}}'
  || CASE s WHEN 'O' THEN chr(10) || '<ng-template #three>end ' || k || '</ng-template>.' ELSE chr(10) || '.' END END"""


# -- loops -----------------------------------------------------------------------


def _for_content(key, name, size):
    return cat(
        '<ul>\n  <li *ngFor="let part of parts', key, '" title="', name, '">', size, "</li>\n</ul>",
        '<!-- <li *ngFor="let x of ys">kept</li> --><script>var t = \'<p *ngIf="q">\';</script>',
    )


def rewrite_for(spark, sf):
    return result(part_files(spark, sf, _for_content))


_FOR_TEXT = """'<ul>' || chr(10) || '  @for (part of parts' || k || '; track part) {' || chr(10) || '  <li title="' || n || '">' || z
  || '</li>' || chr(10) || '}' || chr(10) || '</ul><!-- <li *ngFor="let x of ys">kept</li> --><script>var t = ''<p *ngIf="q">'';</script>'"""


def _locals_content(key, name, size):
    clauses = F.when(F.length(name) % 2 == 0, "let i = index; trackBy: byName; let o=odd").otherwise(
        " trackBy:byKey;let rest = other ; ignored; trackBy: last"
    )
    return cat(
        '<tr class="r" *ngFor="let p of shop.parts; ', clauses, '"><td>', name, '</td></tr>\n<em *ngFor=" let q of qs">', size, "</em>"
    )


def rewrite_for_locals(spark, sf):
    return result(part_files(spark, sf, _locals_content))


_LOCALS_TEXT = """'@for (p of shop.parts; track ' || CASE WHEN length(n) % 2 = 0 THEN 'byName($index, p); let i = $index; let o = $odd'
  ELSE 'last($index, p); let rest = $other' END || ') {' || chr(10) || '  <tr class="r"><td>' || n || '</td></tr>' || chr(10) || '}' || chr(10)
  || '<em *ngFor=" let q of qs">' || z || '</em>'"""


# -- choices and nesting ------------------------------------------------------------


def _switch_content(key, total, status):
    default = cat("  <p *ngSwitchDefault>none ", key, '<s *ngIf="x">!</s></p>\n')
    case_f = cat("  <p class=\"f\" *ngSwitchCase=\"'F'\" id=\"f\">full ", total, "</p> stray\n")
    case_o = cat("  <b *ngSwitchCase=\"'O'\">open</b><i *ngIf=\"stray\">stray</i>\n")
    return cat(
        '<div [ngSwitch]=" status ">\n',
        by_status(status, cat(case_f, case_o, default), cat(default, case_o, case_f), cat(case_o, default, case_f)),
        "</div>",
    )


def rewrite_switch(spark, sf):
    return result(order_files(spark, sf, _switch_content))


_CASE_F = """'  @case (''F'') {' || chr(10) || '    <p class="f"  id="f">full ' || t || '</p>' || chr(10) || '  }' || chr(10)"""
_CASE_O = """'  @case (''O'') {' || chr(10) || '    <b>open</b>' || chr(10) || '  }' || chr(10)"""
_SWITCH_TEXT = f"""'@switch (status) {{' || chr(10)
  || CASE s WHEN 'F' THEN {_CASE_F.replace('{', '{').replace('}', '}')} || {_CASE_O} ELSE {_CASE_O} || {_CASE_F} END
  || '  @default {{' || chr(10) || '    <p>none ' || k || '@if (x) {{' || chr(10) || '  <s>!</s>' || chr(10) || '}}</p>' || chr(10) || '  }}' || chr(10) || '}}'"""


def _nested_content(key, name, size):
    return cat(
        '<div *ngFor="let o of orders">\n <div *ngIf="o.n > ', size, '" class="in"><div>', name,
        '</div><div><span *ngIf="o.vip">', key, '</span></div></div>\n <div [ngSwitch]="o.s"><div *ngSwitchCase="1"><div *ngIf="k">',
        size, "</div></div></div></div>",
    )


def rewrite_nested(spark, sf):
    return result(part_files(spark, sf, _nested_content))


_NESTED_TEXT = """'@for (o of orders; track o) {' || chr(10) || '  <div>' || chr(10) || ' @if (o.n > ' || z || ') {' || chr(10)
  || '  <div class="in"><div>' || n || '</div><div>@if (o.vip) {' || chr(10) || '  <span>' || k || '</span>' || chr(10) || '}</div></div>'
  || chr(10) || '}' || chr(10) || ' @switch (o.s) {' || chr(10) || '  @case (1) {' || chr(10) || '    <div>@if (k) {' || chr(10) || '  <div>' || z
  || '</div>' || chr(10) || '}</div>' || chr(10) || '  }' || chr(10) || '}</div>' || chr(10) || '}'"""


def _left_content(key, total, status):
    """What stays as it is: aliased async pipes, void and unclosed elements, crossing spans, two directives."""
    return cat(
        by_status(
            status,
            cat('<p *ngIf="o$ | async as o">', key, '</p><br *ngIf="b"><li *ngIf="open">', total, "<u *ngIf=\"u\">", key, "</u>"),
            cat('<b *ngIf="a"><i *ngIf="c">', key, "</b>", total, "</i>"),
            cat('<a *ngIf="x" *ngFor="let y of ys">', key, "</a>", total),
        )
    )


def rewrite_left(spark, sf):
    return result(order_files(spark, sf, _left_content))


_LEFT_TEXT = """CASE s WHEN 'F' THEN '<p *ngIf="o$ | async as o">' || k || '</p><br *ngIf="b"><li *ngIf="open">' || t || '@if (u) {' || chr(10) || '  <u>' || k || '</u>' || chr(10) || '}'
  WHEN 'O' THEN '<b *ngIf="a"><i *ngIf="c">' || k || '</b>' || t || '</i>'
  ELSE '<a *ngIf="x" *ngFor="let y of ys">' || k || '</a>' || t END"""


def _one_content(key, name, size):
    return cat('<p *ngIf="a">', key, '</p><q *ngFor="let x of xs">', name, "</q>")


def rewrite_one_pattern(spark, sf):
    return result(part_files(spark, sf, _one_content), "ngfor_simple")


_ONE_TEXT = """'<p *ngIf="a">' || k || '</p>@for (x of xs; track x) {' || chr(10) || '  <q>' || n || '</q>' || chr(10) || '}'"""


# -- plug-in rules, differences, history ----------------------------------------------

TAG_RULES = [
    Rule("bold_open", "Bold start", "simple", r"<b>", "<strong>"),
    Rule("bold_close", "Bold end", "simple", r"</b>", lambda text: F.replace(text, F.lit("</b>"), F.lit("</strong>"))),
    Rule("inline_script", "Script", "ambiguous", r"<script>"),
]


def _tagged(spark, sf):
    return rewrite.apply_rules(pages(spark, sf), TAG_RULES)


def rewrite_tags(spark, sf):
    return _tagged(spark, sf).select(
        "project", "path", "after", F.array_join("applied", ",").alias("applied"),
        F.array_join("skipped", ",").alias("skipped"), F.array_join("exhausted", ",").alias("exhausted"), "was_modified",
    )


def _deep_content(key, *_):
    return cat(F.repeat(F.lit("("), (F.length(key) * 20).cast("int")), key, F.repeat(F.lit(")"), (F.length(key) * 20).cast("int")))


def rewrite_deep(spark, sf):
    """One level of brackets goes in each pass; some files take over a hundred passes."""
    rule = Rule("brackets", "Brackets", "simple", r"\(\((\d*)\)\)", "($1)")
    files = read(spark, sf, "part").select(
        F.lit("deep").alias("project"), F.concat(F.lit("p"), F.col("p_partkey")).alias("path"),
        _deep_content(F.col("p_partkey").cast("string")).alias("content"),
    )
    return rewrite.apply_rules(files, [rule]).select(
        "path", "after", F.array_join("applied", ",").alias("applied"), "success", "error"
    )


def _control_content(key, total, status):
    """Every character that the rewrite uses as a mark, and the one it escapes with, in text and expression."""
    return cat(
        "\u0003", key, '<p *ngIf="a', by_status(status, "\u0001", "\u0004", "\u0005a"), '">\u0005e\u0001', total, "\u0004c\u0005</p>"
    )


def rewrite_control_characters(spark, sf):
    return result(order_files(spark, sf, _control_content))


_CONTROL_TEXT = """chr(3) || k || '@if (a' || CASE s WHEN 'F' THEN chr(1) WHEN 'O' THEN chr(4) ELSE chr(5) || 'a' END
  || ') {' || chr(10) || '  <p>' || chr(5) || 'e' || chr(1) || t || chr(4) || 'c' || chr(5) || '</p>' || chr(10) || '}'"""


def rewrite_callable(spark, sf):
    out = rewrite.map_rewrite(pages(spark, sf), lambda text: text.replace("<b>", "<strong>").replace("</b>", "</strong>"))
    return out.select("project", "path", "after", "was_modified", "error")


_TAGGED_SQL = PAGES_SQL + """,
tagged AS (
  SELECT project, path, content AS before,
         replace(replace(content, '<b>', '<strong>'), '</b>', '</strong>') AS after FROM pages_corpus)"""


def line_diff(spark, sf):
    return diff.line_diff(_tagged(spark, sf))


def diff_text(spark, sf):
    return diff.diff_text(diff.line_diff(_tagged(spark, sf)))


def ordered_diff(spark, sf):
    return diff.ordered_diff(_tagged(spark, sf))


def diff_applies(spark, sf):
    """The ordered diff of every changed page, applied to the page."""
    tagged = _tagged(spark, sf)
    changed = tagged.where(~F.col("before").eqNullSafe(F.col("after"))).select("project", "path", "before")
    return diff.apply_unified(changed.join(diff.unified_text(diff.ordered_diff(tagged)), ["project", "path"], "left"))


_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DIFF_SQL = f"""
WITH {_TAGGED_SQL},
changed AS (SELECT * FROM tagged WHERE before <> after),
split AS (
  SELECT project, path, string_split_regex(before, '{_LINE_END}') AS b, string_split_regex(after, '{_LINE_END}') AS a FROM changed),
cut AS (
  SELECT project, path, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS b, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM split),
old AS (SELECT project, path, unnest(b) AS text, unnest(range(1, len(b) + 1)) AS line_no FROM cut),
new AS (SELECT project, path, unnest(a) AS text, unnest(range(1, len(a) + 1)) AS line_no FROM cut),
old_n AS (SELECT *, row_number() OVER (PARTITION BY project, path, text ORDER BY line_no) AS nth FROM old),
new_n AS (SELECT *, row_number() OVER (PARTITION BY project, path, text ORDER BY line_no) AS nth FROM new),
diff AS (
  SELECT project, path, text, nth, o.line_no AS before_line, n.line_no AS after_line,
    CASE WHEN n.line_no IS NULL THEN 'removed' WHEN o.line_no IS NULL THEN 'added' ELSE 'kept' END AS change
  FROM old_n o FULL OUTER JOIN new_n n USING (project, path, text, nth))"""


def rollback(spark, sf):
    files = pages(spark, sf)
    tagged = _tagged(spark, sf)
    again = tagged.withColumns({"before": F.col("after"), "after": F.concat(F.col("after"), F.lit("<!-- 2 -->"))})
    history = sinks.history_rows(tagged, "run_1", 0).unionByName(sinks.history_rows(again, "run_1", 1))
    migrated = sinks.apply_history(files, history)
    return sinks.rollback(migrated, history, "run_1")


def rollback_committed(spark, sf):
    """The same over committed attempts: one repeated, one broken off before its record."""
    files, tagged = pages(spark, sf), _tagged(spark, sf)
    again = tagged.withColumns({"before": F.col("after"), "after": F.concat(F.col("after"), F.lit("<!-- 2 -->"))})
    lost = tagged.withColumns({"before": F.lit("lost"), "after": F.lit("lost too")})
    path = shared_path(spark, "history")
    sinks.commit_history(spark, again, path, "run_1", 0)
    sinks.commit_history(spark, tagged, path, "run_1", 0)
    sinks.commit_history(spark, again, path, "run_1", 1)
    sinks.history_rows(lost, "run_1", 2).write.parquet(f"{path}/data/lost/history")
    history = sinks.committed_history(spark, path)
    return sinks.rollback(sinks.apply_history(files, history), history, "run_1")


def incremental(spark, sf):
    """Pages with bold text changed since the last run, which saw them without."""
    files = pages(spark, sf)
    last = files.select("project", "path", F.sha2(F.replace("content", F.lit("<b>"), F.lit("")), 256).alias("content_hash"))
    return state.changed_since(files, last).select("project", "path", "content_hash")


QUERIES = {
    "rewrite_if": rewrite_if,
    "rewrite_else": rewrite_else,
    "rewrite_then_else": rewrite_then_else,
    "rewrite_chain": rewrite_chain,
    "rewrite_for": rewrite_for,
    "rewrite_for_locals": rewrite_for_locals,
    "rewrite_switch": rewrite_switch,
    "rewrite_nested": rewrite_nested,
    "rewrite_left": rewrite_left,
    "rewrite_one_pattern": rewrite_one_pattern,
    "rewrite_tags": rewrite_tags,
    "rewrite_deep": rewrite_deep,
    "rewrite_control_characters": rewrite_control_characters,
    "rewrite_callable": rewrite_callable,
    "line_diff": line_diff,
    "diff_text": diff_text,
    "ordered_diff": ordered_diff,
    "diff_applies": diff_applies,
    "rollback": rollback,
    "rollback_committed": rollback_committed,
    "incremental": incremental,
}

ORACLES = {
    "rewrite_if": f"WITH {ORDERS_SQL} " + expected("o", _IF_TEXT, "'ngif_simple'"),
    "rewrite_else": f"WITH {ORDERS_SQL} " + expected("o", _ELSE_TEXT, "'ngif_else,ngif_simple'"),
    "rewrite_then_else": f"WITH {ORDERS_SQL} " + expected("o", _THEN_ELSE_TEXT, "'ngif_then_else'"),
    "rewrite_chain": f"WITH {ORDERS_SQL} " + expected(
        "o", _CHAIN_TEXT,
        "CASE s WHEN 'F' THEN 'ngif_else,ngif_else,ngif_else' WHEN 'O' THEN 'ngif_else,ngif_else' ELSE '' END",
        error="CASE s WHEN 'P' THEN 'template reference cycle' END", modified="s <> 'P'"),
    "rewrite_deep": """
SELECT 'p' || p_partkey AS path, '(' || p_partkey || ')' AS after, 'brackets' AS applied, true AS success,
       NULL::VARCHAR AS error FROM part""",
    "rewrite_control_characters": f"WITH {ORDERS_SQL} " + expected("o", _CONTROL_TEXT, "'ngif_simple'"),
    "rewrite_for": f"WITH {PARTS_SQL} " + expected("p", _FOR_TEXT, "'ngfor_simple'"),
    "rewrite_for_locals": f"WITH {PARTS_SQL} " + expected("p", _LOCALS_TEXT, "'ngfor_trackby'", unresolved="1"),
    "rewrite_switch": f"WITH {ORDERS_SQL} " + expected(
        "o", _SWITCH_TEXT, "'ngswitch,ngif_simple'"),
    "rewrite_nested": f"WITH {PARTS_SQL} " + expected(
        "p", _NESTED_TEXT, "'ngfor_simple,ngif_simple,ngif_simple,ngswitch,ngif_simple'"),
    "rewrite_left": f"WITH {ORDERS_SQL} " + expected(
        "o", _LEFT_TEXT, "CASE s WHEN 'F' THEN 'ngif_simple' ELSE '' END",
        "CASE s WHEN 'F' THEN 'ngif_async_pipe' ELSE '' END", "CASE s WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END",
        "CASE s WHEN 'O' THEN 'misnested directives' END", "s = 'F'"),
    "rewrite_one_pattern": f"WITH {PARTS_SQL} " + expected("p", _ONE_TEXT, "'ngfor_simple'"),
    "rewrite_tags": f"""WITH {_TAGGED_SQL}
SELECT project, path, after, concat_ws(',', CASE WHEN contains(before, '<b>') THEN 'bold_open' END,
         CASE WHEN contains(before, '</b>') THEN 'bold_close' END) AS applied,
       CASE WHEN contains(before, '<script>') THEN 'inline_script' ELSE '' END AS skipped, '' AS exhausted,
       before <> after AS was_modified
FROM tagged""",
    "rewrite_callable": f"WITH {_TAGGED_SQL} SELECT project, path, after, before <> after AS was_modified, NULL::VARCHAR AS error FROM tagged",
    "line_diff": _DIFF_SQL + "SELECT project, path, text, nth, before_line, after_line, change FROM diff",
    "diff_text": _DIFF_SQL + """
SELECT project, path, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || string_agg(
    CASE change WHEN 'removed' THEN '-' ELSE '+' END || text, chr(10)
    ORDER BY coalesce(before_line, after_line), change = 'added', text) AS diff
FROM diff WHERE change <> 'kept' GROUP BY project, path""",
    "diff_applies": f"WITH {_TAGGED_SQL} SELECT project, path, after, true AS clean FROM tagged WHERE before <> after",
    # The rules leave line ends alone, so that lines can be compared by their numbers.
    "ordered_diff": f"""WITH {_TAGGED_SQL},
t AS (
  SELECT project, path, unnest(range(1, len(string_split(before, chr(10))) + 1)) AS n, len(string_split(before, chr(10))) AS count,
         unnest(string_split(before, chr(10))) AS b, unnest(string_split(after, chr(10))) AS a, FROM tagged WHERE before <> after),
l AS (SELECT project, path, n, b, a, n = count AS last FROM t WHERE NOT (n = count AND b = '')),
far AS (SELECT project, path, n, n - lag(n, 1, -100) OVER (PARTITION BY project, path ORDER BY n) > 7 AS new FROM l WHERE b <> a),
h AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY project, path ORDER BY n) AS hunk FROM far),
span AS (SELECT project, path, hunk, min(n) - 3 AS low, max(n) + 3 AS high FROM h GROUP BY ALL),
rows_ AS (
  SELECT span.project, span.path, hunk, l.*, b <> a AS changed FROM span JOIN l USING (project, path) WHERE n BETWEEN low AND high),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY project, path, changed ORDER BY n) AS run FROM rows_),
first AS (SELECT *, CASE WHEN changed THEN min(n) OVER (PARTITION BY project, path, changed, run) ELSE n END AS start FROM runs),
written AS (
  SELECT *, ' ' AS mark, b AS line, 0 AS turn FROM first WHERE NOT changed UNION ALL
  SELECT *, '-' AS mark, b AS line, 1 AS turn FROM first WHERE changed UNION ALL
  SELECT *, '+' AS mark, a AS line, 2 AS turn FROM first WHERE changed),
body AS (
  SELECT project, path, hunk, min(n) AS low, count(DISTINCT n) AS size, string_agg(
    mark || line || chr(10) || CASE WHEN last THEN '\\ No newline at end of file' || chr(10) ELSE '' END, ''
    ORDER BY start, turn, n) AS body
  FROM written GROUP BY ALL)
SELECT project, path, hunk::INTEGER AS hunk, low AS before_from, size AS before_count, low AS after_from, size AS after_count, body
FROM body""",
    "rollback": f"""WITH {_TAGGED_SQL}
SELECT project, path, before AS content, (before <> after) AS restored FROM tagged""",
    "rollback_committed": f"""WITH {_TAGGED_SQL}
SELECT project, path, before AS content, (before <> after) AS restored FROM tagged""",
    "incremental": f"WITH {PAGES_SQL} SELECT project, path, sha256(content) AS content_hash FROM pages_corpus WHERE contains(content, '<b>')",
}

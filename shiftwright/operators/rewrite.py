"""Corpus rewrite: structural directives become control flow blocks.

Each file is split into tags and the text between them. Opening and closing
tags are paired by nesting depth, so that an element ends at its own closing tag
however deep it nests. Every change is then a local edit of a token range, and a
file is put together once from its tokens and edits.

Files with directives are shuffled by file once, the others are passed through
untouched. Files of few directives are planned and put together within their row,
by one pass over their tags in a Python worker, so that no tag becomes a row. For
files of many directives the same steps are window functions over rows of tags;
only tags that can matter (those named like an element with a directive) become
rows, and of these only the directive tags carry text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.functions.text import contains_any, lstrip, normalize_newlines, rstrip, strip

FILE = ["project", "path"]

TOKEN_END = "\u0001"
SLOT = "\u0003"  # on both sides of the id of a fragment to put in
CUT = "\u0004"  # where a removed template stood

# A comment, script or style sheet is one token; a tag may hold ">" in quotes.
TAG = (
    r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
    r"""|</?[a-z][\w-]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
)
OPAQUE = r"(?i)^<(?:!--|script\b|style\b)"
NAME = r"^</?([a-zA-Z][\w-]*)"
DIRECTIVES = ["*ngIf", "*ngFor", "[ngSwitch]", "*ngSwitchCase", "*ngSwitchDefault"]
START_TEXTS = ["*ngIf=", "*ngFor=", "[ngSwitch]="]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

IF_VALUE = r'\*ngIf="([^"]+)"'
FOR_VALUE = r'\*ngFor="([^"]+)"'
SWITCH_VALUE = r'\[ngSwitch\]="([^"]+)"'
CASE_VALUE = r'\*ngSwitchCase="([^"]+)"'
THEN_ELSE = r'(?sU)^([^";]+);\s*then\s+(\w+);\s*else\s+(\w+)\z'
ELSE = r'(?sU)^([^";]+);\s*else\s+(\w+)\z'
ASYNC_ALIAS = r"(?sU)\|\s*async\s+as\s+\w+"
FOR = r"(?sU)^let\s+(\w+)\s+of\s+([\w.]+)(?:;\s*([^\"]+))?\z"
TRACK_BY = r"(?U)^trackBy:\s*(\w+)"
LOCAL = r"(?U)^let\s+(\w+)\s*=\s*(\w+)"
TEMPLATE = r"(?sU)^<ng-template\s+#(\w+)\s*>$"
ANY_REF = r"(?U)(?:then|else)\s+(\w+)"
AROUND_DIRECTIVE = (
    r'(?s)^<[a-zA-Z][\w-]*+(.*?)(?:\*ngIf="[^"]*"|\*ngFor="[^"]*"|\[ngSwitch\]="[^"]*"'
    r'|\*ngSwitchCase="[^"]*"|\*ngSwitchDefault)(.*)>$'
)

# A file that holds more of these is planned with windows.
FEW_DIRECTIVES = 128
DIRECTIVE_STARTS = ["*ng", "[ngSwitch]", "<ng-template"]
# Characters of edited texts that a Python worker holds before it passes them on.
ROW_BATCH_CHARS = 1 << 24

EDITED = ["if", "else", "then_else", "for", "for_with", "switch", "case", "default"]
# Kind of element -> rule it falls under. Cases and defaults belong to their switch.
PATTERN = {
    "if": "ngif_simple", "else": "ngif_else", "then_else": "ngif_then_else", "async": "ngif_async_pipe",
    "for": "ngfor_simple", "for_with": "ngfor_trackby", "switch": "ngswitch",
}
EDIT = "struct<from:bigint,to:bigint,act:string,pos:bigint,a:bigint,b:bigint>"


def tokens(content: Column) -> Column:
    """Text and tags in turn: tags have odd indexes, counted from 0."""
    marked = F.regexp_replace(content, TAG, f"{TOKEN_END}$0{TOKEN_END}")
    return F.split(marked, TOKEN_END)


# Characters used as marks here, and the letter each is written as, behind ESCAPE, while a text that holds it is edited.
ESCAPE = "\u0005"
ESCAPED = {ESCAPE: "e", TOKEN_END: "a", SLOT: "c", CUT: "d"}


def _escaped(text: Column) -> Column:
    """The text without marks; texts that hold none stay as they are."""
    out = text
    for char, letter in ESCAPED.items():
        out = F.replace(out, F.lit(char), F.lit(ESCAPE + letter))
    return F.when(contains_any(text, list(ESCAPED)), out).otherwise(text)


def _restored(text: Column) -> Column:
    out = text
    for char, letter in reversed(ESCAPED.items()):
        out = F.replace(out, F.lit(ESCAPE + letter), F.lit(char))
    return F.when(text.contains(ESCAPE), out).otherwise(text)


def _dealt_out(files: DataFrame) -> DataFrame:
    """The files by their keys, in a number of partitions that adaptive execution does not merge by size."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *FILE)


def _count(text: Column, needle: str) -> Column:
    """How often ``needle`` occurs, by the bytes that go with it: cheaper than a pattern."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def _extract(text: Column, regex: str, group: int) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def rewrite_templates(files: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """Rewrite all files; with ``pattern_id``, only elements of that pattern.

    Result columns: before, after, applied, skipped, unresolved (elements with a
    directive that could not be edited), was_modified, success, error. A file
    with an error keeps its text.
    """
    text = normalize_newlines(F.col("content"))
    # The null tests stand apart: a join on the keys would add them on one side, and
    # two different filters would keep Spark from reusing the shuffle of the content.
    keyed = F.col("project").isNotNull() & F.col("path").isNotNull()
    found = F.coalesce(contains_any(F.col("content"), START_TEXTS), F.lit(False))
    few = reduce(lambda a, b: a + b, [_count(F.col("content"), t) for t in DIRECTIVE_STARTS]) <= FEW_DIRECTIVES

    def told(rows: DataFrame, flag: Column) -> DataFrame:
        # A one-row inline: filters on the flag stay above it. Below, each of their tests would
        # put the text together anew, and the files of few and of many directives would move apart.
        return rows.select("*", F.inline(F.array(F.struct(flag.alias("_is")))))

    known = told(files.select(*FILE, "content"), found)
    candidate = keyed & F.col("_is")
    # Content moves once: files of few and of many directives read the same shuffle, the tags are
    # read off it, and the edits of the windows meet it again in the same partition.
    moved = _dealt_out(known.filter(candidate).select(*FILE, _escaped(text).alias("before"), few.alias("_few")))
    placed = told(moved, F.col("_few")).drop("_few")
    many = placed.filter(~F.col("_is")).drop("_is")
    edited = row_plans(placed.filter("_is").drop("_is"), pattern_id).unionByName(render(
        many.join(edit_plans(many, pattern_id), FILE, "left").withColumn("_tokens", tokens(F.col("before")))))
    passed = known.filter(~candidate).select(
        *FILE,
        text.alias("before"),
        text.alias("after"),
        F.array().cast("array<string>").alias("applied"),
        F.array().cast("array<string>").alias("skipped"),
        F.lit(0).cast("bigint").alias("unresolved"),
        F.when(F.col("content").isNull(), "unreadable text").alias("error"),
    )
    return (
        edited.withColumns({c: _restored(F.col(c)) for c in ("before", "after")})
        .unionByName(passed)
        .withColumn("was_modified", ~F.col("before").eqNullSafe(F.col("after")))
        .withColumn("success", F.col("error").isNull())
    )


def edit_plans(files: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """Per file: units (the file and its fragments) with their edits, and what was applied.

    ``files`` has the text as ``before`` and is partitioned by file; nothing here shuffles. With windows, for files of
    any number of directives; ``row_plans`` finds the same for few.
    """
    spans = _with_partners(_tag_rows(files))
    spans = _parsed(spans, pattern_id)
    spans = _with_references(spans)
    spans = _with_nesting(spans)
    spans = _with_children(spans)
    spans = _with_owner(spans)
    return _collected(_edits(spans))


# -- tags and their partners ---------------------------------------------------


def _tag_rows(files: DataFrame) -> DataFrame:
    """Tags named like some directive element or template of their file."""
    tag = F.col("tag")
    rows = (
        files.select(*FILE, tokens(F.col("before")).alias("_tokens"))
        .select(*FILE, _tags().alias("_tags"))
        .select(*FILE, _names().alias("_names"), "_tags")
        # An inner inline, or a filter that needs _names not to be null, would make
        # the optimizer repeat the regex pass in a filter below.
        .select(*FILE, "_names", F.inline_outer("_tags"))
        .filter(F.col("pos").isNotNull())
        .withColumn("name", F.regexp_extract("tag", NAME, 1))
        .filter(F.coalesce(F.array_contains("_names", F.col("name")), F.lit(False)))
    )
    return rows.select(
        *FILE,
        "pos",
        "name",
        _step(tag, F.col("name")).alias("step"),
        F.when(_marked(tag) & ~tag.startswith("</"), tag).alias("tag"),
    )


def _tags() -> Column:
    """The tags among ``_tokens`` with their places, without comments, scripts and style sheets."""
    return F.filter(
        F.transform(
            F.col("_tokens"), lambda t, i: F.struct(i.cast("bigint").alias("pos"), t.alias("tag"))
        ),
        lambda x: (x["pos"] % 2 == 1) & ~(F.substring(x["tag"], 2, 1).isin("!", "s", "S") & x["tag"].rlike(OPAQUE)),
    )


def _marked(tag: Column) -> Column:
    return contains_any(tag, DIRECTIVES) | tag.startswith("<ng-template")


def _names() -> Column:
    """Names of the elements among ``_tags`` with a directive, and of templates."""
    return F.array_distinct(F.transform(F.filter("_tags", lambda x: _marked(x["tag"])), lambda x: _name(x["tag"])))


def _step(tag: Column, name: Column) -> Column:
    """What a tag adds to the depth."""
    return F.when(tag.startswith("</"), -1).when(tag.endswith("/>") | name.isin(VOID), 0).otherwise(1)


def _with_partners(rows: DataFrame) -> DataFrame:
    """Pair each opening tag with the closing tag of its depth; keep directive tags."""
    by_name = _running(Window.partitionBy(*FILE, "name").orderBy("pos"))
    depth = F.sum("step").over(by_name)
    level = F.when(F.col("step") == 1, depth).when(F.col("step") == -1, depth + 1)
    by_level = Window.partitionBy(*FILE, "name", "level").orderBy("pos")
    following = F.lead(F.struct("pos", "step")).over(by_level)
    return (
        rows.withColumn("level", level)
        .select(*FILE, "pos", "name", "tag", "step", following.alias("_next"))
        .filter(F.col("tag").isNotNull())
        .withColumn(
            "close", F.when((F.col("step") == 1) & (F.col("_next.step") == -1), F.col("_next.pos"))
        )
        .drop("step", "_next")
    )


def _running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


# -- directives ------------------------------------------------------------------


def _parsed(spans: DataFrame, pattern_id: str | None) -> DataFrame:
    """Classify each directive tag, and note the template names it defines or uses.

    Its texts are read off the tag again when the file is put together: the
    windows in between carry numbers and flags only.
    """
    if_value = _extract(F.col("tag"), IF_VALUE, 1)
    found = spans.withColumns({
        "kind": _kind(F.col("tag"), F.col("name"), if_value, _extract(F.col("tag"), FOR_VALUE, 1)), "_if": if_value,
    }).filter(F.col("kind").isNotNull())
    flags = _flags(F.col, pattern_id)
    return found.select(
        *FILE, "pos", "close", "kind", *[v.alias(k) for k, v in flags.items()],
        F.explode_outer(_uses({"editable": flags["editable"]}.get, F.col)).alias("_use"),
    )


def _kind(tag: Column, name: Column, if_value: Column, for_value: Column) -> Column:
    """The kind of a tag with a directive or of a template, from its values of ``*ngIf`` and ``*ngFor``; null for others."""
    count = reduce(
        lambda a, b: a + b, [F.when(tag.contains(d), 1).otherwise(0) for d in DIRECTIVES]
    )
    return (
        F.when(tag.rlike(TEMPLATE) & (name == "ng-template"), "template")
        # Other templates hold no directive and stay as they are.
        .when(count != 1, F.when(count > 1, "several"))
        .when(tag.contains("*ngIf"), F.when(if_value.isNull(), "invalid")
              .when(if_value.rlike(THEN_ELSE), "then_else")
              .when(if_value.rlike(ELSE), "else")
              .when(if_value.rlike(ASYNC_ALIAS), "async")
              .otherwise("if"))
        .when(tag.contains("*ngFor"), F.when(~F.coalesce(for_value.rlike(FOR), F.lit(False)), "invalid")
              .when(F.regexp_extract(for_value, FOR, 3) != "", "for_with").otherwise("for"))
        .when(tag.contains("[ngSwitch]"), F.when(tag.rlike(SWITCH_VALUE), "switch").otherwise("invalid"))
        .when(tag.contains("*ngSwitchCase"), F.when(tag.rlike(CASE_VALUE), "case").otherwise("invalid"))
        .otherwise("default")
    )


def _flags(of, pattern_id: str | None) -> dict:
    """What is known of a span by its kind; ``of`` gives its columns or fields by name."""
    kind, closed = of("kind"), of("close").isNotNull()
    wanted = F.lit(True) if pattern_id is None else F.coalesce(
        kind.isin("template", "case", "default") | (_pattern(kind) == pattern_id), F.lit(False)
    )
    return {
        "wanted": wanted, "editable": kind.isin(EDITED) & closed & wanted, "is_template": (kind == "template") & closed,
    }


def _uses(flag, of) -> Column:
    """The template names that a span defines or uses, or null."""
    def use(slot: str, ref: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), ref.alias("ref"))

    kind, closed, editable, value = of("kind"), of("close").isNotNull(), flag("editable"), of("_if")
    return (
        F.when((kind == "template") & closed, F.array(use("template", F.regexp_extract(of("tag"), TEMPLATE, 1))))
        .when(editable & (kind == "then_else"), F.array(use("then", _then_ref(value)), use("else", _else_ref(value))))
        .when(editable & (kind == "else"), F.array(use("else", _else_ref(value))))
        .when(
            ~editable & value.isNotNull(),
            F.transform(F.regexp_extract_all(value, F.lit(ANY_REF), 1), lambda r: use("kept", r)),
        )
    )


def _pattern(kind: Column) -> Column:
    return reduce(lambda acc, item: acc.when(kind == item[0], item[1]), PATTERN.items(), F.when(F.lit(False), ""))


def _then_ref(value: Column) -> Column:
    return F.regexp_extract(value, THEN_ELSE, 2)


def _else_ref(value: Column) -> Column:
    return F.when(value.rlike(THEN_ELSE), F.regexp_extract(value, THEN_ELSE, 3)).otherwise(
        F.regexp_extract(value, ELSE, 2)
    )


def _name(tag: Column) -> Column:
    return F.regexp_extract(tag, NAME, 1)


def _opening(tag: Column) -> Column:
    """The opening tag without its directive; attributes on both sides stay."""
    attributes = strip(F.regexp_replace(tag, AROUND_DIRECTIVE, "$1$2"))
    return F.concat(
        F.lit("<"), _name(tag),
        F.when(attributes != "", F.concat(F.lit(" "), attributes)).otherwise(""), F.lit(">"),
    )


def _head(tag: Column) -> Column:
    """The start of the block an element turns into, from its opening tag."""
    value = F.regexp_extract(tag, IF_VALUE, 1)
    condition = strip(
        F.when(value.rlike(THEN_ELSE), F.regexp_extract(value, THEN_ELSE, 1))
        .when(value.rlike(ELSE), F.regexp_extract(value, ELSE, 1))
        .otherwise(value)
    )
    return (
        F.when(tag.contains("*ngIf"), F.concat(F.lit("@if ("), condition, F.lit(") {\n")))
        .when(tag.contains("*ngFor"), F.concat(_for_head(F.regexp_extract(tag, FOR_VALUE, 1)), F.lit(" {\n")))
        .when(tag.contains("[ngSwitch]"), F.concat(F.lit("@switch ("), strip(F.regexp_extract(tag, SWITCH_VALUE, 1)), F.lit(") {\n")))
        .when(tag.contains("*ngSwitchCase"), F.concat(F.lit("  @case ("), strip(F.regexp_extract(tag, CASE_VALUE, 1)), F.lit(") {\n")))
        .otherwise("  @default {\n")
    )


def _for_head(value: Column) -> Column:
    """``@for (...)`` with the track expression and local names of the microsyntax."""
    item = F.regexp_extract(value, FOR, 1)
    collection = F.regexp_extract(value, FOR, 2)
    clauses = F.transform(F.split(F.regexp_extract(value, FOR, 3), ";"), lambda c: strip(c))
    last_track = F.try_element_at(F.filter(clauses, lambda c: c.rlike(TRACK_BY)), F.lit(-1))
    track = F.coalesce(
        F.concat(F.regexp_extract(last_track, TRACK_BY, 1), F.lit("($index, "), item, F.lit(")")), item
    )
    # Each local maps to its own name behind a dollar sign (index, first, any other).
    locals_ = F.transform(
        F.filter(clauses, lambda c: c.rlike(LOCAL)),
        lambda c: F.concat(
            F.lit("; let "), F.regexp_extract(c, LOCAL, 1), F.lit(" = $"), F.regexp_extract(c, LOCAL, 2)
        ),
    )
    return F.concat(
        F.lit("@for ("), item, F.lit(" of "), collection, F.lit("; track "), track,
        F.array_join(locals_, ""), F.lit(")"),
    )


# -- template references -----------------------------------------------------------


def _with_references(spans: DataFrame) -> DataFrame:
    """Resolve then/else references within the file and find the templates they use up.

    Templates and uses of one name meet in a window over (file, name).
    """
    by_ref = Window.partitionBy(*FILE, "_use.ref")
    by_span = Window.partitionBy(*FILE, "pos").orderBy(F.col("_use.slot").asc_nulls_last())
    all_of_span = by_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slot = F.col("_use.slot")
    return (
        spans.withColumns({
            "_target": F.min(F.when(slot == "template", F.col("pos"))).over(by_ref),
            "_used": F.coalesce(F.bool_or(slot.isin("then", "else")).over(by_ref), F.lit(False)),
            "_kept": F.coalesce(F.bool_or(slot == "kept").over(by_ref), F.lit(False)),
        })
        .withColumns({
            "then_id": F.max(F.when(slot == "then", F.col("_target"))).over(all_of_span),
            "else_id": F.max(F.when(slot == "else", F.col("_target"))).over(all_of_span),
            "_row": F.row_number().over(by_span),
        })
        .filter(F.col("_row") == 1)
        .select(
            *FILE, "pos", "close", "kind", "wanted", "editable", "then_id", "else_id",
            (F.col("is_template") & F.col("_used")).alias("removed"),
            (F.col("is_template") & F.col("_used") & F.col("_kept")).alias("conflict"),
        )
    )


# -- nesting -----------------------------------------------------------------------


def _ends(both: Column) -> Column:
    """Rows for a span: its opening end and, where ``both``, its closing end."""
    opening = F.struct(F.col("pos").alias("at"), F.lit(1).alias("dir"))
    closing = F.struct(F.col("close").alias("at"), F.lit(-1).alias("dir"))
    return F.inline(F.when(both, F.array(opening, closing)).otherwise(F.array(opening)))


def _innermost(spans: DataFrame, marker: Column, level: Column, carried: Column, out: str) -> DataFrame:
    """For each span, ``carried`` of the innermost marker span around it.

    ``level`` counts the markers open at the span, itself included. The innermost
    marker around a span at level n is the last one opened at level n before it,
    so spans look it up in a window over (file, level); a marker takes part at
    its own level and looks one up.
    """
    around = level - F.when(marker, 1).otherwise(0)
    asks = F.struct(around.alias("_at_level"), F.lit(False).alias("_self"))
    answers = F.struct(level.alias("_at_level"), F.lit(True).alias("_self"))
    roles = F.when(marker, F.array(asks, answers)).otherwise(F.array(asks))
    before = Window.partitionBy(*FILE, "_at_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.select("*", F.inline(roles))
        .withColumn(out, F.last(F.when(F.col("_self"), carried), ignorenulls=True).over(before))
        .filter(~F.col("_self"))
        .drop("_at_level", "_self")
    )


def _with_nesting(spans: DataFrame) -> DataFrame:
    """Find crossing spans, and the switch, case or removed template around each span."""
    paired = F.col("editable") | F.col("removed")
    marker = F.col("removed") | (F.col("editable") & F.col("kind").isin("switch", "case", "default"))
    in_order = _running(Window.partitionBy(*FILE).orderBy("at"))
    direction = F.when(paired, F.col("dir")).otherwise(0)
    dropping = F.when(paired & (F.col("kind") == "then_else"), F.col("dir")).otherwise(0)
    after = F.sum(direction).over(in_order)
    by_depth = Window.partitionBy(*FILE, "_depth").orderBy("at")
    rows = (
        spans.select("*", _ends(paired))
        .withColumns({
            "_depth": F.when(direction == -1, after + 1).when(direction == 1, after),
            "_level": F.sum(F.when(marker, F.col("dir")).otherwise(0)).over(in_order),
            # How many dropped then/else elements are open here, this one excluded.
            "dropped_depth": F.sum(dropping).over(in_order) - F.greatest(dropping, F.lit(0)),
        })
        # At one depth an opening end must be followed by its own closing end.
        .withColumn("crossed", paired & ~F.lead("pos").over(by_depth).eqNullSafe(F.col("pos")))
        .filter(F.col("dir") == 1)
        .drop("_depth", "at", "dir")
    )
    inside = F.struct("pos", "kind", "close")
    rows = _innermost(rows, marker, F.col("_level"), inside, "inside")
    in_switch = F.coalesce(F.col("inside.kind") == "switch", F.lit(False))
    nested_switch = F.col("editable") & (F.col("kind") == "switch") & in_switch

    return rows.withColumns({
        "in_switch": in_switch,
        # What spoils the whole file: a place in SPOILED, the first one counting.
        "spoiled": F.when(F.col("crossed"), 0).when(nested_switch, 1).when(F.col("conflict"), 2),
    }).drop("crossed", "conflict", "_level")


SPOILED = [
    "misnested directives",
    "switch inside a switch but outside its cases",
    "template shared with an element left as it is",
]


def _with_children(spans: DataFrame) -> DataFrame:
    """Put the cases of each switch in order, the first default last.

    A default that is not the last child, or not the first default, becomes a
    fragment of its own: it is written elsewhere than it stands, or dropped.
    """
    is_case = F.col("editable") & F.col("kind").isin("case", "default")
    is_child = is_case & F.col("in_switch")
    is_default = is_child & (F.col("kind") == "default")
    is_switch = F.col("editable") & (F.col("kind") == "switch")
    in_group = is_switch | is_child
    # A switch and its children share a group; all other spans of a file form one.
    group = F.when(is_switch, F.col("pos")).when(is_child, F.col("inside.pos"))
    whole = Window.partitionBy(*FILE, "switch_id")
    first_default = F.min(F.when(is_default, F.col("pos"))).over(whole)
    last_child = F.max(F.when(is_child, F.col("pos"))).over(whole)
    moved = is_default & ((F.col("pos") != F.col("_last_child")) | (F.col("pos") != F.col("_first_default")))
    ordered = Window.partitionBy(*FILE, "switch_id", "_stays").orderBy("pos")
    return (
        spans.withColumn("switch_id", group)
        .withColumns({"_first_default": first_default, "_last_child": last_child})
        .withColumns({
            "is_child": is_child,
            "moved": moved,
            "_stays": in_group & ~moved,
            "moved_default": F.when(
                in_group & (F.col("_first_default") != F.col("_last_child")), F.col("_first_default")
            ),
        })
        .withColumns({
            "previous": F.when(F.col("_stays"), F.lag(F.struct("is_child", "pos", "close")).over(ordered)),
            "is_last": F.col("_stays") & F.lead("pos").over(ordered).isNull(),
        })
        .drop("_first_default", "_last_child", "_stays", "switch_id")
    )


def _with_owner(spans: DataFrame) -> DataFrame:
    """The fragment each span belongs to (-1: the file itself), and whether it is written."""
    fragment = F.col("removed") | F.col("moved")
    in_order = _running(Window.partitionBy(*FILE).orderBy("at"))
    rows = (
        spans.select("*", _ends(fragment))
        .withColumn("_level", F.sum(F.when(fragment, F.col("dir")).otherwise(0)).over(in_order))
        .filter(F.col("dir") == 1)
    )
    rows = _innermost(rows, fragment, F.col("_level"), F.struct("pos", "dropped_depth"), "owner")
    hidden = (
        F.col("dropped_depth") > F.coalesce(F.col("owner.dropped_depth"), F.lit(0))
    ) | (F.col("in_switch") & ~F.col("is_child"))
    return rows.withColumns({
        "owner": F.coalesce("owner.pos", F.lit(-1).cast("bigint")),
        "shown": ~hidden,
    })


# -- edits -------------------------------------------------------------------------


def _edits(spans: DataFrame) -> DataFrame:
    """Each span with its edits."""
    return spans.select(
        *FILE, "pos", "close", "kind", "wanted", "editable", "removed", "moved", "is_child", "shown", "owner",
        "spoiled", _edit_list(F.col).alias("edits"),
    )


def _edit_list(of) -> Column:
    """The edits of a span: token ranges, and what to write there (see _written)."""
    pos, close, kind = of("pos"), of("close"), of("kind")
    none = F.lit(None).cast("bigint")

    def edit(start: Column, end: Column, act: Column | str, a: Column = none, b: Column = none) -> Column:
        return F.struct(
            start.alias("from"), end.alias("to"), (F.lit(act) if isinstance(act, str) else act).alias("act"),
            pos.alias("pos"), a.alias("a"), b.alias("b"),
        )

    # A child writes everything since the child before it (or since the switch began).
    previous, moved = of("previous"), of("moved_default")
    child_start = F.when(previous["is_child"], previous["close"]).otherwise(previous["pos"])
    child_act = F.when(previous["is_child"], "next child").otherwise("first child")
    child = edit(child_start, pos, child_act, previous["pos"])
    child_end = edit(close, of("inside")["close"], "children end", moved)
    editable = of("editable")
    return (
        F.when(~of("shown"), F.array().cast(f"array<{EDIT}>"))
        .when(of("removed"), F.array(edit(pos, close, "cut")))
        .when(editable & kind.isin("if", "for", "for_with"), F.array(edit(pos, pos, "open"), edit(close, close, "close")))
        .when(editable & (kind == "else"), F.array(edit(pos, pos, "open"), edit(close, close, "else", none, of("else_id"))))
        .when(editable & (kind == "then_else"), F.array(edit(pos, close, "both", of("then_id"), of("else_id"))))
        .when(editable & (kind == "switch") & of("is_last"), F.array(edit(pos, close, "no children", moved)))
        .when(of("is_child") & ~of("moved") & of("is_last"), F.array(child, child_end))
        .when(of("is_child") & ~of("moved"), F.array(child))
    )


def _slot(fragment: Column, ref: Column) -> Column:
    """Where a fragment goes; a marker if the file has no such template."""
    return F.when(
        fragment.isNotNull(), F.concat(F.lit(SLOT), fragment.cast("string"), F.lit(SLOT))
    ).otherwise(F.concat(F.lit("<!-- WARNING: ng-template #"), ref, F.lit(" not found -->")))


def _written(edit: Column, all_tokens: Column) -> Column:
    """The text an edit writes, from the tags it refers to."""
    def tag_at(place: Column) -> Column:
        return F.get(all_tokens, place.cast("int"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    tag, act, a, b = tag_at(edit["pos"]), edit["act"], edit["a"], edit["b"]
    value = F.regexp_extract(tag, IF_VALUE, 1)
    closing = text("</", _name(tag), ">\n}")
    else_block = text(" @else {\n  ", _slot(b, _else_ref(value)), "\n}")
    other = tag_at(a)
    # A default written after the other cases, whose content is a fragment.
    moved_block = text(
        "  @default {\n    ", _opening(other), SLOT, a.cast("string"), SLOT, "</", _name(other), ">\n  }"
    )
    child = text(_head(tag), "    ", _opening(tag))
    return (
        F.when(act == "open", text(_head(tag), "  ", _opening(tag)))
        .when(act == "close", closing)
        .when(act == "else", text(closing, else_block))
        .when(act == "both", text(_head(tag), "  ", _slot(a, _then_ref(value)), "\n}", else_block))
        .when(act == "cut", F.lit(CUT))
        .when(act == "first child", text(_head(other), child))
        .when(act == "next child", text("</", _name(other), ">\n  }\n", child))
        .when(act == "children end", text("</", _name(tag), ">\n  }", F.when(a.isNull(), "").otherwise(text("\n", moved_block)), "\n}"))
        .otherwise(text(_head(tag), F.when(a.isNull(), "").otherwise(moved_block), "\n}"))
    )


def _collected(spans: DataFrame) -> DataFrame:
    """One row per file, through one row per unit. Both groupings keep the partitioning."""
    none = F.lit(None).cast("bigint")
    # A fragment adds a row that announces it to its own unit.
    rows = F.array(
        F.struct(
            F.col("owner").alias("unit"), none.alias("unit_from"), none.alias("unit_to"),
            F.lit(False).alias("trimmed"), F.col("edits").alias("edits"),
            *[v.alias(k) for k, v in _counted(F.col).items()],
        ),
        F.when(
            F.col("removed") | F.col("moved"),
            F.struct(
                F.col("pos").alias("unit"),
                (F.col("pos") + 1).alias("unit_from"), (F.col("close") - 1).alias("unit_to"),
                F.col("removed").alias("trimmed"), F.lit(None).cast(f"array<{EDIT}>").alias("edits"),
                F.lit(None).cast("struct<pos:bigint,pattern:string>").alias("applied"),
                F.lit(None).cast("string").alias("skipped"),
                F.lit(0).alias("unresolved"),
            ),
        ),
    )
    units = (
        spans.select(*FILE, "spoiled", F.explode(rows).alias("r"))
        .filter(F.col("r").isNotNull())
        .select(*FILE, "spoiled", "r.*")
        .groupBy(*FILE, "unit")
        .agg(
            F.max("unit_from").alias("from"),
            F.max("unit_to").alias("to"),
            F.bool_or("trimmed").alias("trimmed"),
            F.array_sort(F.flatten(F.collect_list("edits"))).alias("edits"),
            F.collect_list("applied").alias("applied"),
            F.collect_set("skipped").alias("skipped"),
            F.sum("unresolved").alias("unresolved"),
            F.min("spoiled").alias("spoiled"),
        )
    )
    return units.groupBy(*FILE).agg(
        F.collect_list(F.struct("unit", "from", "to", "trimmed", "edits")).alias("units"),
        F.array_sort(F.flatten(F.collect_list("applied")))["pattern"].alias("applied"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("skipped")))).alias("skipped"),
        F.sum("unresolved").alias("unresolved"),
        F.get(F.array(*map(F.lit, SPOILED)), F.min("spoiled")).alias("file_error"),
    )


def _counted(of) -> dict:
    """What a span adds to the lists and the count of its file."""
    kind, editable = of("kind"), of("editable")
    pattern, is_case = _pattern(kind), kind.isin("case", "default")
    unresolved = (~editable & of("wanted") & ~kind.isin("template", "async")) | (editable & is_case & ~of("is_child"))
    return {
        "applied": F.when(editable & ~is_case & of("shown"), F.struct(of("pos").alias("pos"), pattern.alias("pattern"))),
        "skipped": F.when((kind == "async") & of("wanted"), pattern),
        "unresolved": F.when(unresolved, 1).otherwise(0),
    }


# -- the same within the row ---------------------------------------------------------


def row_plans(files: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """``files`` with what ``edit_plans`` and ``render`` make of them, one file at a time (see row_edits).

    Texts go to the Python workers in Arrow batches and come back where they were edited.
    """
    from shiftwright.operators.row_edits import rewritten

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begin, size = [], 0, 0
            for end, text in enumerate(_texts(batch["before"]), 1):
                found.append(rewritten(text, pattern_id))
                size += len(found[-1][0] or "")
                if size > ROW_BATCH_CHARS or end == len(batch):
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, *columns], [*names, *outcome])
                    found, begin, size = [], end, 0

    names, outcome = [*FILE, "before"], ["_edited", "applied", "skipped", "unresolved", "error"]
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string()]
    told = "_edited string, applied array<string>, skipped array<string>, unresolved bigint, error string"
    source = files.select(*[F.col(c).cast("string") for c in names])
    return source.mapInArrow(rows, f"{', '.join(f'{c} string' for c in names)}, {told}").select(
        *names, F.coalesce("_edited", "before").alias("after"), *outcome[1:])


def _texts(column: pa.Array) -> list[str]:
    """The texts of a column; bytes that are no UTF-8 become replacement characters, as in Spark's expressions."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [t.decode("utf-8", "replace") for t in column.view(pa.binary()).to_pylist()]


# -- assembly ------------------------------------------------------------------------


def _spliced(all_tokens: Column, start: Column, end: Column, edits: Column) -> Column:
    """Tokens ``start`` to ``end`` with the edits' ranges replaced."""
    def kept(first: Column, last: Column) -> Column:
        return F.array_join(
            F.slice(all_tokens, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), ""
        )

    pieces = F.transform(
        edits,
        lambda e, i: F.concat(
            kept(F.coalesce(F.get(edits, i - 1)["to"] + 1, start), e["from"] - 1), e["text"]
        ),
    )
    rest = kept(F.coalesce(F.try_element_at(edits, F.lit(-1))["to"] + 1, start), end)
    return F.concat(F.array_join(pieces, ""), rest)


def _filled(text: Column, fragments: Column) -> Column:
    """``text`` with the slots of ``fragments`` filled."""
    return F.aggregate(
        fragments, text,
        lambda acc, f: F.replace(acc, F.concat(F.lit(SLOT), f["id"], F.lit(SLOT)), f["text"]),
    )


def render(edited: DataFrame) -> DataFrame:
    """Build ``after`` from ``before``, its ``_tokens`` and its units, within the row.

    Fragments are filled from the inside out: each round completes those whose
    own slots are all filled, so that none is copied before it is complete.
    Fragments that never complete refer to each other.
    """
    before = F.col("before")
    has_units = F.coalesce(F.size("units") > 0, F.lit(False))
    fragment_type = "array<struct<id:string,text:string>>"
    all_tokens = F.col("_tokens")
    with_texts = F.transform(
        "units",
        lambda u: F.struct(
            u["unit"].alias("unit"), u["from"].alias("from"), u["to"].alias("to"), u["trimmed"].alias("trimmed"),
            F.transform(
                u["edits"],
                lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), _written(e, all_tokens).alias("text")),
            ).alias("edits"),
        ),
    )
    split_up = edited.withColumn("_units", with_texts)
    main_edits = F.coalesce(
        F.get(F.filter("_units", lambda u: u["unit"] == -1), F.lit(0))["edits"],
        F.array().cast("array<struct<from:bigint,to:bigint,text:string>>"),
    )
    fragments = F.transform(
        F.filter("_units", lambda u: u["unit"] >= 0),
        lambda u: F.struct(
            u["unit"].cast("string").alias("id"), u["trimmed"].alias("trimmed"),
            _spliced(all_tokens, u["from"], u["to"], u["edits"]).alias("text"),
        ),
    )
    spliced = split_up.withColumn("_main_edits", main_edits).select(
        "*",
        _spliced(
            all_tokens, F.lit(0).cast("bigint"), F.size(all_tokens).cast("bigint") - 1, F.col("_main_edits")
        ).alias("_main"),
        F.transform(
            fragments,
            lambda f: F.struct(f["id"].alias("id"), F.when(f["trimmed"], strip(f["text"])).otherwise(f["text"]).alias("text")),
        ).alias("_todo"),
    )
    # The first round completes the fragments without slots; each nested one needs at most one more.
    rounds = F.sequence(
        F.lit(1), F.size(F.filter("_todo", lambda f: f["text"].contains(SLOT))) + 1
    )

    def step(state: Column, _: Column) -> Column:
        waiting = F.transform(
            state["todo"],
            lambda f: F.struct(f["id"].alias("id"), _filled(f["text"], state["fresh"]).alias("text")),
        )
        fresh = F.filter(waiting, lambda f: ~f["text"].contains(SLOT))
        return F.struct(
            F.concat(state["done"], fresh).alias("done"),
            fresh.alias("fresh"),
            F.filter(waiting, lambda f: f["text"].contains(SLOT)).alias("todo"),
        )

    nothing = F.array().cast(fragment_type)
    start = F.struct(
        nothing.alias("done"), nothing.alias("fresh"), F.col("_todo").cast(fragment_type).alias("todo")
    )
    resolved = spliced.withColumn(
        "_fragments", F.aggregate(rounds, start, step, lambda s: s["done"])
    ).withColumn("_text", _filled(F.col("_main"), F.col("_fragments")))
    resolved = resolved.withColumn("_parts", F.split("_text", CUT))
    parts = F.col("_parts")
    trimmed = F.transform(
        parts,
        lambda p, i: F.when(
            F.size(parts) > 1,
            F.when(i == 0, rstrip(p)).when(i == F.size(parts) - 1, lstrip(p)).otherwise(strip(p)),
        ).otherwise(p),
    )
    joined = F.array_join(
        F.filter(trimmed, lambda p, i: (p != "") | (i == 0) | (i == F.size(parts) - 1)), "\n"
    )
    error = F.coalesce(
        F.col("file_error"), F.when(F.col("_text").contains(SLOT), "template reference cycle")
    )
    no_texts = F.array().cast("array<string>")
    failed = F.col("error").isNotNull()
    after = (
        F.when(failed | ~has_units, before)
        .when(F.col("_text").contains(CUT), joined)
        .otherwise(F.col("_text"))
    )
    # A one-row inline: a filter on the results must not be pushed into this
    # function, where it would repeat the whole assembly for each mention.
    return resolved.withColumn("error", error).select(
        *FILE, "before",
        F.inline(F.array(F.struct(
            after.alias("after"),
            F.when(failed, no_texts).otherwise(F.coalesce("applied", no_texts)).alias("applied"),
            F.coalesce("skipped", no_texts).alias("skipped"),
            F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
            F.col("error"),
        ))),
    )


# -- plug-in rules -------------------------------------------------------------------


# Passes that nearly all rules settle in; only texts that have not go on.
FEW_PASSES = 4
# A rule whose matches become more in so many passes in a row does not settle.
GROWING_PASSES = 8


def apply_rules(files: DataFrame, rules: list, rounds: int | None = None, applies: list | None = None) -> DataFrame:
    """Apply plug-in rules whose rewrite is a replacement text or a Column function.

    Every rule is repeated within the row until it changes nothing more. ``rounds`` bounds the passes; without it a
    rule may take as many as the text has characters, and two. It ends early when a text comes again or when its matches
    become more in eight passes in a row. A file with a rule that has not settled keeps its text and gets an error;
    ``exhausted`` lists such rules. ``applies`` has a condition per rule: other files pass it by.

    Files are dealt out by their keys first: a rule may take hundreds of passes, and a source may come in few pieces.
    """
    from shiftwright.catalog import ELEMENT_EDIT

    usable = [(i, r) for i, r in enumerate(rules) if r.rewrite is not None and r.rewrite != ELEMENT_EDIT]
    none = F.array().cast("array<string>")
    guard = ["_applies"] if applies else []
    out = _dealt_out(files).select(
        *FILE, normalize_newlines(F.col("content")).alias("before"), none.alias("_applied"), none.alias("_open"),
        *([F.array(*applies).alias("_applies")] if applies else []),
    ).withColumn("_text", F.col("before"))
    kept = [*FILE, "before", "_applied", "_open", *guard]
    for i, rule in usable:
        passes = _passes(F.col("_text"), rule, rounds)
        if applies:
            passes = F.when(F.get("_applies", F.lit(i)), passes).otherwise(
                F.struct(F.col("_text").alias("text"), F.lit(True).alias("done")))
        # One-row inlines: what they compute is not repeated where it is used.
        few = out.select(*kept, F.col("_text").alias("_was"), F.inline(F.array(passes)).alias("_text", "_done"))
        long = few.select(*kept, "_was", F.inline(F.array(_until_settled(rule, rounds))).alias("_text", "_done"))
        name = F.array(F.lit(rule.pattern_id))
        out = long.select(
            *FILE, "before", "_text", *guard,
            F.when(F.col("_text") != F.col("_was"), F.concat("_applied", name)).otherwise(F.col("_applied")).alias("_applied"),
            F.when(~F.coalesce("_done", F.lit(True)), F.concat("_open", name)).otherwise(F.col("_open")).alias("_open"),
        )
    skipped = [
        F.when(
            F.get("_applies", F.lit(i)) & F.col("before").rlike(r.regex) if applies else F.col("before").rlike(r.regex),
            F.lit(r.pattern_id),
        )
        for i, r in enumerate(rules) if r.rewrite is None
    ]
    settled = F.size("_open") == 0
    after = F.when(settled, F.col("_text")).otherwise(F.col("before"))
    error = F.when(F.col("before").isNull(), "unreadable text").when(
        ~settled, F.concat(F.lit("rules that do not settle: "), F.array_join("_open", ", "))
    )
    return out.select(
        *FILE, "before", after.alias("after"),
        F.when(settled, F.col("_applied")).otherwise(none).alias("applied"),
        (F.array_compact(F.array(*skipped)) if skipped else none).alias("skipped"),
        F.col("_open").alias("exhausted"),
        (~F.col("before").eqNullSafe(after)).alias("was_modified"),
        error.isNull().alias("success"),
        error.alias("error"),
    )


def rewrite_by_key(files: DataFrame, catalog) -> DataFrame:
    """Rewrite files of many migrations, by their ``framework`` and ``migration``: before, after, error.

    Element edits and plug-in rules each take all files they concern in one pass, whatever the number of migrations.
    Where a migration has both, the element edits come first.
    """
    from shiftwright.catalog import ELEMENT_EDIT, same_key

    keyed = catalog.keyed_rules()
    rules, applies = [r for *_, r in keyed], [same_key(fw, mig) for fw, mig, *_ in keyed]
    by_element = {(fw, mig) for fw, mig, _, r in keyed if r.rewrite == ELEMENT_EDIT}
    by_text = {(fw, mig) for fw, mig, _, r in keyed if r.rewrite not in (None, ELEMENT_EDIT)}
    outcome = [*FILE, "before", "after", "error"]

    def of(keys: set) -> Column:
        return reduce(lambda a, b: a | b, [same_key(*k) for k in sorted(keys)], F.lit(False))

    out = rewrite_templates(files.filter(of(by_element))).select(*outcome)
    both = by_element & by_text
    if both:
        # Only the keys of the files travel to their edited texts.
        edited = out.join(files.filter(of(both)).select(*FILE, "framework", "migration"), FILE)
        usable = edited.filter(F.col("error").isNull()).withColumn("content", F.col("after"))
        again = apply_rules(usable, rules, applies=applies).select(*FILE, F.col("after").alias("_after"), F.col("error").alias("_error"))
        out = out.join(again, FILE, "left").select(
            *FILE, "before",
            F.when(F.col("_error").isNotNull(), F.col("before")).otherwise(F.coalesce("_after", "after")).alias("after"),
            F.coalesce("error", "_error").alias("error"),
        )
    rest = files.filter(~of(by_element))
    return out.unionByName(apply_rules(rest, rules, applies=applies).select(*outcome))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _once(rule, text: Column) -> Column:
    return rule.rewrite(text) if callable(rule.rewrite) else F.regexp_replace(text, rule.regex, rule.rewrite)


def _passes(text: Column, rule, rounds: int | None) -> Column:
    """(text, done) after a few passes. A first test decides whether any is worth its cost."""
    def step(acc: Column, _: Column) -> Column:
        changed = _bound(_once(rule, acc["text"]), lambda t: F.struct(t.alias("text"), (t == acc["text"]).alias("done")))
        return F.when(acc["done"], acc).otherwise(changed)

    most = FEW_PASSES if rounds is None else min(FEW_PASSES, rounds + 1)
    begin = F.struct(text.alias("text"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(most)), begin, step)
    idle = F.struct(text.alias("text"), F.lit(True).alias("done"))
    return F.when(text.rlike(rule.regex), folded).otherwise(idle)


def _until_settled(rule, rounds: int | None) -> Column:
    """(text, done) of the texts that few passes left open, by as many more as it takes.

    A text that comes again shows a cycle: the hash of one earlier text is kept and replaced after 1, 2, 4, ... passes,
    so that any cycle meets it.
    """
    text, done = F.col("_text"), F.col("_done")

    def step(acc: Column, _: Column) -> Column:
        def after(t: Column) -> Column:
            same, hashed = t == acc["text"], F.xxhash64(t)
            matches = F.regexp_count(t, F.lit(rule.regex)).cast("long")
            grown = F.when(matches > acc["matches"], acc["grown"] + 1).otherwise(0)
            full = acc["lap"] + 1 >= acc["power"]
            return F.struct(
                t.alias("text"), same.alias("done"),
                (~same & ((hashed == acc["seen"]) | (grown >= GROWING_PASSES))).alias("lost"), matches.alias("matches"),
                grown.cast("int").alias("grown"), F.when(full, hashed).otherwise(acc["seen"]).alias("seen"),
                F.when(full, 0).otherwise(acc["lap"] + 1).cast("long").alias("lap"),
                F.when(full, acc["power"] * 2).otherwise(acc["power"]).alias("power"),
            )

        return F.when(acc["done"] | acc["lost"], acc).otherwise(_bound(_once(rule, acc["text"]), after))

    begin = F.struct(
        text.alias("text"), F.lit(False).alias("done"), F.lit(False).alias("lost"),
        F.regexp_count(text, F.lit(rule.regex)).cast("long").alias("matches"), F.lit(0).alias("grown"),
        F.xxhash64(text).alias("seen"), F.lit(0).cast("long").alias("lap"), F.lit(1).cast("long").alias("power"),
    )
    # The last pass only shows that nothing changes.
    most = F.length(text) + 2 if rounds is None else F.lit(rounds + 1 - FEW_PASSES)
    folded = F.aggregate(
        F.sequence(F.lit(1), most), begin, step, lambda s: F.struct(s["text"].alias("text"), s["done"].alias("done")))
    idle = F.struct(text.alias("text"), done.alias("done"))
    if rounds is not None and rounds + 1 <= FEW_PASSES:
        return idle
    return F.when(F.coalesce(done, F.lit(True)), idle).otherwise(folded)


def map_rewrite(files: DataFrame, rewrite) -> DataFrame:
    """Apply a Python function ``text -> text`` per file, in Arrow batches.

    An exception of the function becomes the file's error; the job goes on.
    """
    def batches(frames):
        for frame in frames:
            after, errors = [], []
            for text in frame["before"]:
                try:
                    after.append(None if text is None else rewrite(text))
                    errors.append("unreadable text" if text is None else None)
                except Exception as failure:  # noqa: BLE001 - reported per file
                    after.append(text)
                    errors.append(str(failure))
            yield frame.assign(after=after, error=errors)

    source = files.select(*FILE, normalize_newlines(F.col("content")).alias("before"))
    schema = "project string, path string, before string, after string, error string"
    return source.mapInPandas(batches, schema).withColumn(
        "was_modified", ~F.col("before").eqNullSafe(F.col("after"))
    ).withColumn("success", F.col("error").isNull())

"""Line differences between the text of a file before and after a rewrite."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright.functions.text import lines

FILE = ["project", "path"]


def _side(text: Column, side: int) -> Column:
    return F.transform(
        lines(text),
        lambda line, i: F.struct(F.lit(side).alias("side"), (i + 1).cast("bigint").alias("line_no"), line.alias("text")),
    )


def line_diff(rewrites: DataFrame) -> DataFrame:
    """Lines of changed files as removed, added or kept.

    The n-th copy of a line before pairs with its n-th copy after. Both sides
    come from one row, so there is no join and one shuffle by file; unchanged
    files are dropped before it.
    """
    changed = rewrites.filter(~F.col("before").eqNullSafe(F.col("after"))).select(
        *FILE,
        F.inline_outer(F.concat(_side(F.coalesce("before", F.lit("")), 0), _side(F.coalesce("after", F.lit("")), 1))),
    ).filter(F.col("side").isNotNull()).repartition(*FILE)
    nth = F.row_number().over(Window.partitionBy(*FILE, "text", "side").orderBy("line_no"))
    before_line = F.max(F.when(F.col("side") == 0, F.col("line_no")))
    after_line = F.max(F.when(F.col("side") == 1, F.col("line_no")))
    return (
        changed.withColumn("nth", nth)
        .groupBy(*FILE, "text", "nth")
        .agg(before_line.alias("before_line"), after_line.alias("after_line"))
        .select(
            *FILE, "text", F.col("nth").cast("bigint").alias("nth"), "before_line", "after_line",
            F.when(F.col("after_line").isNull(), "removed")
            .when(F.col("before_line").isNull(), "added")
            .otherwise("kept").alias("change"),
        )
    )


def diff_text(line_changes: DataFrame) -> DataFrame:
    """Per file the removed and added lines as text, in file order, removals first."""
    changed = line_changes.filter(F.col("change") != "kept")
    removed = F.col("change") == "removed"
    item = F.struct(
        F.coalesce("before_line", "after_line").alias("at"),
        F.when(removed, 0).otherwise(1).alias("order"),
        F.concat(F.when(removed, "-").otherwise("+"), F.col("text")).alias("line"),
    )
    body = F.array_join(F.array_sort(F.collect_list(item))["line"], "\n")
    return changed.groupBy(*FILE).agg(
        F.concat(F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n"), body).alias("diff")
    )


# -- ordered differences -----------------------------------------------------------------

CONTEXT = 3
NO_END = "\\ No newline at end of file\n"


def _kept_lines(text: Column) -> Column:
    """Lines with their ends; only the last one may have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)"), lambda x: x != "")


def _longest(pairs: pd.Series) -> pd.Series:
    """Of (b, a) in the order of b, the longest part in which a grows as well: patience sorting."""
    def of(each) -> list:
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for i, pair in enumerate(each):
            at = bisect.bisect_left(tops, pair["a"])
            before.append(ends[at - 1] if at else -1)
            tops[at : at + 1] = [pair["a"]]
            ends[at : at + 1] = [i]
        found, i = [], ends[-1] if ends else -1
        while i >= 0:
            found.append({"b": each[i]["b"], "a": each[i]["a"]})
            i = before[i]
        return found[::-1]

    return pairs.map(of)


def _anchors(changed: DataFrame) -> DataFrame:
    """(project, path, anchors): lines that stand once on either side, as far as their order is the same."""
    def side(column: str, place: int) -> Column:
        return F.transform(column, lambda t, i: F.struct(F.lit(place).alias("side"), i.alias("at"), t.alias("line")))

    rows = changed.select(*FILE, F.inline(F.concat(side("_b", 0), side("_a", 1))))
    longest = F.pandas_udf(_longest, "array<struct<b:int,a:int>>")
    both = rows.groupBy(*FILE, "line").agg(
        F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"),
        F.max(F.when(F.col("side") == 0, F.col("at"))).alias("b"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("a"),
    ).where("n = 1 AND m = 1")
    return both.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("b", "a"))).alias("_pairs")
    ).select(*FILE, longest("_pairs").alias("_anchors"))


def _edits(b: Column, a: Column, anchors: Column) -> Column:
    """What differs between anchors, as (b, b_size, a, a_size) in order.

    Of a gap with as many lines on both sides, line for line; of another, all but what it begins and ends with alike.
    """
    def struct(at: Column, size: Column, to: Column, much: Column) -> Column:
        names = ("b", "b_size", "a", "a_size")
        return F.struct(*[c.cast("int").alias(n) for c, n in zip((at, size, to, much), names, strict=True)])

    one, zero = F.lit(1), F.lit(0)
    edge = F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("a"))
    last = F.struct(F.size(b).alias("b"), F.size(a).alias("a"))
    ends = F.concat(F.array(edge), anchors, F.array(last))

    def gap(after: Column, i: Column) -> Column:
        before = F.get(ends, i)
        return struct(before["b"] + 1, after["b"] - before["b"] - 1, before["a"] + 1, after["a"] - before["a"] - 1)

    def numbers(count: Column) -> Column:
        return F.when(count > 0, F.sequence(zero, count - 1)).otherwise(F.array().cast("array<int>"))

    def inside(g: Column) -> Column:
        short = F.least(g["b_size"], g["a_size"])
        unlike = F.filter(numbers(short), lambda i: F.get(b, g["b"] + i) != F.get(a, g["a"] + i))
        first = F.coalesce(F.get(unlike, zero), short)
        back = F.filter(
            numbers(short - first),
            lambda i: F.get(b, g["b"] + g["b_size"] - 1 - i) != F.get(a, g["a"] + g["a_size"] - 1 - i),
        )
        alike = F.coalesce(F.get(back, zero), short - first)
        rest = struct(g["b"] + first, g["b_size"] - first - alike, g["a"] + first, g["a_size"] - first - alike)
        return F.when(
            g["b_size"] == g["a_size"], F.transform(unlike, lambda i: struct(g["b"] + i, one, g["a"] + i, one))
        ).otherwise(F.array(rest))

    gaps = F.filter(F.transform(F.slice(ends, 2, F.size(ends)), gap), lambda g: (g["b_size"] > 0) | (g["a_size"] > 0))
    def merge(found: Column, e: Column) -> Column:
        """Edits next to one another are one."""
        end = F.try_element_at(found, F.lit(-1))
        joined = struct(end["b"], end["b_size"] + e["b_size"], end["a"], end["a_size"] + e["a_size"])
        near = F.coalesce((end["b"] + end["b_size"] == e["b"]) & (end["a"] + end["a_size"] == e["a"]), F.lit(False))
        return F.when(near, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(joined))).otherwise(
            F.concat(found, F.array(e)))

    none = F.array().cast("array<struct<b:int,b_size:int,a:int,a_size:int>>")
    return F.aggregate(F.flatten(F.transform(gaps, inside)), none, merge)


def _hunks(edits: Column, context: int) -> Column:
    """Edits whose contexts meet, together."""
    def step(found: Column, e: Column) -> Column:
        open_ = F.try_element_at(found, F.lit(-1))
        end = F.try_element_at(open_, F.lit(-1))
        near = F.coalesce(e["b"] - end["b"] - end["b_size"] <= 2 * context, F.lit(False))
        joined = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.concat(open_, F.array(e))))
        return F.when(near, joined).otherwise(F.concat(found, F.array(F.array(e))))

    return F.aggregate(edits, F.array().cast("array<array<struct<b:int,b_size:int,a:int,a_size:int>>>"), step)


def _hunk(b: Column, a: Column, edits: Column, context: int) -> Column:
    """(before_from, before_count, after_from, after_count, body); lines count from 1."""
    def written(mark: str, side: Column, start: Column, size: Column) -> Column:
        return F.array_join(F.transform(F.slice(side, start + 1, size), lambda t: F.concat(
            F.lit(mark), t, F.when(t.endswith("\n"), "").otherwise("\n" + NO_END))), "")

    first, last = F.get(edits, F.lit(0)), F.try_element_at(edits, F.lit(-1))
    lead = F.least(first["b"], F.lit(context))
    end = last["b"] + last["b_size"]
    trail = F.least(F.size(b) - end, F.lit(context))

    def part(e: Column, i: Column) -> Column:
        before = F.get(edits, i - 1)
        since = F.coalesce(before["b"] + before["b_size"], e["b"] - lead)
        return F.concat(
            written(" ", b, since, e["b"] - since), written("-", b, e["b"], e["b_size"]), written("+", a, e["a"], e["a_size"]))

    body = F.concat(F.array_join(F.transform(edits, part), ""), written(" ", b, end, trail))
    count, much = end + trail - first["b"] + lead, last["a"] + last["a_size"] + trail - first["a"] + lead
    # An empty side names the line before it.
    return F.struct(
        (first["b"] - lead + F.when(count > 0, 1).otherwise(0)).alias("before_from"), count.alias("before_count"),
        (first["a"] - lead + F.when(much > 0, 1).otherwise(0)).alias("after_from"), much.alias("after_count"), body.alias("body"),
    )


def ordered_diff(rewrites: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(project, path, hunk, before_from, before_count, after_from, after_count, body) of changed files.

    A patience diff: lines that stand once on either side are matched by a grouping, the longest part of them in the
    same order are anchors, and what lies between is compared within the row. Hunks have ``context`` lines around and
    apply to ``before`` from the first to the last. A file is one row of ``rewrites``; null texts count as empty ones,
    unchanged files have no rows. Lines end at a line feed; a last line without one is marked in the body.
    """
    changed = rewrites.filter(~F.coalesce("before", F.lit("")).eqNullSafe(F.coalesce("after", F.lit("")))).select(
        *FILE, _kept_lines(F.col("before")).alias("_b"), _kept_lines(F.col("after")).alias("_a"))
    none = F.array().cast("array<struct<b:int,a:int>>")
    b, a = F.col("_b"), F.col("_a")
    # One-row inlines keep each step from being repeated in the next.
    edits = changed.join(_anchors(changed), FILE, "left").select(
        *FILE, "_b", "_a", F.inline(F.array(F.struct(_edits(b, a, F.coalesce("_anchors", none)).alias("_edits")))))
    return edits.select(*FILE, "_b", "_a", F.posexplode(_hunks(F.col("_edits"), context)).alias("hunk", "_edits")).select(
        *FILE, (F.col("hunk") + 1).alias("hunk"), F.inline(F.array(_hunk(b, a, F.col("_edits"), context))))


def unified_text(hunks: DataFrame) -> DataFrame:
    """(project, path, diff): the hunks of a file with their headers, as patch programs read them."""
    head = F.format_string("@@ -%d,%d +%d,%d @@\n", "before_from", "before_count", "after_from", "after_count")
    body = F.array_sort(F.collect_list(F.struct("hunk", F.concat(head, "body").alias("text"))))["text"]
    return hunks.groupBy(*FILE).agg(
        F.concat(F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n"), F.array_join(body, "")).alias("diff"))


def apply_unified(texts: DataFrame) -> DataFrame:
    """(project, path, after, clean): ``diff`` applied to ``before``, and whether every line was where the diff says.

    A null diff changes nothing. The lines of a diff are read once, in order.
    """
    raw = F.slice(F.split("diff", r"(?<=\n)"), 3, F.size(F.split("diff", r"(?<=\n)")))
    lines_ = F.filter(
        F.transform(raw, lambda t, i: F.when(
            F.coalesce(F.get(raw, i + 1), F.lit("")) == NO_END, F.regexp_replace(t, r"\n\z", "")).otherwise(t)),
        lambda t: (t != "") & (t != NO_END),
    )
    b = F.col("_b")

    def step(at: Column, line: Column) -> Column:
        mark, text = F.substring(line, 1, 1), line.substr(F.lit(2), F.length(line))
        begin = F.regexp_extract(line, r"^@@ -(\d+),(\d+) ", 1).cast("int")
        size = F.regexp_extract(line, r"^@@ -(\d+),(\d+) ", 2).cast("int")
        start = begin - F.when(size > 0, 1).otherwise(0)
        there = F.get(b, at["at"]).eqNullSafe(text)
        nothing = F.array().cast("array<string>")
        return F.struct(
            F.concat(at["out"], F.when(mark == "@", F.slice(b, at["at"] + 1, F.greatest(start - at["at"], F.lit(0))))
                     .when(mark.isin(" ", "+"), F.array(text)).otherwise(nothing)).alias("out"),
            F.when(mark == "@", start).when(mark.isin(" ", "-"), at["at"] + 1).otherwise(at["at"]).alias("at"),
            (at["clean"] & F.when(mark == "@", start >= at["at"]).when(mark.isin(" ", "-"), there).otherwise(mark == "+")).alias("clean"),
        )

    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("clean"))
    done = F.aggregate(F.col("_lines"), begin, step, lambda s: F.struct(
        F.array_join(F.concat(s["out"], F.slice(b, s["at"] + 1, F.size(b))), "").alias("after"), s["clean"].alias("clean")))
    return texts.select(
        *FILE, _kept_lines(F.col("before")).alias("_b"), F.coalesce(lines_, F.array().cast("array<string>")).alias("_lines")
    ).select(*FILE, F.inline(F.array(done)))

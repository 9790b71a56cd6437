"""The order in which files can be migrated: what a file imports comes before it, files that import each other together.

Levels are peeled in rounds: files whose imports all have a level get the next one. Where no file is left to peel, the
rest holds cycles; its strongly connected components are found by forward and backward reach, each becomes one node,
and peeling goes on. Files are numbered in the order of project and path, and rounds work on numbers. A round joins the
edges that are left with the few nodes that the last one moved, is written to the shared folder, and ends with an empty
frontier; nothing but such an emptiness comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.session import cut

NODE = ["project", "path"]
# What stands before the name of an imported file, and the endings that the name may leave out.
IMPORTS = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["'](\.{1,2}/[^"'\n]+)["']"""
ENDINGS = r"(?:/index)?\.(?:d\.ts|tsx?|jsx?|mjs|cjs|vue|svelte)$"


def resolved(path: Column, target: Column) -> Column:
    """The path that a relative name means in the file ``path``; null where it leads out of the project."""
    start = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    steps = F.filter(F.split(target, "/"), lambda s: ~s.isin("", "."))
    outside = F.lit(None).cast("array<string>")

    def step(at: Column, name: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(outside)
        return F.when(name == "..", up).otherwise(F.concat(at, F.array(name)))

    return F.array_join(F.aggregate(steps, start, step), "/")


def import_edges(files: DataFrame, pattern: str = IMPORTS, endings: str = ENDINGS) -> DataFrame:
    """(project, path, target): which file of a project imports which other.

    Names resolve against the importing file; one that leaves out an ending means every file that differs by an ending
    only. Names of packages, of files that are not there and of the file itself give no edge, nor do null contents.
    """
    # Dealt out by file, as a scan of few large pieces would leave the patterns to few tasks.
    names = files.repartition(*NODE).where(F.col("content").rlike(r"[\"']\.{1,2}/")).select(
        *NODE, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("name")
    ).select(*NODE, resolved(F.col("path"), F.col("name")).alias("key"))
    keys = files.select(
        "project", F.col("path").alias("target"),
        F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", endings, "")))).alias("key"),
    ).distinct()
    return names.join(keys, ["project", "key"]).where("path <> target").select(*NODE, "target").distinct()


EDGE = ["a", "b"]


def _numbered(nodes: DataFrame) -> DataFrame:
    """Distinct nodes with numbers in the order of project and path, so that rounds carry no text."""
    return cut(nodes.orderBy(*NODE).withColumn("id", F.monotonically_increasing_id()), "order-nodes")


def _ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (project, path, target) as pairs of numbers; those of unknown files drop out."""
    return edges.join(nodes.select(*NODE, F.col("id").alias("a")), NODE).join(
        nodes.select("project", F.col("path").alias("target"), F.col("id").alias("b")), ["project", "target"]).select(*EDGE)


def _without(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Edges whose ``side`` is none of the nodes."""
    return edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti")


def _peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, level) of all nodes that no cycle holds back, and the edges that are left.

    A node can only become ready when an edge of it goes, so a round looks at the sources of such edges alone.
    """
    ready = cut(nodes.join(edges.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id"), "order-ready")
    out, level, rest = ready.withColumn("level", F.lit(0)), 0, edges
    while True:
        gone = ready.select(F.col("id").alias("b"))
        freed = cut(rest.join(gone, "b", "left_semi").select("a").distinct(), "order-freed")
        if freed.isEmpty():
            return out, rest
        rest = cut(rest.join(gone, "b", "left_anti").select(*EDGE), "order-edges")
        held = rest.join(freed, "a", "left_semi").select("a").distinct()
        ready = cut(freed.join(held, "a", "left_anti").select(F.col("a").alias("id")), "order-ready")
        level += 1
        out = out.unionByName(ready.withColumn("level", F.lit(level)))


def components(edges: DataFrame) -> DataFrame:
    """(project, path, component) of files on a cycle: the smallest path that reaches a file and that it reaches."""
    nodes = _numbered(edges.select(*NODE).union(edges.select("project", "target")).distinct())
    groups = _components(cut(_ids(edges, nodes), "order-edges"))
    return _named(groups, nodes)


def _named(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    name = nodes.select(F.col("id").alias("component"), F.col("path").alias("_name"))
    return groups.join(nodes, "id").join(name, "component").select(*NODE, F.col("_name").alias("component"))


def _components(rest: DataFrame) -> DataFrame:
    """(id, component) of nodes on a cycle: the smallest number of those that reach a node and that it reaches.

    Nodes that no edge enters, or none leaves, cannot be on a cycle and go first, in rounds. Then every node takes the
    smallest number that reaches it, and those that reach back to it are its component; what is left goes round again.
    """
    found = [rest.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)]
    while not rest.isEmpty():
        rest = _peeled_back(rest)
        _, rest = _peeled(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct(), rest)
        if rest.isEmpty():
            break
        low = cut(rest.select(F.col("a").alias("id")).distinct().withColumn("low", F.col("id")), "order-low")
        while True:
            # The smallest number among those that lead to a node; minima are taken within tasks first.
            taken = rest.join(low, rest["a"] == low["id"]).groupBy(F.col("b").alias("id")).agg(F.min("low").alias("into"))
            low = cut(low.join(taken, "id", "left").select(
                "id", F.least("low", F.coalesce("into", "low")).alias("low"), (F.col("into") < F.col("low")).alias("moved")
            ), "order-low")
            moved = not low.where("moved").isEmpty()
            low = low.drop("moved")
            if not moved:
                break
        # Back along edges within one smallest number.
        inside = cut(rest.join(low.select(F.col("id").alias("a"), "low"), "a").join(
            low.select(F.col("id").alias("b"), F.col("low").alias("_low")), "b").where("low = _low").select(*EDGE, "low"), "order-inside")
        reached = frontier = cut(low.where("id = low"), "order-reached")
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("id").alias("b")), "b", "left_semi")
            frontier = cut(back.select(F.col("a").alias("id"), "low").distinct().join(reached, ["id", "low"], "left_anti"), "order-frontier")
            reached = reached.unionByName(frontier)
        group = cut(reached.select("id", F.col("low").alias("component")), "order-component")
        found.append(group)
        rest = cut(_without(_without(rest, group, "a"), group, "b"), "order-edges")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _peeled_back(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes that no edge enters are peeled, as _peeled does with those that none leaves."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    nodes = turned.select(F.col("a").alias("id")).union(turned.select("b")).distinct()
    return _peeled(nodes, turned)[1].select(F.col("b").alias("a"), F.col("a").alias("b"))


def migration_order(files: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(project, path, component, level) of every file: files of a level can be migrated at the same time.

    Level 0 imports nothing; any other level is one above the highest that its files import. Files on a cycle share a
    component, named by its smallest path, and a level; any other file is its own component. ``edges`` (project, path,
    target) may be given instead of those read from contents; edges to files that are not there do not count. Repeated
    files and edges count once. An empty table gives an empty result.
    """
    nodes = _numbered(files.select(*NODE).distinct())
    found = import_edges(files) if edges is None else edges.select(*NODE, "target").distinct()
    edges = cut(_ids(found.where("path <> target"), nodes), "order-edges")
    levels, rest = _peeled(nodes.select("id"), edges)
    if rest.isEmpty():
        return nodes.join(levels, "id").select(*NODE, F.col("path").alias("component"), "level")
    # What is left are cycles and what imports them. Each cycle becomes its smallest number, and levels begin anew.
    groups = _components(rest)
    each = cut(nodes.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "order-components")
    between = edges.join(each.select(F.col("id").alias("a"), F.col("component").alias("above")), "a").join(
        each.select(F.col("id").alias("b"), F.col("component").alias("below")), "b").select(
        F.col("above").alias("a"), F.col("below").alias("b")).where("a <> b").distinct()
    levels, _ = _peeled(each.select(F.col("component").alias("id")).distinct(), cut(between, "order-edges"))
    placed = each.join(levels.withColumnRenamed("id", "component"), "component").join(nodes, "id")
    name = nodes.select(F.col("id").alias("component"), F.col("path").alias("_name"))
    return placed.join(name, "component").select(*NODE, F.col("_name").alias("component"), "level")

import random

import pytest
from pyspark.sql import functions as F

from shiftwright.operators import order

EDGES = "project string, path string, target string"


def brute(files, edges):
    """Levels and components by reach."""
    files = set(files)
    edges = {(p, a, b) for p, a, b in edges if a != b and (p, a) in files and (p, b) in files}
    reach = {f: {f[1]} for f in files}
    for _ in files:
        for p, a, b in edges:
            reach[p, a] |= reach[p, b]
    component = {(p, f): min(g for g in reach[p, f] if f in reach[p, g]) for p, f in files}
    level = dict.fromkeys(files, 0)
    for _ in files:
        for p, a, b in edges:
            if component[p, a] != component[p, b]:
                together = [f for f in files if f[0] == p and component[f] == component[p, a]]
                top = max(level[f] for f in files if f[0] == p and component[f] == component[p, b]) + 1
                for f in together:
                    level[f] = max(level[f], top)
    return {(*f, component[f], level[f]) for f in files}


def found(spark, files, edges):
    out = order.migration_order(
        spark.createDataFrame(files, "project string, path string"), spark.createDataFrame(edges, EDGES)).collect()
    return {tuple(r) for r in out}, len(out)


@pytest.mark.parametrize("count,links,seed", [(12, 14, 1), (14, 30, 2)])
def test_equals_reach(spark, count, links, seed):
    rng = random.Random(seed)
    files = [(p, f"f{i:02}") for p in "ab" for i in range(count)]
    edges = [(rng.choice("ab"), f"f{rng.randrange(count):02}", f"f{rng.randrange(count + 1):02}") for _ in range(links)]
    rows, size = found(spark, files + files[:2], edges + edges[:3])
    assert rows == brute(files, edges) and size == len(files)


def test_two_cycles_in_a_row_and_a_chain(spark):
    files = [("p", x) for x in "abcdefg"]
    edges = [("p", *x) for x in ("ab", "bc", "cb", "cd", "de", "ed", "fg", "aa")]
    rows, _ = found(spark, files, edges)
    assert rows == {("p", "a", "a", 2), ("p", "b", "b", 1), ("p", "c", "b", 1), ("p", "d", "d", 0), ("p", "e", "d", 0),
                    ("p", "f", "f", 1), ("p", "g", "g", 0)}
    assert found(spark, [], []) == (set(), 0)
    assert found(spark, files[:1], [])[0] == {("p", "a", "a", 0)}


def test_names_resolve(spark, corpus):
    texts = {
        "src/a.ts": "import x from './b';\nimport './c/';\nexport { y } from \"../lib/d.js\"; require('./a')",
        "src/b.ts": "import('../src/../src/a.ts'); from './b.vue'", "src/b.vue": None, "src/c/index.ts": "import z from 'b'",
        "lib/d.js": "import q from '../../../x'; import r from './none'",
    }
    edges = {(r.path, r.target) for r in order.import_edges(corpus(texts)).collect()}
    assert edges == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/b.vue"), ("src/a.ts", "src/c/index.ts"), ("src/a.ts", "lib/d.js"),
                     ("src/b.ts", "src/a.ts"), ("src/b.ts", "src/b.vue")}
    assert order.resolved(F.lit("a"), F.lit("b")) is not None

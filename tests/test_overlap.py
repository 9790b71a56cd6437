import random
import re

import pytest

from shiftwright.operators.retrieve import groundedness

SCHEMA = "id long, question string, contexts array<string>, answer string"


def words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def brute(row, n):
    own = words(row[3] or "")
    run = min(len(own), n)
    held = [words(c) for c in row[2] or [] if c is not None]
    runs = {tuple(w[i:i + run]) for w in held for i in range(len(w) - run + 1)}
    marks = [False] * len(own)
    for i in range(len(own) - run + 1):
        if run and tuple(own[i:i + run]) in runs:
            marks[i:i + run] = [True] * run
    spans = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
    return row[0], len(own), sum(marks), spans, sum(marks) / len(own) if own else None


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_equals_brute_force(spark, n):
    rng = random.Random(n)

    def text(most):
        return " ".join(rng.choice(["a", "B", "c.", "d"]) for _ in range(rng.randrange(most)))

    rows = [(i, "q", [text(12) for _ in range(rng.randrange(4))], text(15)) for i in range(60)]
    rows += [(100, "q", None, "a b"), (101, "q", ["a b"], None), (102, "q", [None, "", "a b c d"], "a B c"),
             (103, "q", ["?"], "..."), (104, None, ["b a"], "a"), (105, "q", ["x " * 3000 + "a b c"], "y " * 3000 + "a b c")]
    found = {tuple(r) for r in groundedness(spark.createDataFrame(rows, SCHEMA), "id", n).collect()}
    assert found == {brute(r, n) for r in rows}


def test_no_rows(spark):
    assert groundedness(spark.createDataFrame([], SCHEMA), "id").collect() == []

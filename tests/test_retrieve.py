from shiftwright.operators import retrieve


def test_portions_cut_out_the_words_of_a_request_once(spark):
    requests = spark.createDataFrame(
        [(1, "f", "m", "a b c d"), (2, "f", "m", "d x"), (3, "f", "m", None), (4, "g", "m", "a"), (5, "f", "m", "zz")],
        "id int, framework string, migration string, text string")
    chunks = spark.createDataFrame(
        [("f", "m", i, t) for i, t in enumerate(["a b", "c", "d a b", "x y", "q", "a"])] + [("g", "m", 0, "a")],
        "framework string, migration string, chunk int, text string")

    def ranked(limit):
        out = retrieve.rank_chunks_by_words(requests, chunks, ["id"], 3, limit)
        return out, sorted((r.id, r["rank"], r.chunk, r.score) for r in out.collect())

    _, whole = ranked(100)
    for limit in (1, 2, 3):
        out, rows = ranked(limit)
        assert rows == whole
        assert out.columns == ranked(100)[0].columns
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert whole[:3] == [(1, 1, 2, 3), (1, 2, 0, 2), (1, 3, 1, 1)]

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiftwright.llm import ann, decontamination, html_text, language, line_dedup, lm, ngram_join, toxicity, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "alpha beta gamma delta " * 20_000
LINE = "This very line is held by many documents of the table."
# Columns that operators use for themselves, or return.
EXTRA = "n long, score double, pos int, token string, node long, component long, h1 long, kind string, items string, words int, key int, n_lines int, n_dropped int, kept_text string, lang_pred string, hits int, base_score int, n_tokens int, text_pos int"
EXTRAS = (1, 2.0, 3, "t", 4, 5, 6, "k", "i", 7, 8, -1, -1, "kt", "xx", -1, -1, -1, -1)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
        (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
        (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 10),
        (3, "", "en", "b", 0), (4, None, "en", None, None), (None, "no id here but some words", None, "c", 5),
        (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)), (6, " \t\n\x0b ", "fr", "a", 5),
        (7, "12345 67890 !!! ???", None, "b", 3), (8, "äöü ßẞ 日本語 ﬁ \U0001f600", "de", "a", 9),
        *[(k, f"{LINE}\nown text {k} {'xyz' * k}\n  {LINE.upper()} ", "en", "a", 99) for k in range(20, 27)],
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def wide(docs):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return docs.select("*", *[F.lit(v).alias(c) for c, v in zip(names, EXTRAS, strict=True)])


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
            (2, "ONE two, three"), (2, "ONE two, three"), (3, None), (4, ""), (None, "some words"), (5, "...")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_line_dedup(wide):
    out = line_dedup.dedup_lines(wide).orderBy("doc_id").collect()
    assert len(out) == wide.count()
    assert sorted(line_dedup.dedup_lines(wide).columns) == sorted(wide.columns)
    by_id = {r.doc_id: r for r in out}
    assert by_id[26].n_dropped == 0 and by_id[26].kept_text == by_id[26].text
    assert by_id[20].n_dropped == 2 and by_id[20].kept_text.startswith("own text 20")
    assert (by_id[4].n_lines, by_id[4].n_dropped, by_id[4].kept_text) == (1, 0, "")
    assert by_id[6].n_lines == 2
    assert line_dedup.dedup_lines(wide.limit(0)).count() == 0


def test_contamination(wide, bench):
    out = decontamination.contamination(wide, bench)
    rows = out.collect()
    assert len(rows) == wide.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1]["items"] == ["2"] and by_id[1].n_hit == 3 and by_id[1].contaminated
    assert by_id[4].n_words == 0 and not by_id[4].contaminated
    none = next(r for r in rows if r.doc_id is None and r.n_words)
    assert none.n_hit == 2 and none["items"] == []
    assert by_id[5].n_words == 80_000 and by_id[5].n_hit == 0
    assert decontamination.contamination(wide, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.contamination(wide.limit(0), bench).count() == 0
    kept = decontamination.decontaminate(wide, bench)
    assert kept.columns == wide.columns and kept.where("doc_id = 1").count() == 0
    assert kept.where("doc_id = 5 or doc_id = 4").count() == 2


def test_near_duplicates(wide):
    rows = ngram_join.near_duplicates(wide, 3, 90).collect()
    assert len(rows) == wide.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == by_id[1].component_id == 1
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[6].n_shingles == 0
    assert by_id[3].component_id == 3
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert by_id[5].n_shingles == 4
    assert ngram_join.near_duplicates(wide.limit(0)).count() == 0
    kept = ngram_join.keep_one(wide)
    assert kept.columns == wide.columns
    assert kept.where("doc_id in (1, 2)").count() == 1
    assert kept.where("doc_id in (3, 4, 6)").count() == 3 and kept.where("doc_id is null").count() == 2


def test_language(wide):
    rows = language.identify(wide, wide).collect()
    assert len(rows) == wide.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[3].lang_pred == by_id[4].lang_pred == by_id[7].lang_pred == "und" and by_id[7].score == 0
    assert by_id[1].lang_pred == "en" and 0 <= by_id[1].score <= 1
    plain = wide
    assert language.identify(plain.limit(0), plain.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(plain, plain.limit(0)).collect()} == {"und"}


def test_toxicity(spark, wide):
    plain = wide
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows = toxicity.assess(plain, plain, labels).collect()
    assert len(rows) == wide.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.assess(plain.limit(0), plain, labels).count() == 0
    assert {r.score for r in toxicity.assess(plain, plain, labels.limit(0)).collect()} == {0.5}


def test_lm(wide):
    plain = wide.drop("lang", "source", "n_chars")
    rows = lm.scored(plain, plain, VOCABULARY).collect()
    assert len(rows) == wide.count()
    empty = [r for r in rows if r.doc_id in (3, 4, 6)]
    assert {r.n_tokens for r in empty} == {1} and len({r.score for r in empty}) == 1
    assert all(r.score < 0 and r.base_score < 0 and r.n_known == r.n_tokens for r in rows)
    assert lm.scored(plain.limit(0), plain, VOCABULARY).count() == 0
    none = lm.scored(plain, plain.limit(0), VOCABULARY).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [
        (100, None), (101, []), (102, [0.0, -0.0, 0.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]),
        (105, [None, 1.0, 1.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [0.0, 1.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(9))
    found = ann.nearest(table, table.where("vec_id % 20 = 0 or vec_id = 106"), k=5, shard_rows=16, query_rows=2).collect()
    good = {k: v for k, v in rows if k is not None and k < 100}
    for query in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(good[query], v)), k) for k, v in good.items() if k != query))[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query)
        assert [(v, s) for _, v, s in own] == [(k, -s) for s, k in want]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert ann.nearest(table.limit(0), table).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (2, "u\r\nv", "<p>x</p>"), (3, "b", None), (4, "c", ""),
            (None, "d", "<p>x</p>"), (5, "e", "long " * 100_000), (6, "f", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("z"))
    out = warc.archive(pages).collect()
    assert len(out) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert kinds == {("1", "revisit", "2"), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None),
                     (None, "revisit", "2"), ("5", "response", None), ("6", "response", None)}
    assert {r.html for r in out if r.page_id in ("5", "6")} == {rows[6][2], rows[7][2]}
    assert {r.payload_bytes for r in out if r.page_id == "3"} == {0}
    assert warc.archive(pages.limit(0)).count() == 0


def test_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (3, "u", "<article><p>A&amp;B  c<br>d</p><p>e"), (4, "u", "plain"),
            (5, "u", "<p>" * 3000 + "x"), (6, "u", "<a title=\"<article>\"><"), (None, "u", "<article><p>" + "w " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit(1))
    out = html_text.main_text(pages)
    assert out.columns == [*pages.columns, "text"] and out.count() == len(rows)
    assert {r.text for r in out.collect() if r.page_id in (1, 2, 6)} == {""}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, wide, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == wide.columns
                docs = out
        assert out.count() <= wide.count()


def test_keep_one_takes_columns_of_any_name(spark, wide):
    named = wide.withColumns({c: F.lit(5) for c in ("n_shingles", "component_id", "_k1", "_k2", "caller", "no column x")})
    kept = ngram_join.keep_one(named, size=5, percent=80)
    assert kept.columns == named.columns
    rows = kept.collect()
    assert {(r.n_shingles, r._k1, r.caller) for r in rows} == {(5, 5, 5)}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in ngram_join.keep_one(wide, size=5, percent=80).collect())

"""The registered queries at a small scale: against their SQL, or against brute force and held-out accuracy."""

import json
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import check_queries
import public_tokenizers
from shiftwright.llm import html_text, lm, ngram_join, queries, toxicity
from shiftwright.llm.components import components

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(tuple(check_queries.plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(queries.ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    place = [found.index(c) for c in columns]
    assert rows == sorted(tuple(check_queries.plain(r[i]) for i in place) for r in result.fetchall())


def test_bpe_equals_the_library(spark):
    import hashlib

    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in queries.op2_bpe(spark, SMALL).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op9_language(spark, MIDDLE).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in rows]) >= 0.98


def test_toxicity_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [(r.score, toxic[r.doc_id]) for r in queries.op1_toxicity(spark, MIDDLE).collect() if r.held_out and r.doc_id in toxic]
    bad, good = ([s for s, t in rows if t == k] for k in (1, 0))
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.75
    assert np.mean([s >= 0.7 for s in good]) <= 0.02


def test_lm_beats_its_base_on_held_out_texts(spark):
    # Like with like: the base has one class for all words never seen, whatever their spelling.
    rows = [r for r in queries.op5_lm(spark, MIDDLE).collect() if r.held_out]
    assert np.mean([r.seen_score > r.base_score for r in rows]) >= 0.8
    assert all(r.score <= r.seen_score + 1e-3 * r.n_tokens for r in rows if r.n_known < r.n_tokens - 5)


LM_SQL = r"""
WITH w AS (
  SELECT doc_id, crc32 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents JOIN folds USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(list_append(w, chr(10))) AS token FROM w),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n.n) AS train_tokens,
       sum(log10((coalesce(c, 0) + 1) / (n.n + 1 * (n.v + 1)))) AS base_score
FROM t LEFT JOIN c USING (token), n GROUP BY doc_id, held_out
"""


def test_lm_columns_equal_sql(spark, con):
    import pandas as pd

    rows = {r.doc_id: r for r in queries.op5_lm(spark, SMALL).collect()}
    folds = pd.DataFrame({"doc_id": list(rows), "crc32": [zlib.crc32(str(k).encode()) % 7 for k in rows]})
    con.register("folds", folds)
    found = con.execute(LM_SQL).fetchall()
    assert len(found) == len(rows)
    for doc, held_out, tokens, known, trained, base in found:
        r = rows[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, tokens, known, trained)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_text = {}
    for k, r in rows.items():
        by_text.setdefault(texts[k], set()).add((r.score, r.base_score))
    assert all(len(x) == 1 for x in by_text.values())


def test_lm_sums_all_ways_of_every_word(spark, monkeypatch):
    """Against the network's own forward pass: words with a whole form, rare ones, and words never seen."""
    texts = {k: f"the frequent words of text number{k % 3} are unbelievably spelled again " * (k % 4 + 1) for k in range(12)}
    texts |= {12: "rareword the otherrare", 13: "the rareword", 14: ""}
    asked = texts | {15: "the unseenword rareword", 16: "q" * 5, 17: "q" * 400, 18: None}
    fitted, fit = [], lm.fit

    def kept(sample, rare, subwords, *more):
        net = fit(sample, rare, subwords, *more)
        # So little text leaves the subwords' shares thin; make all ways weigh.
        net.ways, net.emit = (0.2, 0.4, 0.4), np.full_like(net.emit, 0.02)
        fitted.append((subwords, net))
        return net

    monkeypatch.setattr(lm, "fit", kept)
    monkeypatch.setattr(lm, "HEAD_SHARE", 0.02)
    table = [spark.createDataFrame(list(x.items()), "doc_id long, text string") for x in (asked, texts)]
    found = {r.doc_id: r.score for r in lm.scored(*table, public_tokenizers.path("word_bpe_49k.json")).collect()}
    cutter, net = fitted[0]
    counts = Counter(w for t in texts.values() for w in [*lm.words_of(t), lm.END])
    total = sum(counts.values())
    head = {w for w, n in counts.items() if n >= max(1, 0.02 * total)}
    assert b"rareword" not in head and lm.END in head
    others = sum(n for w, n in counts.items() if w not in head)
    for k, text in asked.items():
        words = lm.words_of(text)
        own = cutter.ids(words)
        assert [p >= 0 for p in own[2]] == [w in head for w in words]
        x, y, whole, places, _ = lm.windows([own], cutter.start, cutter.end, cutter.whole_end)
        mix, kind = net.forward(x, whole >= 0)
        each = np.einsum("wsc,wsc->ws", mix, net.emit[np.maximum(y, 0)])
        each[y < 0] = 1
        spelled = np.add.reduceat(np.log10(each.ravel().astype(float)), places)
        direct = iter(np.einsum("nk,nk->n", kind, net.words[whole[whole >= 0]]))
        score = 0
        for word, log in zip([*words, lm.END], spelled):
            more = 0.2 * next(direct) if word in head else 0.4 * counts[word] / others
            score += np.log10(0.4 * 10**log + more) if more else np.log10(0.4) + log
        assert found[k] == pytest.approx(score, rel=1e-4)
    assert found[17] < 20 * found[16] < 0  # what was never seen costs as much as its spelling
    assert found[14] == found[18]


def test_html_labels_of_pages_not_trained_on(spark):
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    labeller = html_text.fit(pages, training_pages=80)
    vectors = html_text.Vectors()
    cut = [html_text.blocks_of(r.html) for r in pages.collect()]
    marks = labeller.label([vectors.page(b) for b in cut])
    wrong = sum(int((m != (html_text.taught_labels(b) > 0.5)).sum()) for b, m in zip(cut, marks))
    assert wrong <= 0.005 * sum(map(len, cut))


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){x()}</script>", '<script>var s="<!-- x"</script>', "<SCRIPT>a<b</Script >", "<style>a<b{}</style/>",
    "<script>if(a<b && '</scripts>')</script>", "<title>a <b</title>", "<textarea><!-- x</textarea>",
    "<script><!-- <script>a<b</script> x<y --></script>", "<script><!--> <script> </script>",
])
def test_raw_elements_end_at_their_closing_tag(raw):
    assert [b.text for b in html_text.blocks_of(f"<p>one</p>{raw}<p>two</p>")] == ["one", "two"]


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "worthless": 3.0}, frozenset({"idiom"}))
    finds = {w: lexicon.look_up(w) for w in ("idiot", "idiots", "1diot", "idiooot", "worthles", "idiom", "trees", "idi")}
    assert finds["idiot"][1] == 0
    assert all(finds[w][0] in ("idiot", "worthless") for w in ("idiots", "1diot", "idiooot", "worthles"))
    assert finds["idiom"] is None and finds["trees"] is None and finds["idi"] is None
    plain, quoted = (lexicon.hits(t)[0][0] for t in ("he is an idiot now", 'he said "an idiot" now'))
    assert quoted["quoted"] and quoted["weight"] < plain["weight"]


def test_short_terms_runs_and_swapped_letters():
    lexicon = toxicity.Lexicon(dict.fromkeys(("scum", "kys", "idiot", "stupid"), 3.0), frozenset({"key", "slum"}))
    for term, words in {"scum": "scvm scumm scuuum scm sucm csum", "kys": "kyys", "idiot": "idoit", "stupid": "stupdi stpuid"}.items():
        for word in words.split():
            assert lexicon.look_up(word)[:2] == (term, 1)
    assert [lexicon.look_up(w) for w in ("key", "keeeey", "slum", "tree")] == [None] * 4


def test_look_up_equals_edit_distance_with_swaps():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcd"), int(rng.integers(3, 8)))) for _ in range(150)]
    terms = sorted(set(words[:20]))
    trie, lexicon = toxicity.build_trie(terms), toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    for word in words:
        for edits in (1, 2):
            assert dict(toxicity.automaton_matches(word, trie, edits, swaps=True)) == {
                t: distance(word, t) for t in terms if distance(word, t) <= edits
            }
        if not toxicity._RUN.search(word):
            assert (lexicon.look_up(word) is not None) == any(distance(word, t) <= 1 for t in terms)


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), int(rng.integers(1, 7)))) for _ in range(120)]
    trie = toxicity.build_trie(set(words))
    for edits in (0, 1, 2):
        for word in words[:40]:
            assert dict(toxicity.automaton_matches(word, trie, edits)) == {
                t: distance(word, t) for t in set(words) if distance(word, t) <= edits
            }


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_trie_join_equals_all_pairs(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(25):
        base = rng.choice(400, int(rng.integers(1, 60)), replace=False)
        for _ in range(int(rng.integers(1, 5))):
            kept = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.append(kept, rng.choice(400, int(rng.integers(0, 3))))).astype(np.int64))
    sets = [s for s in sets if len(s)]
    root, member = ngram_join.trie_join(sets, percent)
    forest = ngram_join.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                forest.join(a, np.array([b]))
    want_root, want_member = forest.stars()
    assert dict(zip(member.tolist(), root.tolist())) == dict(zip(want_member.tolist(), want_root.tolist()))


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTING_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 5)
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[:k] + [f"own{k}"] + words[k + 1 :])) for k in range(40)] + [(99, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    assert found == {**dict.fromkeys(range(40), 0), 99: 99}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(500, 501)], "a long, b long"))
    found = {r.node: r.component for r in components(edges).collect()}
    assert set(found[k] for k in range(201)) == {0} and found[501] == 500


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0.5 * docs.count() < out.count() <= docs.count()
    assert out.select("doc_id").distinct().count() == out.count()


def test_lm_network_reads_every_training_text(spark, monkeypatch):
    fitted, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *args: fitted.append((args[2], net := fit(*args))) or net)
    texts = [(k, " ".join(f"word{k}x{i}" for i in range(1 + k % 40))) for k in range(2_500)] + [(-1, None), (-2, ""), (-3, "")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    lm.scored(table, table, public_tokenizers.path("word_bpe_49k.json"))
    cutter, net = fitted[0]
    read = [cutter.ids(lm.words_of(t))[0] for _, t in texts if t is not None]
    assert net.windows_read == sum(-(-(len(ids) + 1) // lm.STEP) for ids in read)


def test_lm_kinds_read_every_word_of_a_text(spark):
    texts = [" ".join(f"w{i}" for i in range(k, 250 + k) for _ in range(1 + i % 3)) for k in range(0, 40, 7)] + [None, "", "unlike"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = [Counter(lm.words_of(t)) for t in texts]
    assert {bytes(r.word): r.n for r in lm._tallies(table).groupBy("word").agg({"n": "sum"}).toDF("word", "n").collect()} == \
        Counter(w for tally in wanted for w in tally)
    kinds = lm.fit_kinds(table)
    names = list(kinds.place)
    found = [Counter({names[w]: n for w, n in zip(r.words, r.times)}) for r in lm._tallies(table, kinds).collect()]
    assert sorted(map(sorted, (c.items() for c in found))) == sorted(map(sorted, (c.items() for c in wanted)))
    assert max(map(len, found)) == 250


def test_lm_cuts_all_words_at_once_as_one_by_one():
    cutter = lm.Subwords(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    symbols = dict(enumerate(lm.byte_symbols()))

    def plain(word):
        text, ids = word.decode("latin-1").translate(symbols), []
        while text:
            if text + lm.WORD_END in vocab:
                return [*ids, vocab[text + lm.WORD_END]]
            length = next(n for n in range(len(text), 0, -1) if text[:n] in vocab)
            ids.append(vocab[text[:length]])
            text = text[length:]
        return ids

    texts = [["the", "thethe", "Ünï", "q" * 300, "中文字"], [], ["unbelievably", "the", "x1y2z3", "\x00\x01"], ["-" * 9]]
    texts = [[w.encode() for w in words] for words in texts] + [[bytes(range(33, 256)), b"\xff\xfe"]]
    cutter.whole = {b"the": 0, b"q" * 300: 1}
    for _ in range(2):  # the second time the words are known
        for words, (ids, begins, place) in zip(texts, cutter.all_ids(texts), strict=True):
            assert [x.tolist() for x in np.split(ids, begins[1:])][: len(words)] == [plain(w) for w in words]
            assert place.tolist() == [cutter.whole.get(w, -1) for w in words]


def test_lm_gradients_are_right_in_single_precision():
    rng = np.random.default_rng(5)
    net = lm.Attention(40)
    net.begin(np.ones(40), rng.integers(1, 9, (12, lm.KINDS)).astype(float))
    x = rng.integers(0, 40, (6, 2 * lm.STEP)).astype(np.int32)
    x[0, : lm.STEP] = -1
    y, whole = (rng.integers(-1, n, (6, lm.STEP)).astype(np.int32) for n in (40, 12))
    found, made = net.gradients(x, y, whole)
    assert made.dtype == np.float32 and made.shape == ((y >= 0).sum(), lm.CLASSES)

    def loss():
        mix, kind = net.forward(x, whole >= 0)
        told = np.log((mix * net.emit[y]).sum(axis=2)[y >= 0].astype(float)).sum()
        return -(told + np.log((kind * net.words[whole[whole >= 0]]).sum(axis=1).astype(float)).sum()) / (y >= 0).sum()

    for name, grad in found.items():
        step, at = np.zeros_like(net.w[name]), slice(None)
        if name == "emb":
            at, grad = grad
        assert grad.dtype == np.float32
        step[at] = grad * (1e-2 / np.sqrt((grad**2).sum()))
        net.w[name] += step
        high = loss()
        net.w[name] -= 2 * step
        change = (high - loss()) / 2e-2
        net.w[name] += step
        assert change == pytest.approx(np.sqrt((grad.astype(float) ** 2).sum()), rel=0.03, abs=1e-5)

"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright.llm import ann, bpe, clustering, decontamination, html_text, language, line_dedup, lm, ngram_join, packing, toxicity, warc, whitening
from shiftwright.llm.common import crc_remainder, small_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels of two folds of three."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = labels.where(crc_remainder(F.col("doc_id"), 3) != 1)
    out = toxicity.assess(docs, docs, learned, with_hits=False)
    return out.select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


VOCABULARY = "word_bpe_49k.json"


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY)), "doc_id")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of every twentieth row, by inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six folds of seven, and by their unigrams."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    out = lm.scored(docs, docs.where(~held_out), public_tokenizers.path(VOCABULARY))
    return out.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "seen_score"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share stay in one of them."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k)
GROUP BY doc_id
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar to nine tenths."""
    small_batches(spark)
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


# Pairs meet at any common shingle here; fewer are thinkable only with the bounds that the operator has.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + least(3, len(w)) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS low FROM w UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.low AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives that are written and read back."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    return warc.archive(pages).select(
        warc.id_column(F.col("page_id"), pages).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.id_column(F.col("refers_to"), pages).alias("refers_to"),
    )


# Base32 takes 5 hexadecimal digits at a time to 4 letters.
OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
letters AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, hex,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER)
                 // CAST(pow(32, 3 - i % 4) AS INTEGER)) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest
  FROM p),
kept AS (SELECT hex, max(page_id) AS keeper FROM letters GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM letters JOIN kept USING (hex)
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = language.identify(docs.select("doc_id", "text"), docs.where(~held_out).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of which benchmark items."""
    small_batches(spark)
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontamination.digest(F.col("items")).alias("items_sha256"), "contaminated",
    )


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, w[i : i + least(13, len(w)) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
doc_windows AS (
  SELECT doc_id, m, i, w[i : i + m - 1] AS words
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, sizes)),
hits AS (SELECT doc_id, item_id, i, m FROM doc_windows JOIN windows USING (m, words)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2,048 token ids."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the vectors in whole numbers, after ten rounds."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = clustering.cluster(vectors, k=8, rounds=10, dim=64, scale=1024, seed="3:")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round is an assignment by distances to all centroids and a mean."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range(1, 65)) AS i FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(x) AS x, unnest(range(1, 65)) AS i FROM (
    SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c FROM v) WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS (SELECT r, c, sum((e.x - k.x) * (e.x - k.x)) AS d FROM e JOIN c{n} k USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS p FROM d{n}) WHERE p = 1)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END, x) AS x FROM c{n} LEFT JOIN m{n} USING (c, i))""")
    return "WITH " + ",".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (c)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components, with variance 1 on each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(vectors, components=8, scale=1024, offset=100_000)
    return out.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
        "identity_error",
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_neighbours": op3_neighbours,
    "op4_html": op4_html,
    "op5_lm": op5_lm,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_packing": op11_packing,
    "op12_clustering": op12_clustering,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op3_neighbours": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_ngram_join": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op10_decontamination": OP10_SQL,
    "op12_clustering": op12_sql(),
}

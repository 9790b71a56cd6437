"""Registered queries: guides, retrieval, prompts, responses, evaluation set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.catalog import default_catalog
from shiftwright.operators import retrieve
from shiftwright.plans.tables import read


def _guides(spark, sf):
    """Benchmark passages as guides: one per residue class, the longest text first."""
    keyed = read(spark, sf, "benchmark").select(
        F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("item_id") % 7).alias("migration"), "item_id", "text"
    )
    return keyed.groupBy("framework", "migration").agg(
        F.max_by("text", F.struct(F.length("text"), "item_id")).alias("text")
    )


def guides(spark, sf):
    requests = read(spark, sf, "documents").select(
        "doc_id", F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("doc_id") % 9).alias("migration")
    )
    legacy = read(spark, sf, "region").select(
        F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("r_regionkey") + 7).alias("migration"),
        F.when(F.col("r_regionkey") == 0, F.col("r_name")).otherwise("").alias("text"),
    )
    return retrieve.guides_for(requests, _guides(spark, sf), legacy).select("doc_id", "migration", "guide")


def doc_statistics(spark, sf):
    docs = read(spark, sf, "documents").select(
        F.col("source").alias("framework"), F.col("lang").alias("migration"), "text"
    )
    return retrieve.doc_statistics(docs)


def guide_chunks(spark, sf):
    """Documents joined under headings, cut again before each heading."""
    docs = read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("# One\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n## Two\ntail"), F.lit("\n#no heading")).alias("text")
    )
    return retrieve.chunks(docs, ["doc_id"]).select(
        "doc_id", F.col("chunk").cast("bigint").alias("chunk"), "text"
    )


def _chunks_of_bench(spark, sf):
    return read(spark, sf, "benchmark").select(
        F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("item_id") % 5).alias("migration"),
        F.col("item_id").alias("chunk"), "text",
    )


def _ranked_documents(spark, sf, limit=20_000):
    requests = read(spark, sf, "documents").select(
        "doc_id", F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("doc_id") % 5).alias("migration"), "text"
    )
    return retrieve.rank_chunks_by_words(requests, _chunks_of_bench(spark, sf), ["doc_id"], 3, limit)


def retrieve_words(spark, sf):
    return _ranked_documents(spark, sf).select("doc_id", "rank", "chunk", "score")


def retrieve_words_in_portions(spark, sf):
    """The same with guide chunks going round in portions."""
    return _ranked_documents(spark, sf, limit=16).select("doc_id", "rank", "chunk", "score")


def retrieve_vectors(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return retrieve.rank_vectors(vectors, retrieve.mean_vectors(vectors, ["label"]), ["label"], "vec_id", 3)


def _talk(spark, sf):
    return read(spark, sf, "conversations")


def prompts(spark, sf):
    catalog = default_catalog()
    names = [(fw, mig) for fw, mig, *_ in catalog.migrations]
    which = F.pmod("conv_id", F.lit(len(names))).cast("int")
    files = _talk(spark, sf).select(
        "conv_id", "turn",
        F.get(F.array(*[F.lit(fw) for fw, _ in names]), which).alias("framework"),
        F.get(F.array(*[F.lit(mig) for _, mig in names]), which).alias("migration"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("turn "), F.col("turn"))).alias("failure_context"),
        F.col("text").alias("content"),
    )
    out = retrieve.prompts(files, catalog.prompts_table(spark))
    return out.select(
        "conv_id", "turn", F.size("messages").cast("bigint").alias("n"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n--\n").alias("messages"),
    )


def model_slot(spark, sf):
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("role").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
    )
    asked = _talk(spark, sf).select("conv_id", "turn", messages.alias("messages"))

    def model(batch):
        if any(m[0][1] == "system" for m in batch) and len(batch) > 1:
            raise RuntimeError("one by one")
        return ["```\n" + m[1][1] + " " + m[0][1] + "\n```" for m in batch]

    return retrieve.infer(asked, model).select(
        "conv_id", "turn", retrieve.strip_fence(F.col("text")).alias("answer"), "error"
    )


def strip_fence(spark, sf):
    fence = F.get(F.array(*map(F.lit, ["```html\n", "```typescript\n", "```ts ", "```", "``", ""])), F.pmod("conv_id", F.lit(6)).cast("int"))
    response = F.concat(F.lit(" \n"), fence, F.col("text"), F.when(F.col("turn") % 2 == 0, "\n```").otherwise(""), F.lit("\n"))
    return _talk(spark, sf).select("conv_id", "turn", retrieve.strip_fence(response).alias("answer"))


def _evaluation(spark, sf):
    """User turns as questions, the following assistant turn as answer, passages as contexts."""
    by_talk = Window.partitionBy("conv_id").orderBy("turn")
    talk = _talk(spark, sf).withColumns({
        "next_role": F.lead("role").over(by_talk), "next_text": F.lead("text").over(by_talk),
        "id": F.concat_ws("/", "conv_id", "turn"),
    }).filter(F.col("role") == "user")
    questions = talk.select("id", F.col("text").alias("question"))
    answers = talk.filter(F.col("next_role") == "assistant").select("id", F.col("next_text").alias("answer"))
    requests = talk.select(
        "id", F.lit("bench").alias("framework"), F.concat(F.lit("m"), F.col("conv_id") % 5).alias("migration"), "text"
    )
    retrieved = retrieve.rank_chunks_by_words(requests, _chunks_of_bench(spark, sf), ["id"], 3)
    return retrieve.evaluation_set(questions, retrieved, answers, "id", 2)


def eval_set(spark, sf):
    return _evaluation(spark, sf).select(
        "id", "question", F.array_join("contexts", "\n--\n").alias("contexts"), "answer"
    )


def eval_overlap(spark, sf):
    """How much of each answer stands in the passages found for its question, in runs of two words."""
    return retrieve.groundedness(_evaluation(spark, sf), "id", 2)


QUERIES = {
    "guides": guides,
    "doc_statistics": doc_statistics,
    "guide_chunks": guide_chunks,
    "retrieve_words": retrieve_words,
    "retrieve_words_in_portions": retrieve_words_in_portions,
    "retrieve_vectors": retrieve_vectors,
    "prompts": prompts,
    "model_slot": model_slot,
    "strip_fence": strip_fence,
    "eval_set": eval_set,
    "eval_overlap": eval_overlap,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_rows() -> str:
    """The expected messages around the file, built from the fixed values."""
    catalog = default_catalog()
    rows = []
    for i, (fw, mig, *_) in enumerate(catalog.migrations):
        by_mig = {m: text for f, m, text in fixed.SYSTEM_PROMPTS if f == fw}
        docs = catalog.docs.get((fw, mig)) or f"# {dict(catalog.frameworks)[fw]} {mig} Migration\n\nNo bundled docs found."
        system = by_mig.get(mig, by_mig["*"]).replace("{context}", docs)
        pairs = [(u, a) for f, m, _, u, a in fixed.EXAMPLES if (f, m) == (fw, mig)]
        shown = "".join(f"\n--\nuser: {u}\n--\nassistant: {a}" for u, a in pairs)
        rows.append(f"({i}, {_quoted(system)}, {_quoted(shown)}, {2 + 2 * len(pairs)})")
    return ", ".join(rows)


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_RANKED_SQL = f"""
chunks AS (SELECT item_id, item_id % 5 AS m, text, list_distinct({_WORDS.format('text')}) AS words FROM benchmark),
scored AS (
  SELECT r.id, c.item_id AS chunk, c.text AS chunk_text, len(list_intersect(c.words, r.words)) AS score
  FROM (SELECT id, m, list_distinct({_WORDS.format('text')}) AS words FROM requests) r JOIN chunks c USING (m)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS rank FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) <= 3)"""
_RETRIEVE_SQL = f"""
WITH requests AS (SELECT doc_id AS id, doc_id % 5 AS m, text FROM documents), {_RANKED_SQL}
SELECT id AS doc_id, rank, chunk, score::BIGINT AS score FROM ranked"""

ORACLES = {
    "guides": """
WITH g AS (
  SELECT 'm' || item_id % 7 AS migration, text FROM benchmark
  QUALIFY row_number() OVER (PARTITION BY item_id % 7 ORDER BY length(text) DESC, item_id DESC) = 1)
SELECT doc_id, 'm' || doc_id % 9 AS migration, coalesce(g.text,
    CASE doc_id % 9 WHEN 7 THEN (SELECT r_name FROM region WHERE r_regionkey = 0) END,
    '# Bench m' || doc_id % 9 || ' Migration' || chr(10) || chr(10) || 'No documentation found.') AS guide
FROM documents LEFT JOIN g ON g.migration = 'm' || doc_id % 9""",
    "doc_statistics": "SELECT source AS framework, lang AS migration, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL",
    "guide_chunks": """
SELECT doc_id, 0::BIGINT AS chunk, '# One' || chr(10) || replace(text, '#', '') AS text FROM documents UNION ALL
SELECT doc_id, 1, '## Two' || chr(10) || 'tail' || chr(10) || '#no heading' FROM documents""",
    "retrieve_words": _RETRIEVE_SQL,
    "retrieve_words_in_portions": _RETRIEVE_SQL,
    "retrieve_vectors": """
WITH parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings),
means AS (SELECT label, dim, avg(v) AS q FROM parts GROUP BY label, dim),
dots AS (
  SELECT vec_id, label, round(sum(v * q) / (sqrt(sum(v * v)) * sqrt(sum(q * q))), 6) AS score
  FROM parts JOIN means USING (label, dim) GROUP BY vec_id, label)
SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM dots
QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 3""",
    "prompts": f"""
WITH p(i, system, shown, n) AS (VALUES {_prompt_rows()})
SELECT conv_id, turn, n::BIGINT AS n, 'system: ' || system
  || CASE WHEN role = 'assistant' THEN {_quoted(fixed.FAILURE_PROMPT)} || 'turn ' || turn ELSE '' END
  || shown || chr(10) || '--' || chr(10) || 'user: Migrate this file:' || chr(10) || text AS messages
FROM conversations JOIN p ON i = conv_id % {len(fixed.MIGRATIONS)}""",
    "model_slot": """
SELECT conv_id, turn, regexp_replace(text, '^\\s+', '') || ' ' || role AS answer, NULL::VARCHAR AS error FROM conversations""",
    "strip_fence": """
SELECT conv_id, turn, regexp_replace(
  CASE conv_id % 6 WHEN 4 THEN '``' ELSE '' END || text
  || CASE WHEN turn % 2 = 0 AND conv_id % 6 IN (4, 5) THEN chr(10) || '```' ELSE '' END, '^\\s+|\\s+$', '', 'g') AS answer
FROM conversations""",
    "eval_set": f"""
WITH talk AS (
  SELECT conv_id || '/' || turn AS id, conv_id % 5 AS m, text, role,
    lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
requests AS (SELECT id, m, text FROM talk WHERE role = 'user'), {_RANKED_SQL}
SELECT talk.id, text AS question,
  coalesce((SELECT string_agg(chunk_text, chr(10) || '--' || chr(10) ORDER BY rank) FROM ranked WHERE ranked.id = talk.id AND rank <= 2), '') AS contexts,
  CASE WHEN next_role = 'assistant' THEN next_text END AS answer
FROM talk WHERE role = 'user'""",
    "eval_overlap": f"""
WITH talk AS (
  SELECT conv_id || '/' || turn AS id, conv_id % 5 AS m, text, role,
    lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
requests AS (SELECT id, m, text FROM talk WHERE role = 'user'), {_RANKED_SQL},
answers AS (
  SELECT id, CASE WHEN next_role = 'assistant' THEN {_WORDS.format('next_text')} END AS w FROM talk WHERE role = 'user'),
contexts AS (
  SELECT a.id, least(len(a.w), 2) AS size, {_WORDS.format('chunk_text')} AS w FROM answers a JOIN ranked r ON r.id = a.id AND rank <= 2),
held AS (
  SELECT DISTINCT id, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM contexts WHERE size > 0)),
runs AS (
  SELECT id, least(len(w), 2) AS size, p, array_to_string(w[p:p + least(len(w), 2) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 2) + 2)) AS p FROM answers WHERE len(w) > 0)),
hit AS (SELECT DISTINCT id, unnest(range(p, p + size)) AS p FROM runs SEMI JOIN held USING (id, gram)),
starts AS (SELECT id, (SELECT count(*) FROM hit h WHERE h.id = hit.id AND h.p = hit.p - 1) > 0 AS goes_on FROM hit),
found AS (SELECT id, count(*) AS n, count(*) FILTER (NOT goes_on) AS spans FROM starts GROUP BY id)
SELECT a.id, coalesce(len(w), 0)::BIGINT AS words, coalesce(n, 0) AS grounded_words, coalesce(spans, 0) AS spans,
  CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) END::DOUBLE AS groundedness
FROM answers a LEFT JOIN found f ON f.id = a.id""",
}

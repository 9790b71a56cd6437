"""Guides and prompts: retrieval of guide text, prompt rows, model slot, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwright import fixed_values as fixed
from shiftwright.functions.text import strip
from shiftwright.session import BROADCAST_ROW_LIMIT

MESSAGE = "struct<role:string,content:string>"
WORD = r"[^a-z0-9]+"


def guides_for(requests: DataFrame, docs: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """The whole guide of each request's (framework, migration), a legacy one, or a placeholder."""
    keys = ["framework", "migration"]
    found = requests.join(docs.select(*keys, "text"), keys, "left")
    text = F.nullif(F.col("text"), F.lit(""))
    if legacy is not None:
        old = legacy.select(*keys, F.col("text").alias("_legacy"))
        found = found.join(old, keys, "left")
        text = F.coalesce(text, F.nullif(F.col("_legacy"), F.lit("")))
    placeholder = F.concat(
        F.lit("# "), F.initcap("framework"), F.lit(" "), F.col("migration"),
        F.lit(" Migration\n\nNo documentation found."),
    )
    return found.select(*requests.columns, F.coalesce(text, placeholder).alias("guide"))


def doc_statistics(docs: DataFrame) -> DataFrame:
    """Characters of documentation per migration."""
    return docs.groupBy("framework", "migration").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")
    )


def chunks(docs: DataFrame, keys: list) -> DataFrame:
    """Documents cut before each heading, as (keys, chunk, text), chunk from 0."""
    parts = F.split("text", r"\n(?=#+ )")
    return docs.select(*keys, F.posexplode(parts).alias("chunk", "text"))


def words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD), lambda w: w != ""))


def rank_chunks_by_words(
    requests: DataFrame, guide_chunks: DataFrame, id_cols: list, n: int = 3, limit: int = BROADCAST_ROW_LIMIT
) -> DataFrame:
    """The ``n`` chunks of each request's guide that share most words with its text.

    Chunks travel to the requests as one array per (framework, migration), and
    each request is ranked within its row. The chunks are counted first; more
    than ``limit`` of them are one array per portion, which each request meets in
    a row of its own, and the best of all portions are merged. The words of a
    request are cut out once, whatever the number of portions.
    Chunks without a common word are left out; ties go to the lower chunk.
    """
    portions = -(-max(guide_chunks.count(), 1) // limit)
    asked = requests.withColumn("_words", words(F.col("text")))
    if portions == 1:
        best = _best_of_portion(asked, guide_chunks, n)
    else:
        spread = F.pmod(F.xxhash64("framework", "migration", "chunk"), F.lit(portions))
        best = _best_of_portion(
            asked.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(portions - 1).cast("bigint")))),
            guide_chunks.withColumn("_portion", spread.cast("bigint")), n, ["framework", "migration", "_portion"],
        )
        merged = Window.partitionBy(*id_cols).orderBy(F.desc("score"), "chunk")
        best = best.withColumn("rank", F.row_number().over(merged).cast("bigint")).filter(F.col("rank") <= n)
    return best.drop("_words", "text", "_portion")


def _best_of_portion(
    requests: DataFrame, guide_chunks: DataFrame, n: int, keys: list | tuple = ("framework", "migration")
) -> DataFrame:
    keys = list(keys)
    vocabulary = guide_chunks.groupBy(*keys).agg(
        F.collect_list(
            F.struct("chunk", F.col("text").alias("chunk_text"), words(F.col("text")).alias("words"))
        ).alias("_chunks"),
        F.array_distinct(F.flatten(F.collect_list(words(F.col("text"))))).alias("_vocabulary"),
    )
    # The request's words are cut down to those of the guide once, then met by each
    # chunk. Binding them to a lambda keeps them from being computed per chunk.
    known = F.array_intersect("_words", "_vocabulary")
    scored = F.flatten(
        F.transform(
            F.array(known),
            lambda own: F.transform(
                "_chunks",
                lambda c: F.struct(
                    (-F.size(F.array_intersect(c["words"], own))).alias("order"),
                    c["chunk"].alias("chunk"), c["chunk_text"].alias("chunk_text"),
                ),
            ),
        )
    )
    best = F.slice(F.array_sort(F.filter(scored, lambda c: c["order"] < 0)), 1, n)
    joined = requests.join(vocabulary, keys, "left")
    return joined.select(*requests.columns, F.posexplode(best).alias("_rank", "_best")).select(
        *requests.columns,
        (F.col("_rank") + 1).cast("bigint").alias("rank"),
        F.col("_best.chunk").alias("chunk"),
        (-F.col("_best.order")).cast("bigint").alias("score"),
        F.col("_best.chunk_text").alias("chunk_text"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rank_vectors(vectors: DataFrame, queries: DataFrame, by: list, id_col: str, n: int = 3) -> DataFrame:
    """The ``n`` vectors per key closest to the key's query, by cosine, ties by id.

    ``queries`` has one vector ``query`` per key. Ranking keeps ``n`` rows per key
    and task before anything is shuffled, however many vectors a key has.
    """
    scored = vectors.join(queries, by).withColumn(
        "score", F.round(cosine(F.col("embedding"), F.col("query")), 6)
    )
    ranked = scored.select(
        *by, id_col, "score",
        F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id_col)).alias("rank"),
    )
    return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def mean_vectors(vectors: DataFrame, by: list) -> DataFrame:
    """The mean vector per key. Sums are partial per task; a key's result has one row per dimension."""
    means = (
        vectors.select(*by, F.posexplode("embedding").alias("dim", "v"))
        .groupBy(*by, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    )
    return means.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("dim", "v")))["v"].alias("query")
    )


def prompts(files: DataFrame, prompt_table: DataFrame) -> DataFrame:
    """The messages for each file: system text with guide and failure context, examples, file.

    ``files`` has project, path, content, framework, migration and may have
    failure_context. A file without readable text gets no prompt.
    """
    keys = ["framework", "migration"]
    context = F.col("failure_context") if "failure_context" in files.columns else F.lit(None).cast("string")
    failure = F.when(
        F.coalesce(context, F.lit("")) != "", F.concat(F.lit(fixed.FAILURE_PROMPT), context)
    ).otherwise("")

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    messages = F.concat(
        message("system", F.concat(F.col("system"), failure)),
        F.coalesce("examples", F.array().cast(f"array<{MESSAGE}>")),
        message("user", F.concat(F.lit(fixed.FILE_PROMPT), F.col("content"))),
    )
    return (
        files.filter(F.col("content").isNotNull())
        .join(prompt_table, keys, "left")
        .select(*[c for c in files.columns if c != "content"], messages.alias("messages"))
    )


def infer(prompt_rows: DataFrame, model) -> DataFrame:
    """Call ``model(list of message lists) -> list of texts`` on Arrow batches of prompts.

    Adds ``text`` (the response) and ``error``. A failing batch is retried row
    by row, so that one bad prompt does not fail the others.
    """
    def ask(rows: list) -> tuple:
        try:
            answers = list(model(rows))
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} responses for {len(rows)} prompts")
            return answers, [None] * len(rows)
        except Exception as failure:  # noqa: BLE001 - reported per file
            if len(rows) == 1:
                return [None], [str(failure)]
            pairs = [ask([row]) for row in rows]
            return [p[0][0] for p in pairs], [p[1][0] for p in pairs]

    def batches(frames):
        for frame in frames:
            rows = [[(m["role"], m["content"]) for m in messages] for messages in frame["messages"]]
            answers, errors = ask(rows) if rows else ([], [])
            yield frame.drop(columns=["messages"]).assign(text=answers, error=errors)

    kept = [f for f in prompt_rows.schema.fields if f.name != "messages"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return prompt_rows.mapInPandas(batches, f"{ddl}, text string, error string")


def strip_fence(text: Column) -> Column:
    """A response without the code fence around it, if it starts with one."""
    body = strip(text)
    out = F.when(F.lit(False), body)
    for fence in fixed.CODE_FENCES:
        inner = F.substring(body, len(fence) + 1, 2**31 - 1)
        unclosed = F.when(
            inner.endswith("```"), F.substring(inner, F.lit(1), F.length(inner) - 3)
        ).otherwise(inner)
        out = out.when(body.startswith(fence), strip(unclosed))
    return out.otherwise(body)


def evaluation_set(questions: DataFrame, retrieved: DataFrame, answers: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(question, contexts, answer) rows; ``retrieved`` has (key, rank, chunk_text), rank <= n."""
    contexts = retrieved.filter(F.col("rank") <= n).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))["chunk_text"].alias("contexts")
    )
    return questions.join(contexts, key, "left").join(answers, key, "left").select(
        key, "question", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "answer"
    )


def _grams(text: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words of a text, by place. A shorter text is one run, a text without words none."""
    all_words = F.filter(F.split(F.lower(text), WORD), lambda w: w != "")
    # Binding the words to a lambda keeps them from being computed for each run.
    return F.flatten(F.transform(F.array(all_words), lambda own: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1))),
        lambda at: F.xxhash64(F.array_join(F.slice(own, at, n), " ")),
    )))


def groundedness(evaluation: DataFrame, key: str, n: int = 3) -> DataFrame:
    """How much of each answer stands in its contexts: words, grounded words, spans and the share of the words.

    ``evaluation`` is an evaluation set with one row per ``key``. A word is grounded if some run of ``n`` words that
    it lies in occurs in one of the contexts; spans are the longest stretches of grounded words. An answer of fewer words is
    grounded if a context holds it as a whole. Null and wordless answers have no words, no
    spans and a null share. The runs of answers meet an index of the runs of their own contexts, on key and run, so
    that a run that all texts share is no hot key; spans are the union of the covered places of one answer.
    """
    kept = evaluation.select(key, "contexts", "answer")
    words_of = F.filter(F.split(F.lower("answer"), WORD), lambda w: w != "")
    sized = kept.select(key, "answer", "contexts", F.coalesce(F.size(words_of), F.lit(0)).alias("words"))
    usable = sized.filter(F.col("words") > 0)
    length = F.least(F.col("words"), F.lit(n))
    runs = usable.select(key, "words", F.posexplode(_grams(F.col("answer"), n)).alias("at", "gram"))
    # An answer below n words is looked up by runs of its own length.
    index = None
    for size in range(1, n + 1):
        part = usable.filter(length == size).select(key, F.explode("contexts").alias("context")).select(
            key, F.explode(_grams(F.col("context"), size)).alias("gram"))
        index = part if index is None else index.unionByName(part)
    covered = runs.join(index, [key, "gram"], "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list("at")).alias("places"), F.first(F.least(F.col("words"), F.lit(n))).alias("run"))
    steps = F.zip_with(F.slice("places", F.lit(2), F.size("places")), F.slice("places", F.lit(1), F.size("places") - 1),
                       lambda later, earlier: later - earlier)
    union = covered.select(key, "run", steps.alias("steps")).select(
        key,
        (F.col("run") + F.aggregate("steps", F.lit(0), lambda a, d: a + F.least(d, F.col("run")))).alias("grounded"),
        (1 + F.size(F.filter("steps", lambda d: d > F.col("run")))).alias("spans"),
    )
    counted = sized.select(key, "words").join(union, key, "left")
    grounded = F.coalesce("grounded", F.lit(0)).cast("bigint")
    return counted.select(
        key, F.col("words").cast("bigint").alias("words"), grounded.alias("grounded_words"),
        F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"),
        F.when(F.col("words") > 0, grounded / F.col("words")).alias("groundedness"),
    )

"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import retrieval, search, vectors
from stratalith.plans.register import query
from stratalith.sources import bind
from stratalith.sources.shared import stored

_WORDS = f"regexp_extract_all(lower(text), '{rules.SEARCH_WORD}')"
#: Stands for a user's question.
QUESTION = ["the", "data", "value", "point"]
_Q = ", ".join(map(exprs.quoted, QUESTION))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored index of the documents, made by the first question of a session."""
    return stored(spark, "index", sf_dir, lambda: retrieval.index(_docs(spark, sf_dir)))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), t AS (SELECT doc_id, len(words) AS n_terms, unnest(words) AS term FROM d), f AS (SELECT doc_id, n_terms, term, count(*) AS freq FROM t GROUP BY doc_id, n_terms, term)
SELECT term, sum(freq)::BIGINT AS words, count(*) AS docs, sum(n_terms * 1000003 + doc_id)::BIGINT AS checked FROM f GROUP BY term""")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the stored index, with sums that any lost or doubled posting would change."""
    postings, _ = _index(spark, sf_dir)
    return postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum("freq").alias("words"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_terms") * 1000003 + F.col("doc_id")).alias("checked"))


@query(f"""WITH {bind.FILES_SQL}, s AS (SELECT path, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1800) / 1580.0))::BIGINT * 1580, 1580)) AS start FROM files WHERE length(text) > 0),
c AS (SELECT path, start, text, substring(text, start + 1, 1800) AS piece, length(substring(text, 1, start)) - length(replace(substring(text, 1, start), chr(10), '')) AS before FROM s)
SELECT path, start, length(piece) AS n_chars, (before + 1)::INT AS line_start, (before + length(piece) - length(replace(piece, chr(10), '')) + 1)::INT AS line_end FROM c""")
def chunk_text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.chunks(bind.files(spark, sf_dir).select("path", "text")).select("path", "start", F.length("text").cast("long").alias("n_chars"), "line_start", "line_end")


@query(f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS freq FROM t GROUP BY ALL)
SELECT term, count(*) AS doc_freq, sum(freq)::BIGINT AS total FROM f GROUP BY term ORDER BY doc_freq DESC, term LIMIT 100""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_stats(_docs(spark, sf_dir))


_BM25 = f"""d AS (SELECT doc_id, {_WORDS} AS words FROM documents), z AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM d WHERE words IS NOT NULL),
t AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d), f AS (SELECT doc_id, n, term, count(*) AS freq FROM t WHERE term IN ({_Q}) GROUP BY ALL), x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
p AS (SELECT doc_id, round((greatest(0.0::DOUBLE, (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (freq * 2.5::DOUBLE) / (freq + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / greatest(mean, 1.0::DOUBLE))))::DECIMAL(38,10), 8)::DECIMAL(28,8) AS part FROM f JOIN x USING (term), z),
b AS (SELECT doc_id, sum(part)::DOUBLE AS bm25 FROM p GROUP BY doc_id HAVING sum(part) > 0),
s AS (SELECT doc_id, bm25, {exprs.dec_round_sql("least(0.95::DOUBLE, 0.42::DOUBLE + bm25 / 18)", 4)} AS score FROM b)"""


@query(f"WITH {_BM25} SELECT doc_id, {exprs.dec_round_sql('bm25', 4)} AS bm25, score FROM s ORDER BY s.bm25 DESC, doc_id LIMIT 48")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(*_index(spark, sf_dir), QUESTION)
    top = found.orderBy(F.desc("bm25"), "doc_id").limit(48)
    return top.select("doc_id", exprs.dec_round(F.col("bm25"), 4).alias("bm25"), search.final_score(F.col("bm25")).alias("score"))


def _ones() -> list[float]:
    return [0.125 * (1 if i % 3 else -1) for i in range(64)]


@query(f"""WITH s AS (SELECT vec_id, {exprs.dec_round_sql(f"list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), {_ones()}::DOUBLE[])", 4)} AS similarity FROM embeddings)
SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 72""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_scores(bind.table(spark, sf_dir, "embeddings"), _ones()).orderBy(F.desc("similarity"), "vec_id").limit(72)


def _vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored index of the embeddings, made by the first search of a session."""
    table = bind.table(spark, sf_dir, "embeddings")
    return stored(spark, "vectors", sf_dir, lambda: vectors.store(table, vectors.fit(table)))


_DOT = exprs.dec_round_sql("list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE))", 4)


def _neighbours_sql(where: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS place FROM s) SELECT query_id, place, vec_id, similarity FROM r WHERE place <= 72"""


def _neighbours(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    asked = bind.table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search(_vector_index(spark, sf_dir), asked, 72, exact=True, where=where)


@query(_neighbours_sql("true"))
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 72 nearest of every twentieth vector by the stored index, lists out of reach left unread."""
    return _neighbours(spark, sf_dir)


@query(_neighbours_sql("e.label <> 0"))
def vector_neighbours_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the vectors that a condition on the stored columns admits."""
    return _neighbours(spark, sf_dir, "label <> 0")


@query("SELECT label, count(*) AS vectors, min(vec_id) AS first, max(vec_id) AS last FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY label UNION ALL SELECT -1, count(*), min(vec_id), max(vec_id) FROM embeddings WHERE vec_id % 7 = 0")
def vector_store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the store by label after every seventh vector was written again with another label."""
    index = _vector_index(spark, sf_dir)
    again = bind.table(spark, sf_dir, "embeddings").filter("vec_id % 7 = 0").withColumn("label", F.lit(-1))
    return vectors.upsert(index, again).rows().groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


_OVERLAP = exprs.dec_round_sql(f"len(list_intersect([{_Q}], coalesce({_WORDS}, []))) / {len(QUESTION)}", 4)


@query(f"SELECT doc_id, {_OVERLAP} AS lexical FROM documents")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", search.overlap(F.coalesce("text", F.lit("")), QUESTION).alias("lexical"))


@query(f"""WITH {_BM25}, v AS (SELECT vec_id AS doc_id, {exprs.dec_round_sql(f"list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), {_ones()}::DOUBLE[])", 4)} AS similarity FROM embeddings),
c AS (SELECT v.doc_id, {exprs.dec_round_sql(f"0.66::DOUBLE * similarity + 0.22::DOUBLE * {_OVERLAP}", 4)} AS score, 'vector' AS origin FROM v JOIN documents USING (doc_id) UNION ALL SELECT doc_id, score, 'bm25' FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, origin DESC) AS r FROM c) SELECT doc_id, score, origin FROM r WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 48""")
def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    vectors = search.vector_scores(bind.table(spark, sf_dir, "embeddings"), _ones()).withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id")
    postings, statistics = _index(spark, sf_dir)
    vectors = vectors.join(retrieval.lexical(postings, QUESTION), "doc_id", "left")
    near = vectors.select("doc_id", exprs.dec_round(0.66 * F.col("similarity") + 0.22 * F.coalesce("lexical", F.lit(0.0)), 4).alias("score"), F.lit("vector").alias("origin"))
    words = retrieval.bm25(postings, statistics, QUESTION).select("doc_id", search.final_score(F.col("bm25")).alias("score"), F.lit("bm25").alias("origin"))
    return search.best_candidates([near, words], 48)


@query("""WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS LAST) AS g FROM (SELECT DISTINCT lang FROM documents)), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, r.lang, r::INT AS r, g::INT AS g FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang WHERE r <= 25""")
def interleave_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.interleaved(bind.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


_ASSERT = exprs.any_contains_sql("lower(s)", rules.ASSERTIVE)


@query(f"""WITH p AS (SELECT conv_id, turn, text, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM conversations WHERE role = 'assistant'),
v AS (SELECT conv_id, turn, len(parts) AS sentences, len(list_filter(list_distinct(regexp_extract_all(text, {exprs.quoted(rules.FILE_REFERENCE)}, 1)), lambda f: f <> 'main.py')) AS missing,
len(list_filter(parts, lambda s: {_ASSERT} AND len(regexp_extract_all(s, {exprs.quoted(rules.FILE_REFERENCE)}, 1)) = 0)) AS unsupported FROM p)
SELECT *, {exprs.dec_round_sql("greatest(0.0::DOUBLE, 0.95::DOUBLE - (least(0.5::DOUBLE, 0.12::DOUBLE * missing) + least(0.35::DOUBLE, 0.07::DOUBLE * unsupported)))", 4)} AS confidence FROM v""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = bind.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return search.validated(answers, ["main.py"]).drop("text")


@query(f"""WITH e AS (SELECT l.doc_id, source, n_chars >= 500 AS found, quality = 1 AS expected FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT source, count(*) FILTER (expected) AS expected, count(*) FILTER (expected AND found) AS hits, {exprs.dec_round_sql("count(*) FILTER (expected AND found) / greatest(1, least(10, count(*) FILTER (expected)))", 4)} AS accuracy FROM e GROUP BY source""")
def accuracy_expected_vs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") >= 500).alias("found"))
    rows = bind.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")).join(docs, "doc_id")
    counts = rows.groupBy("source").agg(F.count_if("expected").alias("expected"), F.count_if(F.col("expected") & F.col("found")).alias("hits"))
    return counts.withColumn("accuracy", exprs.dec_round(F.col("hits") / F.greatest(F.lit(1), F.least(F.lit(10), F.col("expected"))), 4))

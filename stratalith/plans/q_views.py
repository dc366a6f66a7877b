"""Queries of views: scores and findings as shown, sections, node filters, slugs, symbol chunks, upserts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import knowledge, retrieval, security, views
from stratalith.plans import q_code
from stratalith.plans.q_files import _taxonomy_sql
from stratalith.plans.register import query
from stratalith.sources import bind, sources
from stratalith.sources.shared import stored

_EXEC = "round(least(100.0, greatest(0.0, (security + debt + production + CASE WHEN container = 100 THEN cto ELSE 0 END) / (3.0::DOUBLE + CASE WHEN container = 100 THEN 1 ELSE 0 END)))::DECIMAL(38,10), 0)::BIGINT"


@query(f"WITH {sources.ALL_SQL}, {q_code._SCORES}, e AS (SELECT repo_id, {_EXEC} AS executive FROM scores) SELECT *, {exprs.level_sql('executive', views.RISK_STEPS, 'critical')} AS level FROM e")
def executive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three scores and, where there is a container, a fourth."""
    c = F.col
    score = views.executive_score([c("security"), c("debt"), c("production"), F.when(c("container") == 100, c("cto"))])
    return q_code._scores(spark, sf_dir).select("repo_id", score.alias("executive")).withColumn("level", views.risk_level(c("executive")))


_RANK = exprs.by_value_sql("severity", rules.RANK, 0)


@query(f"WITH {sources.ALL_SQL} SELECT repo_id, path, line, rule_id, severity FROM found QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {_RANK} DESC, path, line, rule_id) <= 5")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.top_findings(sources.findings(spark, sf_dir)).drop("message")


@query("""WITH p AS (SELECT conv_id AS report, count(*) AS n FROM conversations GROUP BY conv_id) SELECT report, position::INT AS position, CASE position WHEN 0 THEN 'Turns ' || n ELSE 'Notes' END AS title, CASE position WHEN 0 THEN 'first\nline' ELSE '' END AS body FROM p, (SELECT unnest([0, 1]) AS position)""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bind.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("report")).agg(F.count(F.lit(1)).alias("n"))
    return views.sections(counted.select("report", F.concat(F.lit("# Turns "), F.col("n").cast("string"), F.lit("\nfirst\nline\n\n## Notes\n")).alias("text")))


@query("SELECT s_suppkey AS id, unnest(['a' || s_suppkey || '.py', 'b/c.py', 'd']) AS path FROM supplier")
def changed_path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" a"), F.col("s_suppkey").cast("string"), F.lit(".py, b/c.py\n\n d ,"))
    return bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(views.changed_paths(text)).alias("path"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._LINKS}, n AS (SELECT repo_id, count(*) AS nodes FROM src GROUP BY repo_id), e AS (SELECT repo_id, count(*) AS edges FROM links GROUP BY repo_id), f AS (SELECT repo_id, count(*) AS findings FROM found GROUP BY repo_id)
SELECT repo_id, least(100, greatest(35, nodes * 4 + edges * 2 - coalesce(findings, 0) * 6))::BIGINT AS score FROM n JOIN e USING (repo_id) LEFT JOIN f USING (repo_id)""")
def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = q_code._given(spark, sf_dir)
    per = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    one = per(files, "nodes").join(per(knowledge.dependency_edges(files, symbols), "edges"), "repo_id").join(per(findings, "findings"), "repo_id", "left").fillna(0)
    return one.select("repo_id", views.graph_score(F.col("nodes"), F.col("edges"), F.col("findings")).cast("long").alias("score"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._DRAFTS} SELECT DISTINCT repo_id, target AS id, {exprs.by_value_sql("'class'", views.LABELS, "Node")} AS label FROM drafts d WHERE contains(lower(target), 'part1') AND kind = 'class' AND NOT EXISTS (SELECT 1 FROM drafts m WHERE m.repo_id = d.repo_id AND m.target = d.target AND m.rank > d.rank)""")
def graph_node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = knowledge.dependency_nodes(q_code._files(spark, sf_dir), q_code._symbols(spark, sf_dir)).withColumn("label", F.col("id"))
    return views.nodes_like(nodes, "class", "Part1").select("repo_id", "id", views.node_labels(F.col("kind")).alias("label"))


@query(f"WITH {bind.FINDINGS_SQL} SELECT 'owasp' AS kind, {_taxonomy_sql(0)} AS name, count(*) AS findings FROM findings GROUP BY ALL UNION ALL SELECT 'cwe', {_taxonomy_sql(1)}, count(*) FROM findings GROUP BY ALL")
def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.taxonomy_counts(security.enriched(bind.findings(spark, sf_dir)))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace('.' || regexp_replace(p_name, '[^A-Za-z0-9._-]', '-', 'g') || '/', '^[.-]+|/$', '', 'g') AS safe FROM part""")
def names_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bind.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), views.slug(F.concat("p_name", F.lit(" & Co."))).alias("slug"), views.safe_name(F.concat(F.lit("."), "p_name", F.lit("/"))).alias("safe"))


@query(f"""WITH {sources.ALL_SQL}, st AS (SELECT repo_id, path, line, min(name) AS symbol FROM sym WHERE kind IN ('class', 'function') GROUP BY ALL), b AS (SELECT *, lead(line) OVER (PARTITION BY repo_id, path ORDER BY line) AS nxt FROM st),
o AS (SELECT s.repo_id, s.path, line, nxt, symbol, string_split(text, chr(10)) AS l, text FROM src s JOIN b ON b.repo_id = s.repo_id AND b.path = s.path),
c AS (SELECT repo_id, path, line AS line_start, coalesce(nxt - 1, len(l))::INT AS line_end, 'symbol' AS kind, symbol, sha256(trim(array_to_string(l[line:coalesce(nxt - 1, len(l))], chr(10)), chr(10))) AS digest FROM o)
SELECT * FROM c UNION ALL SELECT repo_id, path, 1, (length(text) - length(replace(text, chr(10), '')) + 1)::INT, 'text', NULL, sha256(text) FROM src WHERE (repo_id, path) NOT IN (SELECT (repo_id, path) FROM st)""")
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.symbol_chunks(q_code._files(spark, sf_dir), q_code._symbols(spark, sf_dir))
    return found.select("repo_id", "path", "line_start", "line_end", "kind", "symbol", F.sha2("text", 256).alias("digest"))


@query("""WITH a AS (SELECT o_orderdate::DATE AS date, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_orderdate::DATE AS date, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), c AS (SELECT o_orderdate::DATE AS date, count(*) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT date, a.v AS risk, b.v AS architecture, c.v AS security FROM a FULL JOIN b USING (date) FULL JOIN c USING (date)""")
def architecture_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bind.table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    one = lambda s: orders.filter(F.col("o_orderstatus") == s).groupBy("date").agg(F.count(F.lit(1)).alias("value"))
    return views.series_by_date(("risk", one("F")), ("architecture", one("O")), ("security", one("P")))


@query("""WITH d AS (SELECT o_custkey AS repo_id, o_orderdate::DATE AS date, count(*) AS score FROM orders GROUP BY ALL) SELECT repo_id, date, CASE WHEN date = max(date) OVER (PARTITION BY repo_id) THEN 99 ELSE score END AS score FROM d""")
def timeline_last_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = bind.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo_id"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("score"))
    return views.with_last(daily, "score", F.lit(99).cast("long"))


@query("SELECT event_id AS id FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 5 <> 0 AND ts <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 MINUTE * (60 * (user_id % 100))")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("running")
    rows = bind.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), (F.col("user_id") % 5 == 0).alias("deleted"), F.col("ts").cast("timestamp").alias("updated_at"), (60 * (F.col("user_id") % 100)).cast("int").alias("retention_minutes"))
    return views.purgeable(rows, "2024-01-30 00:00:00").select("id")


@query("""WITH o AS (SELECT c_custkey AS k, 1 AS t, c_mktsegment AS v, 0 AS side FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, (c_custkey % 2)::INT AS t, 'new' AS v, 1 AS side FROM customer WHERE c_custkey % 3 <> 1)
SELECT k, t, v FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, side DESC) = 1""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = bind.table(spark, sf_dir, "customer")
    old = customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("t"), F.col("c_mktsegment").alias("v"))
    new = customer.filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2).cast("int").alias("t"), F.lit("new").alias("v"))
    return views.upserted(old, new, "k", "t")


@query(r"""WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'See main.py first. It works!' ELSE 'It works!' END AS text FROM supplier) SELECT * FROM a""")
def answer_cited_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("s_suppkey") % 2 == 0, "See main.py first.").otherwise("See other.py first.")
    answers = bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(first, F.lit(" It works!")).alias("text"))
    return retrieval.cited_only(answers, ["main.py"])


#: Vectors stand for the sixteen chunks of each kind of language; the question is about routes.
QUESTION = "Where is the api route defined?"


@query()
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, pinned and word candidates over source files with all boosts; tests hold it against plain Python."""
    files = q_code._files(spark, sf_dir).withColumn("doc_id", F.xxhash64("repo_id", "path"))
    chunks = files.select("doc_id", "path")
    near = files.select("doc_id", exprs.dec_round(F.pmod("doc_id", F.lit(1000)) / 1000, 4).alias("similarity"))
    special = stored(spark, "special", sf_dir, lambda: q_code.architecture_files(spark, sf_dir))
    return retrieval.hybrid(chunks, near, *retrieval.index(files.select("doc_id", "text")), QUESTION, retrieval.pinned_files(QUESTION, special, files), 48)

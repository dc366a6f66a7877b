"""Queries over commits, snapshots, portfolios and pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import history, merge
from stratalith.plans.register import query
from stratalith.sources import bind

_BEFORE = "o_orderdate < TIMESTAMP '1998-01-01'"


@query(f"""WITH {bind.COMMIT_FILES_SQL}, {bind.COMMITS_SQL}, t AS (SELECT sha, sum(additions + deletions)::BIGINT AS churn FROM commit_files GROUP BY sha)
SELECT file, count(*) AS touches, min(date) AS first_seen, max(date) AS last_seen, sum(churn)::BIGINT AS churn FROM commit_files JOIN t USING (sha) JOIN commits USING (sha) GROUP BY file""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_history(bind.commit_files(spark, sf_dir), bind.commits(spark, sf_dir))


@query(f"""WITH {bind.COMMIT_FILES_SQL}, {bind.COMMITS_SQL} SELECT date, count(DISTINCT sha) AS commit_count, count(DISTINCT file) AS files, least(100, count(DISTINCT sha) * 4 + count(DISTINCT file) * 2)::BIGINT AS risk
FROM commit_files JOIN commits USING (sha) GROUP BY date ORDER BY date DESC LIMIT 30""")
def evolution_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.timeline(bind.commit_files(spark, sf_dir), bind.commits(spark, sf_dir))


@query(f"""WITH {bind.COMMIT_FILES_SQL}, f AS (SELECT * FROM commit_files WHERE sha IN (SELECT sha FROM commit_files GROUP BY sha HAVING count(DISTINCT file) BETWEEN 2 AND 40))
SELECT a.file AS source, b.file AS target, count(*) AS co_changes FROM f a JOIN f b ON a.sha = b.sha AND a.file < b.file AND a.domain <> b.domain GROUP BY ALL ORDER BY co_changes DESC, source, target LIMIT 20""")
def change_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coupling(bind.commit_files(spark, sf_dir))


@query(f"WITH {bind.COMMIT_FILES_SQL} SELECT file, domain, count(*) AS touches, sum(additions)::BIGINT AS additions FROM commit_files GROUP BY ALL ORDER BY touches DESC, additions DESC, file LIMIT 20")
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.hot_files(bind.commit_files(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = bind.table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.filter(early), orders.filter(~early)


@query(f"""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE {_BEFORE}), b AS (SELECT DISTINCT o_custkey FROM orders WHERE NOT {_BEFORE})
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def drift_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.set_changes(*_snapshots(spark, sf_dir), "o_custkey")


_PRINT = "SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS role FROM orders WHERE {} GROUP BY o_custkey"


@query(f"""WITH a AS ({_PRINT.format(_BEFORE)}), b AS ({_PRINT.format("NOT " + _BEFORE)})
SELECT o_custkey, a.n AS before_n, a.role AS before_role, b.n AS after_n, b.role AS after_role FROM a JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n OR a.role IS DISTINCT FROM b.role""")
def drift_changed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("role")) for df in _snapshots(spark, sf_dir))
    return history.changed_payload(a, b, "o_custkey")


@query(f"""WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE {_BEFORE} GROUP BY ALL), b AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT {_BEFORE} GROUP BY ALL)
SELECT o_orderpriority, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (o_orderpriority)""")
def compare_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")) for df in _snapshots(spark, sf_dir))
    return history.deltas(a, b, "o_orderpriority", "n")


_OWNER = "SELECT o_custkey AS area, min(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS owner FROM orders WHERE {} GROUP BY o_custkey"


@query(f"""WITH a AS ({_OWNER.format(_BEFORE)}), b AS ({_OWNER.format("NOT " + _BEFORE)}), j AS (SELECT coalesce(a.area, b.area) AS area, a.owner AS was, b.owner AS now,
CASE WHEN a.area IS NULL AND b.owner IS NULL THEN 'orphaned' WHEN a.area IS NULL THEN 'added' WHEN b.area IS NULL THEN 'removed' WHEN a.owner IS DISTINCT FROM b.owner THEN 'owner_changed' END AS change FROM a FULL JOIN b ON a.area = b.area)
SELECT area, was, now, change FROM j WHERE change IS NOT NULL""")
def ownership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.min(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    a, b = (df.groupBy(F.col("o_custkey").alias("area")).agg(owner.alias("owner")) for df in _snapshots(spark, sf_dir))
    return history.ownership_changes(a, b)


@query(f"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_BEFORE}), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE NOT {_BEFORE}),
c AS (SELECT count(*) FILTER (a.k IS NULL) AS domains_added, count(*) FILTER (b.k IS NULL) AS domains_removed, (coalesce(a.k, b.k) % 50)::BIGINT AS repo_id FROM a FULL JOIN b ON a.k = b.k GROUP BY ALL),
s AS (SELECT *, least(100, domains_added * 10 + domains_removed * 14)::BIGINT AS drift_score FROM c) SELECT *, {exprs.level_sql("drift_score", rules.DRIFT_LEVELS, "stable")} AS drift_level FROM s""")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = history.set_changes(*_snapshots(spark, sf_dir), "o_custkey")
    counts = changes.groupBy((F.col("o_custkey") % 50).alias("repo_id")).agg(F.count_if(F.col("change") == "added").alias("domains_added"), F.count_if(F.col("change") == "removed").alias("domains_removed"))
    return history.drift_score(counts)


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = bind.paths(spark, sf_dir)
    changed = paths.select((F.col("file_id") % 40).alias("pr"), "path", "file_id")
    hot = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file_id")).agg(F.count(F.lit(1)).alias("risk_score")).filter("risk_score >= 28")
    hot = hot.join(paths.select("file_id", "path"), "file_id").select("path", "risk_score")
    return history.review_risk(changed.drop("file_id"), hot, paths.filter("size >= 45").select("path"))


_REVIEW_SQL = f"""{bind.PATHS_SQL}, h AS (SELECT l_partkey AS file_id, count(*) AS risk_score FROM lineitem GROUP BY ALL HAVING count(*) >= 28),
l AS (SELECT file_id % 40 AS pr, path, size, risk_score, {exprs.case_contains_sql("path", rules.REVIEW_LAYERS, "application")} AS layer, {exprs.by_value_sql("lower(regexp_extract(path, '([.][^./]+)$', 1))", rules.LANGUAGES, "Text")} AS language FROM paths LEFT JOIN h USING (file_id)),
v AS (SELECT pr, path, layer, language, greatest(0, least(30, coalesce(risk_score, 0)) + CASE WHEN size >= 45 THEN 25 ELSE 0 END + CASE WHEN layer IN ('interface', 'data', 'security') THEN 16 ELSE 0 END
+ CASE WHEN language IN ('Dockerfile', 'YAML', 'JSON') THEN 12 ELSE 0 END - CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 10 ELSE 0 END)::BIGINT AS risk FROM l)"""


@query(f"WITH {_REVIEW_SQL} SELECT * FROM v")
def pr_file_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir)


_TWO = "CASE WHEN len(string_split(path, '/')) > 2 AND string_split(path, '/')[1] IN ('src', 'app', 'backend', 'frontend') THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"


@query(f"WITH {_REVIEW_SQL}, s AS (SELECT pr, least(100, 15 + sum(risk) + count(DISTINCT {_TWO}) * 8)::BIGINT AS risk_score FROM v GROUP BY pr) SELECT *, {exprs.level_sql('risk_score', rules.REVIEW_LEVELS, 'low')} AS risk_level FROM s")
def pr_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.review_score(_reviews(spark, sf_dir))


@query(f"""WITH {bind.PATHS_SQL}, d AS (SELECT DISTINCT {_TWO} AS name FROM paths WHERE file_id % 7 = 0), c AS (SELECT path FROM paths WHERE size < 10)
SELECT name, count(DISTINCT path) AS changed_files FROM d JOIN c ON contains('/' || path || '/', '/' || name || '/') GROUP BY name""")
def impacted_domains_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = bind.paths(spark, sf_dir)
    domains = paths.filter("file_id % 7 = 0").select(exprs.domain(F.col("path")).alias("name")).distinct()
    return history.impacted_domains(domains, paths.filter("size < 10"))


@query("""SELECT n_name AS repo, count(DISTINCT c_custkey) AS files, count(o_orderkey) AS commits, count(DISTINCT o_orderpriority) AS kinds FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def portfolio_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: bind.table(spark, sf_dir, n)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    all_rows = t("nation").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return all_rows.groupBy(F.col("n_name").alias("repo")).agg(F.countDistinct("c_custkey").alias("files"), F.count("o_orderkey").alias("commits"), F.countDistinct("o_orderpriority").alias("kinds"))


@query(f"""WITH {bind.FINDINGS_SQL} SELECT rule_id, count(DISTINCT repo_id) AS repos, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INT AS worst
FROM findings GROUP BY rule_id HAVING count(DISTINCT repo_id) > 1""")
def shared_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = exprs.by_value(F.col("severity"), rules.RANK, 1)
    return bind.findings(spark, sf_dir).groupBy("rule_id").agg(F.countDistinct("repo_id").alias("repos"), F.max(rank).alias("worst")).filter("repos > 1")


@query(f"""WITH c AS (SELECT p_brand AS repo_id, p_type AS framework, count(*) AS n FROM part GROUP BY ALL)
SELECT repo_id, framework, n, {exprs.dec_round_sql("n / sum(n) OVER (PARTITION BY repo_id)", 6)} AS share FROM c""")
def concentration_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bind.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("framework")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", exprs.dec_round(F.col("n") / F.sum("n").over(Window.partitionBy("repo_id")), 6))


@query(f"""WITH {bind.PATHS_SQL} SELECT {exprs.case_contains_sql("path", rules.OWNERS, "Core Engineering")} AS owner, count(*) AS files, count(DISTINCT repo_id) AS repos, sum(size)::BIGINT AS bytes, count(*) FILTER (size >= 45) AS critical FROM paths GROUP BY ALL""")
def team_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = exprs.case_contains(F.col("path"), rules.OWNERS, "Core Engineering")
    rows = bind.paths(spark, sf_dir).withColumn("owner", owner)
    return rows.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("repo_id").alias("repos"), F.sum("size").alias("bytes"), F.count_if(F.col("size") >= 45).alias("critical"))


@query(f"""WITH {bind.FINDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, finding_id) AS r, count(*) OVER (PARTITION BY rule_id) AS n FROM findings)
SELECT rule_id, n AS findings, string_agg(finding_id::VARCHAR, ',' ORDER BY r) AS evidence FROM r WHERE r <= 6 GROUP BY rule_id, n ORDER BY n DESC, rule_id LIMIT 12""")
def remediation_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.findings(spark, sf_dir).select("rule_id", "finding_id", "ts")
    head = history.ranked_within(rows, "rule_id", "ts", "finding_id", most=6)
    evidence = head.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "finding_id"))), lambda x: x["finding_id"].cast("string")), ",").alias("evidence"))
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).join(evidence, "rule_id").orderBy(F.desc("findings"), "rule_id").limit(12)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH b AS (SELECT event_type, user_id % 10 AS batch, count(*) AS attempted, count(*) FILTER (value >= 50) AS passed FROM events GROUP BY ALL)
SELECT event_type, sum(attempted)::BIGINT AS attempted, sum(passed)::BIGINT AS passed, {exprs.dec_round_sql("sum(passed) / sum(attempted)", 6)} AS pass_rate FROM b GROUP BY event_type""")
def batch_merge_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = bind.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("batch")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("value") >= 50).alias("passed"))
    merged = batches.groupBy("event_type").agg(F.sum("attempted").alias("attempted"), F.sum("passed").alias("passed"))
    return merged.withColumn("pass_rate", exprs.dec_round(F.col("passed") / F.col("attempted"), 6))


@query(f"""WITH d AS (SELECT ts::DATE AS batch, event_type AS stage, sum(value::DECIMAL(38,6)) AS s FROM events GROUP BY ALL)
SELECT batch, stage, {exprs.dec_round_sql("s::DOUBLE", 4)} AS seconds, {exprs.dec_round_sql("s::DOUBLE / (sum(s) OVER (PARTITION BY batch))::DOUBLE", 6)} AS share,
{exprs.dec_round_sql("s::DOUBLE - (lag(s) OVER (PARTITION BY stage ORDER BY batch))::DOUBLE", 4)} AS delta FROM d""")
def bottleneck_share_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bind.table(spark, sf_dir, "events").select(F.to_date("ts").alias("batch"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(28,6)").alias("v"))
    daily = events.groupBy("batch", "stage").agg(F.sum("v").alias("s"))
    s, total, last = F.col("s").cast("double"), F.sum("s").over(Window.partitionBy("batch")).cast("double"), F.lag("s").over(Window.partitionBy("stage").orderBy("batch")).cast("double")
    return daily.select("batch", "stage", exprs.dec_round(s, 4).alias("seconds"), exprs.dec_round(s / total, 6).alias("share"), exprs.dec_round(s - last, 4).alias("delta"))


@query(f"""WITH j AS (SELECT source, n_chars::DOUBLE AS a, quality * 100.0::DOUBLE AS b, toxic * 100.0::DOUBLE AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, {exprs.dec_round_sql("(sum(coalesce(a, 0)::DECIMAL(38,4))::DOUBLE * 0.2 + sum(coalesce(b, 0)::DECIMAL(38,4))::DOUBLE * 0.5 + sum(coalesce(c, 0)::DECIMAL(38,4))::DOUBLE * 0.3) / (count(a) * 0.2::DOUBLE + count(b) * 0.5::DOUBLE + count(c) * 0.3::DOUBLE)", 4)} AS weighted FROM j GROUP BY source""")
def weighted_mean_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(bind.table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = {"a": (F.col("n_chars"), 0.2), "b": (F.col("quality") * 100, 0.5), "c": (F.col("toxic") * 100, 0.3)}
    rows = rows.select("source", *(v.alias(n) for n, (v, _) in parts.items()))
    sums = sum((F.coalesce(F.sum(n), F.lit(0)).cast("double") * w for n, (_, w) in parts.items()), F.lit(0.0))
    weights = sum((F.count(n) * F.lit(w) for n, (_, w) in parts.items()), F.lit(0.0))
    return rows.groupBy("source").agg(exprs.dec_round(sums / weights, 4).alias("weighted"))


_DIMENSIONS = {"click": "architecture", "view": "security", "purchase": "ownership", "error": "debt", "signup": "production"}
_DIM_SQL = f"""pt AS (SELECT repo_id, day FROM (SELECT DISTINCT user_id % 12 AS repo_id FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS day)),
""" + ",\n".join(f"s_{d} AS (SELECT user_id % 12 AS repo_id, ts, max(value) AS {d} FROM events WHERE event_type = '{t}' AND value IS NOT NULL GROUP BY ALL)" for t, d in _DIMENSIONS.items())


@query(f"WITH {_DIM_SQL} SELECT pt.repo_id, epoch_us(day) AS day, {', '.join(_DIMENSIONS.values())} FROM pt " + " ".join(f"ASOF LEFT JOIN s_{d} ON s_{d}.repo_id = pt.repo_id AND s_{d}.ts <= pt.day" for d in _DIMENSIONS.values()))
def dimension_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dimensions of each repository as they stood at the begin of every day."""
    value = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    events = bind.table(spark, sf_dir, "events").withColumns({"repo_id": F.col("user_id") % 12, "at": F.col("ts").cast("timestamp")})
    snapshots = events.select("repo_id", "at", *(value(t).alias(d) for t, d in _DIMENSIONS.items()))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-02").cast("timestamp"), F.expr("INTERVAL 1 DAY")))
    points = events.select("repo_id").distinct().withColumn("at", days)
    return history.as_of(points, snapshots, list(_DIMENSIONS.values()), width="week").select("repo_id", F.unix_micros("at").alias("day"), *_DIMENSIONS.values())


@query("""WITH a AS (SELECT 'c' || c_custkey AS id, c_name AS label, c_nationkey AS home, 1 AS seen, false AS gone FROM customer UNION ALL SELECT 'c' || c_custkey, upper(c_name), c_nationkey, 3, false FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 's' || s_suppkey, s_name, s_nationkey, 2, false FROM supplier UNION ALL SELECT 'c' || c_custkey, 'late', NULL, 0, false FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'c' || c_custkey, NULL, NULL, 4, true FROM customer WHERE c_custkey % 7 = 0)
SELECT id, label, home, seen FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen DESC) = 1) WHERE NOT gone""")
def graph_node_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after five merges, late and repeated ones and removals among them."""
    c, s = bind.table(spark, sf_dir, "customer"), bind.table(spark, sf_dir, "supplier")
    node = lambda df, kind, key, label, home, at, gone=False: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), label.alias("label"), home.cast("int").alias("home"), F.lit(at).alias("seen"), F.lit(gone).alias("gone"))
    null = F.lit(None)
    batches = [
        node(c, "c", "c_custkey", F.col("c_name"), F.col("c_nationkey"), 1), node(c.filter("c_custkey % 3 = 0"), "c", "c_custkey", F.upper("c_name"), F.col("c_nationkey"), 3),
        node(s, "s", "s_suppkey", F.col("s_name"), F.col("s_nationkey"), 2), node(c.filter("c_custkey % 5 = 0"), "c", "c_custkey", F.lit("late"), null, 0), node(c.filter("c_custkey % 7 = 0"), "c", "c_custkey", null.cast("string"), null, 4, True),
    ]
    table = merge.created(spark, ["id"], "seen", buckets=16)
    for batch in [*batches, batches[0]]:
        table = merge.merged(table, batch)
    return table.rows().select("id", "label", "home", "seen")

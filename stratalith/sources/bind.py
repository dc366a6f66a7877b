"""The driver's star schema read as repository entities: files, commits, edges, findings, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("backend/api", "frontend/pages", "src/db", "tests/unit", "docs", ".github/workflows", "app/security", "lib")
ENDINGS = (".py", ".ts", ".md", ".yml", ".go", ".json")
SEVERITIES = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "low"}
RULE_IDS = {"error": "python-eval", "purchase": "hardcoded-secret", "signup": "sql-format", "click": "dependency-audit", "view": "b101"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, size, sha256, language, text from documents."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), path.alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("language"), "text", "doc_id")


FILES_SQL = "files AS (SELECT source AS repo_id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, n_chars AS size, sha256(text) AS sha256, lang AS language, text, doc_id FROM documents)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, size of source files, named after parts."""
    pick = lambda values, col: F.element_at(F.array(*map(F.lit, values)), (col % len(values) + 1).cast("int"))
    path = F.concat(pick(FOLDERS, F.col("p_partkey")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), pick(ENDINGS, F.col("p_size")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id"), path.alias("path"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("file_id"))


def _pick_sql(values, col: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({col} % {len(values)})::INT + 1]"


PATHS_SQL = f"paths AS (SELECT p_brand AS repo_id, {_pick_sql(FOLDERS, 'p_partkey')} || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || {_pick_sql(ENDINGS, 'p_size')} AS path, p_size::BIGINT AS size, p_partkey AS file_id FROM part)"


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, file, domain, additions, deletions: a row for each file that a commit touches."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("domain"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").cast("long").alias("additions"), F.sum("l_linenumber").cast("long").alias("deletions"))
    return lines.join(part, "file")


COMMIT_FILES_SQL = "commit_files AS (SELECT l_orderkey AS sha, l_partkey AS file, p_brand AS domain, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.to_date("o_orderdate").alias("date"))


COMMITS_SQL = "commits AS (SELECT o_orderkey AS sha, o_orderdate::DATE AS date FROM orders)"


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: every line item is an edge of the multigraph."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))


DEPENDENCIES_SQL = "dependencies AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation: a root holds regions, these hold nations, these hold suppliers and customers."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, supplier, customer, region = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "region"))
    return (
        nation.select(text("r", "n_regionkey").alias("source"), text("n", "n_nationkey").alias("target"), F.lit("DEPENDS_ON").alias("relation"))
        .unionByName(supplier.select(text("n", "s_nationkey").alias("source"), text("s", "s_suppkey").alias("target"), F.lit("USES").alias("relation")))
        .unionByName(customer.select(text("n", "c_nationkey").alias("source"), text("c", "c_custkey").alias("target"), F.lit("OWNS").alias("relation")))
        .unionByName(region.select(F.lit("root").alias("source"), text("r", "r_regionkey").alias("target"), F.lit("CONTAINS").alias("relation")))
    )


HIERARCHY_SQL = (
    "hierarchy AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'DEPENDS_ON' AS relation FROM nation"
    " UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'USES' FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'OWNS' FROM customer UNION ALL SELECT 'root', 'r' || r_regionkey, 'CONTAINS' FROM region)"
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finding_id, repo_id, severity, rule_id, path, ts, value from events."""
    of = lambda t: F.element_at(F.create_map(*(F.lit(x) for pair in t.items() for x in pair)), F.col("event_type"))
    path = F.concat(F.lit("mod"), (F.get_json_object("props", "$.k").cast("int") % 40).cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), F.col("user_id").alias("repo_id"), of(SEVERITIES).alias("severity"), of(RULE_IDS).alias("rule_id"), path.alias("path"), "ts", "value")


def _case_sql(t: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"


FINDINGS_SQL = f"findings AS (SELECT event_id AS finding_id, user_id AS repo_id, {_case_sql(SEVERITIES)} AS severity, {_case_sql(RULE_IDS)} AS rule_id, 'mod' || (json_extract_string(props, '$.k')::INT % 40) || '.py' AS path, ts, value FROM events)"


def as_requests(events: DataFrame) -> DataFrame:
    """request_id, ts (timestamp), client, path, duration_ms, failed from events, be they a table or a stream."""
    return events.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), F.col("event_type").alias("path"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("failed"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))

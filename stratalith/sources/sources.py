"""Source files made from the part table, a repository for each brand: known texts, so known symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.sources.shared import dealt, stored, written

#: language -> (path, text, symbols); {k} is the part's key and {s} its size. A symbol is (kind, name, owner, line, method, handler, orm).
TEMPLATES = {
    "Python": (
        "src/api/mod{k}.py", "import os\nfrom shared.base import helper\n\nclass Part{k}(Base):\n    def load{s}(self):\n        # TODO: check part {k}\n        return os.getenv('PART_{k}_KEY')\n\n@app.get('/parts/{k}')\nasync def part{k}():\n    return 1\n",
        [("import", "os"), ("import", "shared.base"), ("class", "Part{k}", None, 4), ("model", "Part{k}", None, 4, None, None, "SQLAlchemy/Python ORM"), ("method", "load{s}", "Part{k}", 5), ("function", "part{k}", None, 10), ("route", "/parts/{k}", None, 10, "GET", "part{k}")],
    ),
    "JavaScript": (
        "frontend/pages/part{k}.js", "import base from 'shared.base';\nexport class Part{k}Model {}\nexport async function load{s}() { return process.env.PART_{k}_URL; }\napp.post('/parts/{k}', load{s});\n",
        [("import", "shared.base"), ("export", "Part{k}Model"), ("export", "load{s}"), ("class", "Part{k}Model", None, 2), ("model", "Part{k}Model", None, 2, None, None, "JS/TS ORM"), ("function", "load{s}", None, 3), ("route", "/parts/{k}", None, 4, "POST", "app.post")],
    ),
    "Java": (
        "backend/db/Part{k}.java", 'import shared.base;\n@Entity\npublic class Part{k} {\n  @GetMapping("/parts/{k}")\n  public String load{s}() { return "x"; }\n}\n',
        [("import", "shared.base"), ("class", "Part{k}", None, 3), ("model", "Part{k}", None, 3, None, None, "JPA/Hibernate"), ("function", "load{s}", None, 5), ("route", "/parts/{k}", None, 4, "GET", "load{s}")],
    ),
    "Go": (
        "server/part{k}.go", 'package main\nimport "shared.base"\ntype Part{k} struct { ID string `db:"id"` }\nfunc load{s}() { r.GET("/parts/{k}", f) }\nfunc (p *Part{k}) Save() {}\n',
        [("import", "shared.base"), ("class", "Part{k}", None, 3), ("model", "Part{k}", None, 3, None, None, "Go struct tags"), ("function", "load{s}", None, 4), ("method", "Save", "Part{k}", 5), ("route", "/parts/{k}", None, 4, "GET", "")],
    ),
    "Rust": (
        "core/part{k}.rs", 'use shared::base;\n#[get("/parts/{k}")]\nasync fn load{s}() -> R { ok() }\n#[derive(sqlx::FromRow)]\nstruct Part{k} { id: i64 }\n',
        [("import", "shared::base"), ("route", "/parts/{k}", None, 2, "GET", "load{s}"), ("function", "load{s}", None, 3), ("class", "Part{k}", None, 5), ("model", "Part{k}", None, 5, None, None, "Diesel/SQLx")],
    ),
    "C#": (
        "Controllers/Part{k}.cs", 'using Shared.Base;\npublic class Part{k} {\n  [HttpGet("/parts/{k}")]\n  public Task Load{s}() => Ok();\n}\n',
        [("import", "Shared.Base"), ("class", "Part{k}", None, 2), ("function", "Load{s}", None, 4), ("route", "/parts/{k}", None, 3, "GET", "Load{s}")],
    ),
    "Kotlin": (
        "app/auth/Part{k}.kt", 'import shared.base\nclass Part{k}\nfun load{s}() { get("/parts/{k}") }\nfun last{s}() {}\n',
        [("import", "shared.base"), ("class", "Part{k}", None, 2), ("function", "load{s}", None, 3), ("function", "last{s}", None, 4), ("route", "/parts/{k}", None, 3, "GET", "last{s}")],
    ),
    "PHP": (
        "web/part{k}.php", "<?php\nuse Shared\\Base;\nclass Part{k} extends Model {}\nRoute::get('/parts/{k}', 'x');\nfunction load{s}() {}\n",
        [("import", "Shared\\Base"), ("class", "Part{k}", None, 3), ("model", "Part{k}", None, 3, None, None, "Eloquent/Doctrine/PHP"), ("function", "load{s}", None, 5), ("route", "/parts/{k}", None, 4, "GET", "load{s}")],
    ),
}
#: Files of a repository whose number (the brand's) meets the condition: (path, language, text, condition).
COMMON = [
    ("shared/base.py", "Python", "def helper():\n    return 1\n", "n >= 0"), ("requirements.txt", "Text", "fastapi==1\nFlask\n", "n % 2 = 0"), ("Dockerfile", "Dockerfile", "FROM x\n", "n % 3 = 0"),
    (".github/workflows/ci.yml", "YAML", "on: push\n", "n % 5 <> 0"), ("README.md", "Markdown", "# shop\n", "n % 2 = 1"), ("tests/test_all.py", "Python", "def test_all():\n    assert True\n", "n % 4 < 2"),
    ("package.json", "JSON", '{"name": "shop", "dependencies": {"react": "1", "next": "2"}}', "n % 3 = 1"), ("big.sql", "SQL", "SELECT 1;\n", "n % 7 = 0"),
]
_FILE_SYMBOLS = {"shared/base.py": ("helper", 1), "tests/test_all.py": ("test_all", 1)}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, language, size, text."""
    return stored(spark, "files", sf_dir, lambda: written(_files(spark, sf_dir)))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one pass over the parts, which are dealt first: few bytes of them make many texts, of all languages in each task."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", "p_size")
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    of = lambda cell: F.coalesce(*(F.when(F.col("p_partkey") % len(TEMPLATES) == i, cell(language, *row)) for i, (language, row) in enumerate(TEMPLATES.items())))
    made = dealt(part, "p_partkey").filter((F.col("p_partkey") % len(TEMPLATES)).between(0, len(TEMPLATES) - 1))
    parts = [made.select(F.col("p_brand").alias("repo_id"), of(lambda _, path, *__: fill(path)).alias("path"), of(lambda language, *_: F.lit(language)).alias("language"), of(lambda _, __, text, *___: fill(text)).alias("text"))]
    brands = part.select(F.col("p_brand").alias("repo_id"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("n")).distinct()
    for path, language, text, condition in COMMON:
        parts.append(brands.filter(condition).select("repo_id", F.lit(path).alias("path"), F.lit(language).alias("language"), F.lit(text).alias("text")))
    return reduce(DataFrame.unionByName, parts).withColumn("size", F.when(F.col("path") == "big.sql", F.lit(200_000)).otherwise(F.length("text")).cast("long"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, rule_id, severity, line, message: some of the Java and Go files have one, two of the common files too."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", "p_size")
    name = lambda t: F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string"))
    path = F.when(F.col("p_partkey") % 8 == 2, name(TEMPLATES["Java"][0])).when(F.col("p_partkey") % 8 == 3, name(TEMPLATES["Go"][0]))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % len(values) + 1).cast("int"))
    rows = part.filter("p_partkey % 8 IN (2, 3) AND p_size % 3 = 0")
    return rows.select(F.col("p_brand").alias("repo_id"), path.alias("path"), pick(RULES).alias("rule_id"), pick(SEVERITIES).alias("severity"), (F.col("p_size") % 40 + 1).cast("int").alias("line"), F.lit("found").alias("message"))


RULES = ("hardcoded-secret", "python-eval", "sql-format", "dependency-audit", "b101", "shell-true", "js-inner-html")
SEVERITIES = ("low", "medium", "high", "low", "medium", "critical", "low", "medium")


def _q(text) -> str:
    return "NULL" if text is None else str(text) if isinstance(text, int) else "'" + text.replace("'", "''") + "'"


def _fill(text: str) -> str:
    return f"replace(replace({_q(text)}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"


_BRANDS = "brands AS (SELECT DISTINCT p_brand AS repo_id, regexp_extract(p_brand, '[0-9]+')::INT AS n FROM part)"
FILES_SQL = (
    f"{_BRANDS}, src AS (SELECT *, CASE path WHEN 'big.sql' THEN 200000 ELSE length(text) END::BIGINT AS size FROM ("
    + " UNION ALL ".join(f"SELECT p_brand AS repo_id, {_fill(path)} AS path, '{language}' AS language, {_fill(text)} AS text FROM part WHERE p_partkey % {len(TEMPLATES)} = {i}" for i, (language, (path, text, _)) in enumerate(TEMPLATES.items()))
    + "".join(f" UNION ALL SELECT repo_id, {_q(path)}, {_q(language)}, {_q(text)} FROM brands WHERE {condition}" for path, language, text, condition in COMMON)
    + "))"
)
_SHAPE = ("kind", "name", "owner", "line", "method", "handler", "orm")


def _symbol_sql(i: int, path: str, symbol: tuple) -> str:
    row = dict(zip(_SHAPE, (*symbol, *[None] * (len(_SHAPE) - len(symbol))), strict=True))
    cells = ", ".join(f"{_q(v)}::{'INT' if c == 'line' else 'VARCHAR'} AS {c}" if v is None or c in ("line", "kind") else f"{_fill(v)} AS {c}" for c, v in row.items())
    return f"SELECT p_brand AS repo_id, {_fill(path)} AS path, {cells} FROM part WHERE p_partkey % {len(TEMPLATES)} = {i}"


#: The symbols that the texts were made with; not parsed, so it tests the parsers.
SYMBOLS_SQL = (
    "sym AS ("
    + " UNION ALL ".join(_symbol_sql(i, path, s) for i, (path, _, known) in enumerate(TEMPLATES.values()) for s in known)
    + "".join(f" UNION ALL SELECT repo_id, '{path}', 'function', '{name}', NULL, {line}, NULL, NULL, NULL FROM brands WHERE {condition}" for path, _, _, condition in COMMON for p, (name, line) in _FILE_SYMBOLS.items() if p == path)
    + ")"
)
_PATHS = f"CASE p_partkey % 8 WHEN 2 THEN {_fill(TEMPLATES['Java'][0])} ELSE {_fill(TEMPLATES['Go'][0])} END"
_list = lambda values: "[" + ", ".join(map(_q, values)) + f"][(p_size % {len(values)})::INT + 1]"
FOUND_SQL = f"found AS (SELECT p_brand AS repo_id, {_PATHS} AS path, {_list(RULES)} AS rule_id, {_list(SEVERITIES)} AS severity, (p_size % 40 + 1)::INT AS line, 'found' AS message FROM part WHERE p_partkey % 8 IN (2, 3) AND p_size % 3 = 0)"
ALL_SQL = f"{FILES_SQL}, {SYMBOLS_SQL}, {FOUND_SQL}"

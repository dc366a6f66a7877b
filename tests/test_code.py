"""Symbols of small sources in every language, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from stratalith.operators import code, knowledge

SOURCES = {
    ("main.py", "Python"): (
        "import os\nfrom pkg.core import helper\n\nclass Service(Base):\n    def run(self):\n        return os.getenv('API_KEY')\n\n@app.get('/items')\nasync def items():\n    return [x for x in y if x and z]\n",
        {("import", "os", None), ("import", "pkg.core", None), ("class", "Service", 4), ("model", "Service", 4), ("method", "run", 5), ("function", "items", 9), ("route", "/items", 9)},
    ),
    ("broken.py", "Python"): ("import os\nclass A:\n  def f(self:\n", {("import", "os", None), ("class", "A", 2), ("function", "f", 3)}),
    ("UserController.java", "Java"): (
        'import org.web.GetMapping;\n@RestController\nclass UserController {\n  @GetMapping("/users")\n  public String listUsers() { return "ok"; }\n}\n@Entity\nclass Row {}\n',
        {("import", "org.web.GetMapping", None), ("class", "UserController", 3), ("class", "Row", 8), ("function", "listUsers", 5), ("route", "/users", 4), ("model", "Row", 8)},
    ),
    ("server.go", "Go"): (
        'package main\nimport "github.com/x/gin"\nimport (\n  "fmt"\n)\ntype User struct { ID string `db:"id"` }\nfunc main() { r.GET("/health", f) }\nfunc (s *Server) Run() {}\n',
        {("import", "github.com/x/gin", None), ("import", "fmt", None), ("class", "User", 6), ("model", "User", 6), ("function", "main", 7), ("route", "/health", 7), ("method", "Run", 8)},
    ),
    ("routes.rs", "Rust"): (
        'use web::{get, Response};\n#[get("/health")]\nasync fn health() -> Response { ok() }\n#[derive(sqlx::FromRow)]\nstruct User { id: String }\n',
        {("import", "web::{get, Response}", None), ("route", "/health", 2), ("function", "health", 3), ("class", "User", 5), ("model", "User", 5)},
    ),
    ("Users.cs", "C#"): (
        'using Web.Mvc;\npublic class Users {\n  [HttpGet("/users")]\n  public async Task<Result> ListUsers() => Ok();\n}\npublic class AppDbContext : DbContext { public DbSet<Row> Rows { get; set; } }\npublic class Row { }\n',
        {("import", "Web.Mvc", None), ("class", "Users", 2), ("class", "AppDbContext", 6), ("class", "Row", 7), ("function", "ListUsers", 4), ("route", "/users", 3), ("model", "AppDbContext", 6), ("model", "Users", 2), ("model", "Row", 7)},
    ),
    ("Routes.kt", "Kotlin"): ('import io.ktor.get\nclass UserEntity\nfun Application.routes() { routing { get("/health") { } } }\nfun later() {}\n', {("import", "io.ktor.get", None), ("class", "UserEntity", 2), ("function", "routes", 3), ("function", "later", 4), ("route", "/health", 3)}),
    ("web.php", "PHP"): ("<?php\nuse Support\\Route;\nclass User extends Model {}\nRoute::get('/users', [X::class, 'i']);\nfunction helper() {}\n", {("import", "Support\\Route", None), ("class", "User", 3), ("model", "User", 3), ("function", "helper", 5), ("route", "/users", 4)}),
    ("app/shop/route.tsx", "TypeScript"): (
        "import express from 'express';\nexport class UserModel {}\nexport async function GET() { return 1; }\nconst tidy = (a) => a;\napp.get('/health', () => null);\n",
        {("import", "express", None), ("export", "UserModel", None), ("export", "GET", None), ("class", "UserModel", 2), ("model", "UserModel", 2), ("function", "GET", 3), ("route", "/shop", 3), ("function", "tidy", 4), ("route", "/health", 5)},
    ),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, lang, text) for (p, lang), (text, _) in SOURCES.items()]
    rows += [("r", "empty.java", "Java", ""), ("r", "null.go", "Go", None), ("r", "x.txt", "Text", "TODO: write\nfixme later"), ("r", "p.json", "JSON", '{"name": "shop", "dependencies": {"b": 1, "a": 2}, "scripts": {"t": "x"}}'), ("r", "bad.json", "JSON", "{")]
    return spark.createDataFrame(rows, "repo_id string, path string, language string, text string")


def test_symbols(files):
    got = {}
    for r in code.symbols(files).collect():
        got.setdefault(r["path"], set()).add((r["kind"], r["name"], r["line"]))
    assert got == {path: want for (path, _), (_, want) in SOURCES.items()}


def test_details(files):
    rows = {(r["path"], r["kind"], r["name"]): r for r in code.symbols(files).collect()}
    handlers = {(p.split(".")[-1], r["method"], r["handler"]) for (p, kind, _), r in rows.items() if kind == "route"}
    assert handlers == {("py", "GET", "items"), ("java", "GET", "listUsers"), ("go", "GET", ""), ("rs", "GET", "health"), ("cs", "GET", "ListUsers"), ("kt", "GET", "later"), ("php", "GET", "helper"), ("tsx", "GET", "GET"), ("tsx", "GET", "app.get")}
    assert rows["main.py", "method", "run"]["owner"] == "Service" and rows["server.go", "method", "Run"]["owner"] == "Server"
    assert rows["main.py", "function", "items"]["is_async"] and rows["Users.cs", "function", "ListUsers"]["is_async"] in (True, False)


def test_variables_notes_and_manifests(files):
    assert {(r["path"], r["name"]) for r in code.env_variables(files).collect()} == {("main.py", "API_KEY")}
    assert {(r["path"], r["tag"], r["text"], r["line"]) for r in code.notes(files).collect()} == {("x.txt", "TODO", "write", 1), ("x.txt", "FIXME", "later", 2)}
    got = {r["path"]: (r["name"], r["dependencies"], r["dev_dependencies"], r["scripts"]) for r in code.manifest_keys(files).collect()}
    assert got == {"p.json": ("shop", ["a", "b"], [], ["t"]), "bad.json": (None, [], [], [])}


def test_python_metrics(files):
    rows = {r["path"]: r for r in code.python_metrics(files).collect()}
    assert set(rows) == {"main.py"}
    assert {(b["name"], b["complexity"]) for b in rows["main.py"]["blocks"]} == {("run", 1), ("items", 4)}
    assert 50 < rows["main.py"]["maintainability"] <= 100


def test_empty_table(spark, files):
    assert code.symbols(files.limit(0)).count() == 0 and code.notes(files.limit(0)).count() == 0


#: Other texts of each language: comments, modifiers in any order, generics, blocks of imports, names that only look like routes.
MORE = {
    "Java": (
        '/* class Hidden {} */\nimport static a.B.c;\n// import x.Y;\n@Table\nprivate static final class Row<T> {\n  String url = "http://x"; // class No\n  protected synchronized <T> List<T> all(int a) { return get(a); }\n  @RequestMapping(value = "/a(b)", method = GET) public void one() {}\n}\ninterface Api {}\n',
        {("import", "a.B.c"), ("class", "Row"), ("class", "Api"), ("function", "all"), ("function", "one"), ("route", "/a(b)"), ("model", "Row")},
    ),
    "C#": (
        'global using A.B;\n/* using C; */\npublic sealed partial class Users {\n  [Route("/u")]\n  internal static async Task<List<int>> Get(int x) => await Load(x);\n  protected override int[] Load(int y) { if (y > 1) return new int[1]; return Other(y); }\n}\n',
        {("import", "A.B"), ("class", "Users"), ("function", "Get"), ("function", "Load"), ("route", "/u")},
    ),
    "Go": (
        'package a\nimport (\n\t"fmt"\n\tx "net/http"\n)\n// func hidden() {}\ntype Set[T any] struct { A int `json:"id"` }\ntype Do interface { Run() }\nfunc Map[K any](x K) {}\nfunc (s Set) Len() int { return 1 }\nr.HandleFunc("/h", f)\n',
        {("import", "fmt"), ("import", "net/http"), ("class", "Set"), ("class", "Do"), ("function", "Map"), ("method", "Len"), ("route", "/h"), ("model", "Set")},
    ),
    "Rust": (
        'pub use a::b;\n/* fn hidden() {} */\npub(crate) enum Kind { A }\n    pub const unsafe fn one() {}\ntrait T { fn two(&self); }\n#[post("/p")]\npub async fn three() {}\n',
        {("import", "a::b"), ("class", "Kind"), ("class", "T"), ("function", "one"), ("function", "three"), ("route", "/p")},
    ),
    "Kotlin": (
        'import a.b.*\n// class No\nenum class Color { RED }\ninternal data class P(val a: Int)\nprivate inline fun <T> List<T>.pick(a: T) {}\noverride suspend fun load() {}\n@GetMapping("/k") fun k() {}\nwidget("/no")\n',
        {("import", "a.b.*"), ("class", "Color"), ("class", "P"), ("function", "pick"), ("function", "load"), ("route", "/k")},
    ),
    "PHP": (
        '<?php\nuse A\\\\B;\n/* function no() {} */\nfinal readonly class C {}\ntrait D {}\nabstract class E {\n  final public static function run() {}\n  protected function &ref() {}\n}\n$app->post("/x", f);\n#[Route("/attr")]\nfunction g() {}\n'.replace("\\\\", "\\"),
        {("import", "A\\B"), ("class", "C"), ("class", "D"), ("class", "E"), ("function", "run"), ("function", "ref"), ("function", "g"), ("route", "/x"), ("route", "/attr")},
    ),
    "TypeScript": (
        "import type { A } from './a';\nimport './side';\n// export class No {}\nexport default abstract class Base {}\nexport const load = async <T>(x) => x;\nlet run = function () {};\nvar n = 1;\nexport async function* gen() {}\nconst s = '// no comment'; \nfunction $late() {}\nrouter.users.get(`/u`, f)\n",
        {("import", "./a"), ("import", "./side"), ("class", "Base"), ("export", "Base"), ("export", "load"), ("export", "gen"), ("function", "run"), ("function", "gen"), ("function", "$late"), ("route", "/u")},
    ),
}


@pytest.mark.parametrize("language", sorted(MORE))
def test_more_texts_of_each_language(language):
    text, want = MORE[language]
    rows = code._pattern_symbols("JavaScript" if language == "TypeScript" else language, text, "x/y")
    got = {(r[0], r[1]) for r in rows}
    assert got >= want and not {n for _, n in got} & {"Hidden", "hidden", "No", "no", "x.Y", "C" if language == "C#" else "/no"}, got ^ want


def test_masks_keep_strings_and_lines():
    from stratalith.functions import grammars

    text = 'a = "http://x"; // note\n/* two\nlines */ b = \'/*\' c\n'
    masked = grammars.GRAMMARS["Java"].masked(text)
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
    assert '"http://x"' in masked and "note" not in masked and "two" not in masked and "b = '/*' c" in masked


def test_sources_are_dealt(spark):
    """Each task has texts of all languages, and parsing has a task for a bounded number of files."""
    from stratalith.sources import sources
    from stratalith.sources.shared import dealt, written

    files = sources._files(spark, "/root/testdata/sf0.01")
    made = written(files.filter("path RLIKE '[0-9]'"))
    languages = made.groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("language").alias("n"), F.count("*").alias("rows"))
    assert languages.filter("rows >= 100 AND n < 8").isEmpty()
    parts = dealt(made, "repo_id", "path", rows=50).groupBy(F.spark_partition_id()).count()
    assert made.count() == 2000 and parts.agg(F.max("count")).first()[0] <= 150


def test_imports_of_one_module_are_dealt(spark):
    """Most files of a repository import one file: its edges come from several tasks."""
    files = spark.range(9000).selectExpr("'r' AS repo_id", "concat('a', id, '.py') AS path").union(spark.sql("SELECT 'r', 'shared/base.py'"))
    symbols = files.selectExpr("repo_id", "path", "'import' AS kind", "'shared.base' AS name", "CAST(NULL AS string) AS owner", "1 AS line", "CAST(NULL AS string) AS method", "CAST(NULL AS string) AS handler", "CAST(NULL AS string) AS orm")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        rows = knowledge._drafts(files, symbols).withColumn("task", F.spark_partition_id()).groupBy("task", "target").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["target"] for r in rows} == {"shared/base.py"} and sum(r["count"] for r in rows) == 9001
    assert max(r["count"] for r in rows) < 7500

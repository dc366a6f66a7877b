"""Symbols of source files: imports, exports, classes, functions, methods, routes, data models, variables of the environment, notes.

Files are read in Arrow batches, a text at a time: Python by its own parser, other languages by patterns composed from
their grammars. Everything ends in one long table, (repo_id, path, kind, name, owner, line, method, handler, orm, is_async), a row
for each symbol, so graphs, scores and chunks are joins and aggregates over it. Lines count from 1.

Defined cases: null and empty texts give no rows; a Python file that does not parse is read by line patterns; unknown
languages give variables and notes only; a line number is that of the first character of a match, leading blank lines
included.
"""

from __future__ import annotations

import ast
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import code_rules as rules
from stratalith.functions import grammars

FOUND = "array<struct<at:int,end:int,line:int>>"
SYMBOL = "kind string, name string, owner string, line int, method string, handler string, orm string, is_async boolean"
FIELDS = [c.split()[0] for c in SYMBOL.split(", ")]


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct(at, end, line, g1, ..)> of all matches of a pattern: offsets from 0, line of the first character, groups."""
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    feeds = lambda x: F.regexp_count(x, F.lit("\n"))

    def step(acc: Column, x: Column) -> Column:
        at, line = acc["at"] + F.length(x["piece"]), acc["line"] + feeds(x["piece"])
        end = at + F.length(x["whole"])
        row = F.struct(at.alias("at"), end.alias("end"), line.alias("line"))
        return F.struct(end.alias("at"), (line + feeds(x["whole"])).alias("line"), F.array_append(acc["rows"], row).alias("rows"))

    both = F.filter(F.arrays_zip(pieces.alias("piece"), whole.alias("whole")), lambda x: x["whole"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(FOUND).alias("rows"))
    places = F.aggregate(both, start, step, lambda acc: acc["rows"])
    named = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.transform(F.arrays_zip(places.alias("p"), *named), lambda x: F.struct(x["p"]["at"].alias("at"), x["p"]["end"].alias("end"), x["p"]["line"].alias("line"), *(x[f"g{g}"].alias(f"g{g}") for g in groups)))


def _row(kind: str, name: str | None, line: int | None = None, **more) -> tuple:
    return tuple((more | {"kind": kind, "name": name, "line": line}).get(f) for f in FIELDS)


def route_path(path: str) -> str:
    """Route of a file by its place below a routing root: names in brackets are parameters."""
    root = next((r for r in rules.ROUTE_ROOTS if path.startswith(r)), "")
    ending = next((e for e in rules.ROUTE_ENDINGS if path.endswith(e)), "")
    inner = path[len(root) : len(path) - len(ending)].replace("index", "").replace("[", ":").replace("]", "")
    return "/" + inner.strip("/")


def _is_model(language: str, text: str, name: str, line: int, at: int) -> bool:
    """Do the marks of data models stand by a class of this name?"""
    has = lambda where, marks: any(m in where for m in marks)
    if language == "Java":
        return has("\n".join(text.splitlines()[max(0, line - 6) : line + 2]), rules.JAVA_MODEL_MARKS)
    if language == "Go":
        body = re.search(rf"(?s)type\s+{name}\s*(?:\[[^\]]*\])?\s*struct\s*\{{(.*?)\}}", text)
        return bool(body) and has(body[1].lower(), rules.GO_MODEL_MARKS)
    if language == "JavaScript":
        return has(text[at:].lower(), rules.JS_MODEL_MARKS) or name.lower().endswith(("model", "schema", "entity"))
    if language == "C#":
        if name.lower().endswith("context"):
            return has(text.lower(), ("dbcontext", "dbset<"))
        return bool(re.search(rf"(?s)DbContext|DbSet<\s*{name}\s*>|Entity<\s*{name}\s*>|{name}.*?\[(?:Key|Table|Column)\]", text))
    before, after = rules.MODEL_MARKS[language]
    return bool(re.search(f"(?s)(?:{before}).*?{name}|{name}.*?(?:{after})", text))


def _imported(language: str, text: str) -> set[str]:
    if language == "Go":
        return grammars.go_imports(text)
    pattern = grammars.JS_IMPORT if language == "JavaScript" else grammars.GRAMMARS[language].import_pattern()
    return {m["name"].strip() for m in pattern.finditer(text)}


def _declared(language: str, text: str) -> tuple[list, list]:
    """(types, functions) as matches with a name, in the order of the text; a type is (match, text of its word)."""
    grammar = grammars.GRAMMARS[language]
    types = grammars.GO_TYPE if language == "Go" else grammar.type_pattern()
    functions = list(grammar.function_pattern().finditer(text))
    if language == "JavaScript":
        functions = sorted([*functions, *grammars.JS_VALUE.finditer(text)], key=lambda m: m.start())
    return list(types.finditer(text)), [m for m in functions if m["name"] not in rules.NO_FUNCTION]


def _pattern_symbols(language: str, text: str, path: str) -> list[tuple]:
    """Symbols of a text of a language that has a grammar; comments are masked first."""
    whole, text = text, grammars.GRAMMARS[language].masked(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    word, reach = rules.ASYNC.get(language, (None, 0))
    waits = lambda at: word is not None and word in text[max(0, at - reach) : at]
    types, functions = _declared(language, text)
    out = [_row("import", x) for x in sorted(_imported(language, text))]
    if language == "JavaScript":
        out += [_row("export", x) for x in sorted({m["name"] for m in grammars.JS_EXPORT.finditer(text)})]
        out += [_row("route", route_path(path), line(m.start()), method=m["name"], handler=m["name"]) for m in functions if m["name"] in rules.VERBS]
    for m in functions:
        owner = (m["receiver"] or "").replace("*", " ").split() if language == "Go" else []
        is_async = "async" in m[0] if language == "JavaScript" else language != "Go" and waits(m.start())
        out.append(_row("method" if owner else "function", m["name"], line(m.start()), owner=owner[-1] if owner else None, is_async=is_async))
    out += [_row("class", m["name"], line(m.start())) for m in types]
    out += [_row("model", m["name"], line(m.start()), orm=rules.ORMS[language]) for m in types if _is_model(language, whole, m["name"], line(m.start()), m.start())]
    return out + _routes(language, text, line, functions)


def _routes(language: str, text: str, line, functions: list) -> list[tuple]:
    """Routes with the function that follows each: both are sorted by place, so the nearest one is found by bisection."""
    found = [(at, end, verb, path, None) for at, end, verb, path in grammars.annotated_routes(text, *rules.ANNOTATIONS[language])] if language in rules.ANNOTATIONS else []
    for before, names, quotes in rules.CALLS.get(language, ()):
        found += [(at, end, verb, path, text[at : text.index("(", at)].strip()) for at, end, verb, path in grammars.called_routes(text, before, names, quotes)]
    starts, out = [m.start("name") for m in functions], {}
    for at, end, verb, path, call in sorted(found, key=lambda x: x[0]):
        nearest = bisect_left(starts, end)
        handler = call if language == "JavaScript" else functions[nearest]["name"] if language in rules.HANDLED and nearest < len(functions) else ""
        out.setdefault((verb, path, line(at)), _row("route", path, line(at), method=verb, handler=handler))
    return list(out.values())


def _python_symbols(text: str) -> list[tuple]:
    """(kind, name, owner, line, method, handler, orm, is_async) of a Python text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        plain = lambda kind, pattern: [_row(kind, m[1], text.count("\n", 0, m.start(1)) + 1) for m in re.finditer(pattern, text, re.M)]
        found = {m[1] for m in re.finditer(r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", text, re.M) for m in [(None, m[1] or m[2])]}
        return [_row("import", x, None) for x in sorted(found)] + plain("class", r"^\s*class\s+(\w+)") + plain("function", r"^\s*(?:async\s+)?def\s+(\w+)")
    dotted = lambda n: n.id if isinstance(n, ast.Name) else ".".join(filter(None, (dotted(n.value), n.attr))) if isinstance(n, ast.Attribute) else dotted(n.value) if isinstance(n, ast.Subscript) else None
    last = lambda n: (dotted(n) or "").split(".")[-1]
    out, imported = [], set()
    owners = {child: c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for child in ast.iter_child_nodes(c)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imported.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            imported.add(node.module)
        elif isinstance(node, ast.ClassDef):
            out.append(_row("class", node.name, node.lineno))
            bases = " ".join(dotted(b) or "" for b in node.bases)
            marked = any(
                (isinstance(s, ast.AnnAssign) and dotted(s.annotation) in ("Mapped", "Column")) or (isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and last(s.value.func) in ("Column", "mapped_column", "relationship"))
                for s in node.body
            )
            if marked or any(last(b) in rules.PYTHON_MODEL_BASES for b in node.bases):
                orm = "SQLModel" if "SQLModel" in bases else "Document ORM" if "Document" in bases else "SQLAlchemy/Python ORM"
                out.append(_row("model", node.name, node.lineno, orm=orm))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            owner = owners.get(node)
            out.append(_row("method" if owner else "function", node.name, node.lineno, owner=owner, is_async=isinstance(node, ast.AsyncFunctionDef)))
            for d in node.decorator_list:
                verb = (d.func.attr if isinstance(d.func, ast.Attribute) else getattr(d.func, "id", "")).lower() if isinstance(d, ast.Call) else ""
                if verb in rules.PYTHON_VERBS:
                    first = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else None
                    out.append(_row("route", str(first or "<dynamic>"), node.lineno, method=verb.upper(), handler=f"{owner}.{node.name}" if owner else node.name))
    return [_row("import", x, None) for x in sorted(imported)] + out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (repo_id, path, language, text)."""
    given = files.filter(F.col("language").isin(*rules.PARSERS) & (F.length("text") > 0)).select("repo_id", "path", "language", "text")
    kinds = [pa.int32() if f == "line" else pa.bool_() if f == "is_async" else pa.string() for f in FIELDS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for i, (path, language, text) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                family = "JavaScript" if language == "TypeScript" else language
                here = _python_symbols(text) if family == "Python" else _pattern_symbols(family, text, path)
                rows += here
                owner += [i] * len(here)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(owner, pa.int32())) for c in (0, 1)), *columns], names=["repo_id", "path", *FIELDS])

    return given.mapInArrow(read, f"repo_id {dict(files.dtypes)['repo_id']}, path string, {SYMBOL}")


def env_variables(files: DataFrame) -> DataFrame:
    """repo_id, path, name of each variable of the environment that a file reads, once."""
    found = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(rules.ENV_VARIABLES), F.lit(g)) for g in (1, 2))))
    return files.select("repo_id", "path", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("name"))


def notes(files: DataFrame) -> DataFrame:
    """repo_id, path, tag, text, line of each note to do."""
    found = F.explode(matches(F.coalesce("text", F.lit("")), rules.TODO, 1, 2)).alias("x")
    return files.select("repo_id", "path", found).select("repo_id", "path", F.upper("x.g1").alias("tag"), F.trim("x.g2").alias("text"), "x.line")


def manifest_keys(files: DataFrame) -> DataFrame:
    """repo_id, path, name, dependencies, dev_dependencies, scripts (sorted keys) of JSON files; broken ones have nulls."""
    keys = lambda p: F.array_sort(F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{p}")), F.array().cast("array<string>")))
    return files.filter("language = 'JSON'").select("repo_id", "path", F.get_json_object("text", "$.name").alias("name"), keys("dependencies").alias("dependencies"), keys("devDependencies").alias("dev_dependencies"), keys("scripts").alias("scripts"))


def python_metrics(files: DataFrame) -> DataFrame:
    """repo_id, path, maintainability, blocks: array(name, line, complexity) of Python files that parse."""
    schema = f"repo_id {dict(files.dtypes)['repo_id']}, path string, maintainability double, blocks array<struct<name:string,line:int,complexity:int>>"
    kind = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("complexity", pa.int32())]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, p, *m) for r, p, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if (m := _metrics(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], kind)], names=["repo_id", "path", "maintainability", "blocks"])

    return files.filter("language = 'Python' AND text IS NOT NULL").select("repo_id", "path", "text").mapInArrow(measure, schema)


_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.match_case)


def _complexity(node: ast.AST) -> int:
    """Decisions of a block: branches, extra conditions of and / or, filters of comprehensions."""
    inner = list(ast.walk(node))
    return 1 + sum(isinstance(n, _BRANCHES) for n in inner) + sum(len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp)) + sum(len(n.ifs) for n in inner if isinstance(n, ast.comprehension))


def _metrics(text: str) -> tuple[float, list[dict]] | None:
    """The maintainability index (volume of operators and operands, decisions, lines, share of comments) and the blocks."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    blocks = [{"name": n.name, "line": n.lineno, "complexity": _complexity(n)} for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    operators, operands = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.BinOp | ast.AugAssign):
            operators.append(type(n.op).__name__)
            operands += [ast.dump(n.left if isinstance(n, ast.BinOp) else n.target), ast.dump(n.right if isinstance(n, ast.BinOp) else n.value)]
        elif isinstance(n, ast.UnaryOp):
            operators.append(type(n.op).__name__)
            operands.append(ast.dump(n.operand))
        elif isinstance(n, ast.BoolOp):
            operators.append(type(n.op).__name__)
            operands += map(ast.dump, n.values)
        elif isinstance(n, ast.Compare):
            operators += [type(o).__name__ for o in n.ops]
            operands += map(ast.dump, [n.left, *n.comparators])
    distinct = len(set(operators)) + len(set(operands))
    volume = (len(operators) + len(operands)) * math.log2(distinct) if distinct else 0.0
    lines = [x.strip() for x in text.split("\n")]
    code, comments = sum(bool(x) and not x.startswith("#") for x in lines), sum(x.startswith("#") for x in lines)
    if not code or not volume:
        return 100.0, blocks
    share = comments / (code + comments)
    raw = 171 - 5.2 * math.log(volume) - 0.23 * max(sum(b["complexity"] for b in blocks), 1) - 16.2 * math.log(code) + 50 * math.sin(math.sqrt(2.4 * math.radians(share * 100)))
    return round(min(max(0.0, raw * 100 / 171), 100.0), 2), blocks

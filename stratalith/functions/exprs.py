"""Column builders that stay inside the JVM, and the SQL text of the same rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalith.functions import rules


def any_contains(col: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, (col.contains(t) for t in tokens))


def case_contains(col: Column, table, default) -> Column:
    """Label of the first rule one of whose tokens the lower-cased column contains."""
    low = F.lower(col)
    out = None
    for label, tokens in table:
        out = F.when(any_contains(low, tokens), label) if out is None else out.when(any_contains(low, tokens), label)
    return out.otherwise(default)


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def any_contains_sql(expr: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(t)})" for t in tokens) + ")"


def case_contains_sql(expr: str, table, default) -> str:
    whens = " ".join(f"WHEN {any_contains_sql(f'lower({expr})', tokens)} THEN {quoted(label)}" for label, tokens in table)
    return f"CASE {whens} ELSE {quoted(default) if isinstance(default, str) and not default.startswith('=') else default[1:]} END"


def by_value(col: Column, table: dict, default) -> Column:
    out = None
    for value, result in table.items():
        out = F.when(col == value, result) if out is None else out.when(col == value, result)
    return out.otherwise(default)


def by_value_sql(expr: str, table: dict, default) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(default)} END"


def level(col: Column, steps, default: str) -> Column:
    """Label of the first threshold that the column reaches."""
    out = None
    for least, label in steps:
        out = F.when(col >= least, label) if out is None else out.when(col >= least, label)
    return out.otherwise(default)


def level_sql(expr: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} >= {least} THEN {quoted(label)}" for least, label in steps) + f" ELSE {quoted(default)} END"


def dec_round(col: Column, places: int) -> Column:
    """Rounded half up on the decimal value, as a double: alike in every engine."""
    return F.round(col.cast("decimal(38,10)"), places).cast("double")


def dec_round_sql(expr: str, places: int) -> str:
    return f"round(({expr})::DECIMAL(38,10), {places})::DOUBLE"


def clamp(col: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def entropy(col: Column) -> Column:
    """Shannon entropy of a string, bits a character."""
    n = F.length(col)
    count = lambda c: (n - F.length(F.replace(col, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(col, "")), F.lit(0.0), lambda s, c: s - count(c) * F.log2(count(c)))).otherwise(0.0)


def redact(col: Column) -> Column:
    """Credentials replaced: assignments, bearer values, then long tokens whose entropy is 4 bits a character or more."""
    first = F.regexp_replace(col, rules.REDACT_ASSIGNMENT, "$1$2$3[REDACTED]$4")
    second = F.regexp_replace(first, rules.REDACT_BEARER, "$1 [REDACTED]")
    secret = F.filter(F.regexp_extract_all(second, F.lit(f"({rules.REDACT_LONG})"), F.lit(1)), lambda t: entropy(t) >= 4.0)
    return F.aggregate(secret, second, lambda text, t: F.replace(text, t, F.lit("[REDACTED]")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in rules.LANGUAGES.items() for x in pair))
    name = file_name(path)
    return F.when((name == "Dockerfile") | name.endswith(".Dockerfile"), "Dockerfile").otherwise(F.coalesce(table[suffix(path)], F.lit("Text")))


def ignored(path: Column) -> Column:
    name = file_name(path)
    return (
        F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, rules.IGNORED_PARTS))) | name.isin(rules.IGNORED_NAMES)
        | name.endswith(".min.js") | name.endswith(".bundle.js") | suffix(path).isin([f".{s}" for s in rules.IGNORED_SUFFIXES])
    )


def low_value(path: Column, prefixes=("docs_src/", "tests/", "test/", "scripts/", ".github/"), endings=(".md", ".rst", ".txt", ".yml", ".yaml")) -> Column:
    low = F.lower(path)
    out = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, rules.LOW_VALUE_PARTS)))
    for p in prefixes:
        out = out | low.startswith(p)
    for e in endings:
        out = out | low.endswith(e)
    return out


def example_path(path: Column) -> Column:
    return F.lower(path).rlike("^(docs|examples|tests|test)/|/docs/|/examples/")


def domain(path: Column, stem: bool = False) -> Column:
    """Top folder, two levels for source roots; for a root file its name, or its stem as the knowledge graph has it."""
    parts = F.split(path, "/")
    name = F.regexp_replace(parts[0], r"^(.+)\.[^.]*$", "$1") if stem else parts[0]
    return F.when(F.size(parts) == 1, name).when(parts[0].isin(*rules.NESTED_ROOTS) & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def ancestors(path: Column) -> Column:
    """All parent folders, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def search_terms(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(rules.SEARCH_WORD), F.lit(0))


def weighted_mean(pairs) -> Column:
    """Mean of (value, weight) over the values that are there."""
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.when(weight > 0, total / weight)

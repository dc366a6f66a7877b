"""Queries without SQL of their own, against plain Python over the tables they are made of."""

from collections import Counter

import pytest
from compare import DATA
from pyspark.sql import functions as F

from stratalith import catalogue
from stratalith.operators import knowledge, retrieval
from stratalith.plans import q_code
from stratalith.sources import sources

SF = f"{DATA}/sf0.001"


def test_projection_metrics(spark):
    nodes, edges = knowledge.projection(*q_code._given(spark, SF), q_code._deps(spark, SF))
    ids, risks, links = Counter(), Counter(), {}
    for r in nodes.collect():
        ids[r["repo_id"]] += 1
        risks[r["repo_id"]] += r["kind"] == "security_finding"
    for r in edges.collect():
        links.setdefault(r["repo_id"], []).append((r["source"], r["target"]))
    got = catalogue.QUERIES["projection_metrics"](spark, SF).collect()
    assert {r["repo_id"] for r in got} == set(ids)
    for r in got:
        n, e = ids[r["repo_id"]], links[r["repo_id"]]
        health = 100 - (1 - len({x for pair in e for x in pair}) / n) * 45 - risks[r["repo_id"]] / n * 35
        assert (r["node_count"], r["edge_count"]) == (n, len(e)) and r["graph_density"] == pytest.approx(len(e) / (n * (n - 1)), abs=6e-6) and abs(r["graph_health"] - health) <= 0.51


def boost(path, terms):
    low, out = path.lower(), 0.0
    if {"route", "routes", "routing", "api", "endpoint"} & terms:
        out += 0.16 * any(t in low for t in ("route", "routing", "router", "view", "endpoint", "controller", "handler")) + 0.28 * low.endswith(("main.py", "main.ts", "main.tsx"))
    if {"database", "db", "sql", "model", "schema"} & terms:
        out += 0.18 * any(t in low for t in ("database", "db", "sql", "storage", "store", "model", "schema", "chroma", "metadata")) + 0.22 * low.endswith(("store.py", "indexer.py", "retriever.py", "config.py"))
    out -= 0.24 * any(p in low.split("/") for p in ("test", "tests", "docs", "doc", "docs_src", "examples", "scripts")) + 0.22 * low.startswith(("docs_src/", "tests/", "test/", "scripts/", ".github/")) + 0.22 * low.endswith((".md", ".rst", ".txt"))
    return out + 0.16 * low.endswith((".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".go", ".rs", ".cs", ".kt", ".kts", ".php"))


def test_hybrid_retrieval(spark):
    import re

    from stratalith.plans import q_views

    files = sources.files(spark, SF).withColumn("doc_id", F.xxhash64("repo_id", "path")).select("doc_id", "path", "text", (F.pmod("doc_id", F.lit(1000)) / 1000).alias("near")).collect()
    special = {r["path"] for r in catalogue.QUERIES["architecture_files"](spark, SF).filter("routed").collect()}
    terms = set(retrieval.question_terms(q_views.QUESTION))
    words = {r["doc_id"]: Counter(re.findall("[A-Za-z0-9_./-]+", r["text"].lower())) for r in files}
    n, mean = len(files), sum(sum(w.values()) for w in words.values()) / len(files)
    df = Counter(t for w in words.values() for t in terms & set(w))
    low_value = lambda p: bool({"test", "tests", "docs", "doc", "docs_src", "examples", "example", "fixtures", "fixture"} & set(p.lower().split("/"))) or p.lower().startswith(("docs_src/", "tests/", "test/", "scripts/", ".github/")) or p.lower().endswith((".md", ".rst", ".txt", ".yml", ".yaml"))
    pinned = sorted(special, key=lambda p: (low_value(p), p.count("/"), p))[:12]
    held = {r["doc_id"] for p in pinned for r in sorted((x for x in files if x["path"] == p), key=lambda x: x["doc_id"])[:3]}
    best = {}
    for r in files:
        w, add = words[r["doc_id"]], boost(r["path"], terms)
        lexical = round(len(terms & set(w)) / len(terms), 4)
        size = sum(w.values())
        score = sum(max(0.0, (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * size / max(mean, 1))) for t in terms & set(w))
        made = [0.66 * r["near"] + 0.22 * lexical + add] + [0.72 + 0.18 * lexical + add] * (r["doc_id"] in held) + [min(0.95, 0.42 + score / 18 + add)] * (score > 0)
        best[r["doc_id"]] = max(made)
    got = catalogue.QUERIES["hybrid_retrieval"](spark, SF).collect()
    want = sorted(best.values(), reverse=True)[:48]
    assert [r["score"] for r in got] == pytest.approx(want, abs=2e-4) and all(abs(best[r["doc_id"]] - r["score"]) < 2e-4 for r in got)

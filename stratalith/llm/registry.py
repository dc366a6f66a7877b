"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from stratalith.llm import collocations, fim, html, jaccard, language, lines, masked_lm, mixing, pii, quality, substrings, templates, toxicity

_MODULES = (jaccard, language, toxicity, masked_lm, substrings, pii, quality, templates, html, mixing, lines, fim, collocations)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

"""Training-data operators: near duplicates, language, toxicity, LM scores, substrings, PII, quality, leaks, HTML, mixing."""

"""What the operators of this subpackage share, beside the library's written tables and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.sources.shared import dealt_join, shared_dir, small, written

__all__ = ["WORD", "dealt_join", "shared_dir", "small", "word_count", "written"]
#: Words of a text, as a pattern that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

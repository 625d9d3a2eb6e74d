"""White-space rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, non-breaking ones included.
BLANKS = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(col: Column) -> Column:
    """No white space around, one blank for each run within; null stays null."""
    inner = F.regexp_replace(col, f"[{BLANKS}]+", " ")
    return F.trim(inner)


def term(col: Column) -> Column:
    """Lower case; white space, hyphens and underscores dropped around and one underscore within."""
    joined = F.regexp_replace(F.lower(col), rf"[{BLANKS}\-_]+", "_")
    return F.trim(joined, F.lit("_"))

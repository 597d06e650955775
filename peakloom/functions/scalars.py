"""Scalar expressions on names, scores and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before_paren(c: Column) -> Column:
    """'SYMBOL (123)' as 'SYMBOL'."""
    return F.substring_index(c, " (", 1)


def unversioned(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def bare_chromosome(c: Column) -> Column:
    """Without 'chr'; M becomes MT."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def pretty_term(c: Column, prefix: str = "") -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"^{prefix}", ""), "_", " "))


def safe_name(c: Column) -> Column:
    """Characters that file names shouldn't hold become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def scientific(c: Column) -> Column:
    """Two decimals and an exponent; ties round up."""
    return F.format_string("%.2e", c.cast("double"))


def score_of_q(q: float) -> int:
    """The score that stands for a significance threshold: -10 log10 q."""
    import math

    return round(-10 * math.log10(q))


def clipped_score(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(1000))).cast("short")


def hundredths(r: Column) -> Column:
    """A correlation as a whole number of hundredths, as stored."""
    return F.greatest(F.lit(-100), F.least(F.bround(r * 100), F.lit(100))).cast("byte")


def contains_text(text: str, *columns: str) -> Column:
    """Whether any column holds the text literally, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.upper(c).contains(text.upper())
    return out


def log_z(c: Column) -> Column:
    return F.log10(c + 1)

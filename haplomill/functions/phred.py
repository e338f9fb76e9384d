"""Column expressions for phred scores and base-10 log probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def err(q) -> Column:
    """P(error) of a phred score."""
    return F.pow(F.lit(10.0), -F.col(q) / 10) if isinstance(q, str) else F.pow(F.lit(10.0), -q / 10)


def log_ok(q: str = "qv") -> Column:
    return F.log10(1 - err(q))


def log_err(q: str = "qv") -> Column:
    return -F.col(q) / 10


def phred(p: Column) -> Column:
    return -10 * F.log10(F.least(p, F.lit(1.0)))


def log_sum(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b)."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), F.least(a, b) - F.greatest(a, b)))


def log_diff(a: Column, b: Column) -> Column:
    """log10(10**a - 10**b); null where b is not smaller."""
    return F.when(b < a, a + F.log10(1 - F.pow(F.lit(10.0), b - a)))


def quality(post: Column) -> Column:
    """Phred quality of a log posterior, at most 100."""
    return F.least(F.lit(100.0), F.coalesce(-10 * log_diff(F.lit(0.0), post), F.lit(100.0)))


def from_char(c: Column) -> Column:
    return F.ascii(c) - 33


def to_char(q: Column) -> Column:
    return F.chr(F.least(q, F.lit(93)) + 33)


def flip(a: Column) -> Column:
    return 1 - a

"""Columns read out of model answers: codes, scores, levels and confidences.

Java's regular expressions take \\b and \\d as ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import first_of

# Patterns of codes, scores and confidences, and words that look like codes.
CODE = r"\b[A-Z][A-Z_]{3,}[A-Z]\b"
NOT_CODES = ("THE", "AND", "FOR", "NOT", "BUT", "FROM", "WITH", "THIS", "THAT", "WHEN", "WHERE")
SCORES = (r"(?i)(?:risk\s*score|score)[:\s]*(\d{1,3})", r"(?i)(\d{1,3})\s*/\s*100", r"(?i)RISK_SCORE[:\s]*(\d{1,3})")
CONFIDENCES = (r"(?i)confidence[:\s]*([\d.]+)", r"(?i)([\d.]+)\s*confidence", r"(?i)CONFIDENCE[:\s]*([\d.]+)")


def risk_codes(text: Column) -> Column:
    """All codes in order, repeats kept; null for a null text."""
    found = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    return F.filter(found, lambda c: ~c.isin(*NOT_CODES))


def score(text: Column, default: int = 0) -> Column:
    """The first pattern's number, 0 to 100; the default if none is found."""
    found = F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("int") for p in SCORES))
    return F.when(found > 100, 100).otherwise(F.coalesce(found, F.lit(default)))


def level(text: Column) -> Column:
    up = F.upper(text)
    return (
        F.when(F.contains(up, F.lit("CRITICAL")), "CRITICAL")
        .when(F.contains(up, F.lit("HIGH")) & F.contains(up, F.lit("RISK")), "HIGH")
        .when(F.contains(up, F.lit("MEDIUM")), "MEDIUM")
        .when(F.contains(up, F.lit("LOW")) & F.contains(up, F.lit("RISK")), "LOW")
        .otherwise("MEDIUM")
    )


def confidence(text: Column, default: float = 0.5, most: float | None = 1.0) -> Column:
    """The first pattern that gives a number; over 1 is a percentage; 0 to ``most``, or without a limit if that is None."""
    found = F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("double") for p in CONFIDENCES))
    share = F.when(found > 1, found / 100).otherwise(found)
    share = share if most is None else F.when(share > most, F.lit(most)).otherwise(share)
    return F.coalesce(share, F.lit(default))


def sanctions_flag(text: Column) -> Column:
    up = F.upper(text)
    return F.coalesce(F.contains(up, F.lit("MATCH")) & ~F.contains(up, F.lit("NO_MATCH")), F.lit(False))


def pep_flag(text: Column) -> Column:
    """PEP is named, and no NOT stands in the ten characters before its first place."""
    up = F.upper(text)
    at = F.instr(up, "PEP")
    start = F.greatest(at - 10, F.lit(1))
    before = F.substring(up, start, at - start)
    return F.coalesce((at > 0) & ~F.contains(before, F.lit("NOT")), F.lit(False))


def severity_of_factor(code: Column) -> Column:
    return first_of(
        F.upper(code),
        ((("SANCTION", "DARKNET", "CRITICAL"), "CRITICAL"), (("HIGH_RISK", "MIXER", "PEP"), "HIGH")),
        "MEDIUM",
    )

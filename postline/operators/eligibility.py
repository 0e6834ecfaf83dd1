"""Eligibility predicates: US location, internship, clearance language.

Each predicate is an OR-chain of literal ``rlike`` patterns, so every
pattern is compiled once per task and the whole test stays in codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    INTERNSHIP_PATTERNS,
    SECURITY_CLEARANCE_PATTERNS,
    UI_LOCATION_PATTERN_COUNT,
    US_LOCATION_PATTERNS,
)
from ..functions.regex import java_pattern
from ..functions.text import fold_text, remembered

# Every clearance pattern contains this word: a cheap exact pre-test.
CLEARANCE_WORD = "clearance"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(text: Column, patterns) -> Column:
    out = None
    for pattern, ignore_case in patterns:
        test = text.rlike(java_pattern(pattern, ignore_case))
        out = test if out is None else (out | test)
    return out if out is not None else F.lit(False)


@remembered
def is_us_location(location, mode: str = "strict") -> Column:
    """US location test on the original-case text.

    ``mode='strict'`` uses all eight patterns (the stored-row rule);
    ``mode='names_only'`` reproduces the browser filter, which lower-cases
    first so its upper-case state abbreviations never match.
    """
    text = F.coalesce(_col(location), F.lit(""))
    if mode == "strict":
        return _any(text, US_LOCATION_PATTERNS)
    if mode == "names_only":
        return _any(F.lower(text), US_LOCATION_PATTERNS[:UI_LOCATION_PATTERN_COUNT])
    raise ValueError(f"unknown mode {mode!r}")


@remembered
def internship_folded(title_f, type_f) -> Column:
    """Internship test on folded title and employment type."""
    text = F.concat_ws(" ", _col(title_f), _col(type_f))
    return _any(text, INTERNSHIP_PATTERNS)


@remembered
def clearance_folded(title_f, type_f, desc_f) -> Column:
    """Clearance-language test on folded title, employment type and description."""
    text = F.concat_ws(" ", _col(title_f), _col(type_f), _col(desc_f))
    return F.contains(text, F.lit(CLEARANCE_WORD)) & _any(text, SECURITY_CLEARANCE_PATTERNS)


@remembered
def is_internship(title, employment_type) -> Column:
    return internship_folded(fold_text(title), fold_text(employment_type))


@remembered
def requires_clearance(title, employment_type, description) -> Column:
    return clearance_folded(fold_text(title), fold_text(employment_type), fold_text(description))


@remembered
def eligible_folded(location, title_f, type_f, desc_f) -> Column:
    return (
        is_us_location(location)
        & ~internship_folded(title_f, type_f)
        & ~clearance_folded(title_f, type_f, desc_f)
    )


def eligibility_columns(df: DataFrame) -> DataFrame:
    """Adds is_us, is_intern, needs_clearance and eligible (audit columns)."""
    return (
        df.withColumn("is_us", is_us_location("location"))
        .withColumn("is_intern", is_internship("title", "employment_type"))
        .withColumn("needs_clearance", requires_clearance("title", "employment_type", "description"))
        .withColumn("eligible", F.col("is_us") & ~F.col("is_intern") & ~F.col("needs_clearance"))
    )


def is_eligible(df: DataFrame) -> Column:
    return (
        is_us_location("location")
        & ~is_internship("title", "employment_type")
        & ~requires_clearance("title", "employment_type", "description")
    )


#: What the rules are: a stored verdict counts only if it was made by the same patterns.
RULES_TAG = hashlib.sha256(repr((US_LOCATION_PATTERNS, INTERNSHIP_PATTERNS, SECURITY_CLEARANCE_PATTERNS)).encode()).hexdigest()[:16]
VERDICT = "verdict"
VERDICT_TYPE = "struct<rules: string, text: bigint, eligible: boolean>"


def text_digest() -> Column:
    """64 bits of the fields that eligibility reads."""
    return F.xxhash64("location", "title", "employment_type", "description")


def with_verdict(df: DataFrame, eligible: str | Column) -> DataFrame:
    """df with the verdict column: the rules' tag, the digest of the text judged, and the flag."""
    flag = F.col(eligible) if isinstance(eligible, str) else eligible
    return df.withColumn(VERDICT, F.struct(F.lit(RULES_TAG).alias("rules"), text_digest().alias("text"), flag.alias("eligible")))


def fresh_verdict(df: DataFrame) -> Column:
    """Whether the row's verdict was made by the present rules from its present text."""
    if VERDICT not in df.columns:
        return F.lit(False)
    known = (F.col(f"{VERDICT}.rules") == RULES_TAG) & (F.col(f"{VERDICT}.text") == text_digest()) & F.col(f"{VERDICT}.eligible").isNotNull()
    return F.coalesce(known, F.lit(False))


def still_eligible(df: DataFrame) -> Column:
    """The stored verdict where it is fresh, else the rules' own."""
    if VERDICT not in df.columns:
        return is_eligible(df)
    return F.when(fresh_verdict(df), F.col(f"{VERDICT}.eligible")).otherwise(is_eligible(df))


def eligible_only(df: DataFrame) -> DataFrame:
    return df.filter(is_eligible(df))


def skip_reason(df: DataFrame) -> DataFrame:
    """Ineligible rows with the first failing predicate as reason."""
    return eligibility_columns(df).filter(~F.col("eligible")).withColumn(
        "reason",
        F.when(~F.col("is_us"), F.lit("location"))
        .when(F.col("is_intern"), F.lit("internship"))
        .otherwise(F.lit("clearance")),
    )

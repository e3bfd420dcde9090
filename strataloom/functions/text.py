"""Text cleaning and pattern screens."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numbers import as_col


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalise_text(c: str | Column) -> Column:
    """NFKC form without byte-order mark and surrounding blanks."""
    bare = F.regexp_replace(_nfkc(as_col(c).cast("string")), "﻿", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


# Claim patterns that a published text must not contain.
CLAIM_PATTERNS = {
    "confidence_as_probability": r"(?i)\bconfidence\s+(?:is|means|represents)\s+(?:a\s+)?probability\b",
    "numeric_profit_probability": r"(?i)\bprobability of (?:profit|success|return)\s*[:=]\s*\d",
    "recommendation_strength": r"(?i)\brecommendation strength\s*[:=]\s*(?:high|medium|low|\d)",
    "calibrated_confidence_claim": r"(?i)\bcalibrated confidence\b",
    "validated_reliability_claim": r"(?i)\b(?:shows|establishes|demonstrates) validated predictive reliability\b",
    "achievable_or_implementable_performance": r"(?i)\b(?:achievable|implementable)\s+(?:performance|returns?)\b",
    "investment_value_claim": r"(?i)\binvestment value (?:is|was) (?:shown|established|demonstrated)\b",
    "reliable_edge_claim": r"(?i)\breliable predictive edge (?:is|was) (?:shown|established|found)\b",
}


def pattern_hits(c: str | Column, patterns: Mapping[str, str]) -> Column:
    """Names of the patterns found in a text, in the given order."""
    text = as_col(c)
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))

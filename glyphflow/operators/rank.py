"""The relevance score, 0 to 100, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed weights of the score: a point for each match up to a bound, a title hit, whole words, coverage.
MATCH, MATCHES, TITLE, EXACT, COVERAGE = 4, 15, 20, 10, 15
WHOLE = MATCH * MATCHES + TITLE + EXACT + COVERAGE


def score(matches: Column, title_hit: Column, all_exact: Column, coverage: Column | None = None) -> Column:
    cover = F.lit(1.0) if coverage is None else coverage
    raw = MATCH * F.least(matches, F.lit(MATCHES)) + F.when(title_hit, TITLE).otherwise(0) + F.when(all_exact, EXACT).otherwise(0) + COVERAGE * cover
    return F.round(F.least(raw / F.lit(float(WHOLE)) * 100.0, F.lit(100.0)), 2)

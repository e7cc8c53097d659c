"""Vector and overlap functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DENSE_WEIGHT, LEXICAL_WEIGHT, METADATA_WEIGHT = 0.65, 0.25, 0.10


def overlap(query_terms: Column, other_terms: Column) -> Column:
    """Share of distinct query terms that the other set has; 0 if either is empty."""
    bad = (F.size(query_terms) == 0) | (F.size(other_terms) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_terms, other_terms)) / F.size(query_terms))

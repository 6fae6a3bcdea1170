"""Quantile-vector access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions inside a five-point quantile vector.
LOW, LOWER_QUARTILE, MEDIAN, UPPER_QUARTILE, HIGH = range(5)


def point(vector: Column, index: int) -> Column:
    """Element of a quantile vector, NULL when the vector is too short."""
    return F.get(vector, index)


def point_or_zero(vector: Column, index: int) -> Column:
    """Element of a quantile vector with missing read as zero."""
    return F.coalesce(F.get(vector, index), F.lit(0.0))


def point_of_variant(variant: Column, path: str, index: int) -> Column:
    """Quantile from a variant that holds either a list or a ``min/median/max`` object; missing reads as zero."""
    named = {LOW: "min", MEDIAN: "median", HIGH: "max"}.get(index, str(index))
    listed = F.try_variant_get(variant, f"{path}[{index}]", "double")
    keyed = F.try_variant_get(variant, f"{path}.{named}", "double")
    return F.coalesce(listed, keyed, F.lit(0.0))


def point_from_json(payload: Column, path: str, index: int) -> Column:
    """Quantile from JSON text, see :func:`point_of_variant`."""
    return point_of_variant(F.try_parse_json(payload), path, index)

"""Distances between vectors, hashes and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; null for vectors of different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for a zero vector or different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(0.0)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))

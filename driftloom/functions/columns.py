"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two float arrays, in double precision; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Set similarity of two arrays; two empty arrays give ``empty``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(text: Column, k: int) -> Column:
    """Distinct runs of ``k`` characters of a string; a shorter string is its own single shingle."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(runs))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words of a text in any script: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sign_bits(vector: str) -> Column:
    """Bipolar form of a vector: whether each item is above zero."""
    return F.transform(vector, lambda v: (v > 0).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Share of unequal places of two equally long arrays."""
    unequal = F.aggregate(F.zip_with(a, b, lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return unequal / F.size(a)


def md5_int(value: Column, digits: int = 8) -> Column:
    """A non-negative number from the first hex digits of an MD5, alike in every engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")

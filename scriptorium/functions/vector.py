"""Vector arithmetic and scores as column expressions; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains whose boost counts more.
SUBSTANTIVE = ("property law", "land law", "criminal law", "civil law", "family law")


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def shown_similarity(distance: Column) -> Column:
    """1 - distance, as results display it; a distance over 1 makes it negative."""
    return 1.0 - distance


def mean(a: Column) -> Column:
    return F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def std(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def domain_boost(domain: Column, wanted: Column) -> Column:
    """Sum of confidences of the wanted domains (struct domain, confidence_score), half for a mere substring, at most 1.

    A text without a domain has no boost; a wanted domain without a name is a
    part of any.
    """
    d = F.lower(F.coalesce(domain, F.lit("")))

    def one(w: Column) -> Column:
        q, c = F.lower(F.coalesce(w["domain"], F.lit(""))), F.coalesce(w["confidence_score"], F.lit(0.5))
        return F.when(d == q, c).when(d.contains(q) | q.contains(d), c * 0.5).otherwise(0.0)

    total = F.aggregate(wanted, F.lit(0.0), lambda s, w: s + one(w))
    return F.when(d == "", 0.0).otherwise(F.least(F.lit(1.0), total))


def multiplier(domain: Column) -> Column:
    d, out = F.lower(F.coalesce(domain, F.lit(""))), F.lit(False)
    for s in SUBSTANTIVE:
        out = out | d.contains(s)
    return F.when(out, 0.5).otherwise(0.2)


def chunk_score(distance: Column, domain: Column, wanted: Column) -> Column:
    return distance_score(distance) + multiplier(domain) * domain_boost(domain, wanted)


def reasons(base: Column, component: Column, matched: Column, boost: Column) -> Column:
    """Why a chunk is in the result."""
    found = F.array_compact(
        F.array(
            F.when(base > 0.7, "High semantic similarity").when(base > 0.5, "Moderate semantic similarity"),
            F.when(matched, F.concat(F.lit("Target component match ("), F.upper(component), F.lit(")"))),
            F.when(boost > 0, F.format_string("Legal domain overlap (boost: +%.2f)", boost)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Basic relevance")))

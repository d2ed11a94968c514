"""Ranking arithmetic as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TIE = 0.1
#: Weight of a match in each field.
FIELD_BOOSTS = {"identifiers": 4.0, "title": 3.0, "authors": 2.0, "venue": 1.5, "body": 1.0, "institutions": 1.0, "topics": 1.0}


def idf(n: Column, df: Column) -> Column:
    """BM25's inverse document frequency."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, length: Column, mean: Column) -> Column:
    """BM25's saturated term frequency."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def dismax(best: Column, total: Column, tie: float = TIE) -> Column:
    """The best field's score and a little of the others'."""
    return best + tie * (total - best)


def citation_boost(score: Column, citations: Column, weight: float) -> Column:
    """Before reranking: a bounded factor that grows with the logarithm of the citations."""
    c = F.coalesce(citations, F.lit(0))
    return F.when(c > 0, score * (1 + weight * F.least(F.lit(1.0), F.log10(1 + c) / 5.5))).otherwise(score)


def citation_bonus(score: Column, citations: Column, weight: float) -> Column:
    """After reranking: an unbounded addend."""
    c = F.coalesce(citations, F.lit(0))
    return F.when(c > 0, score + weight * F.log10(1 + c)).otherwise(score)


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a grade at a 1-based rank."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)

"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


#: The factor of the sum over terms in the keyword score.
KEYWORD = 0.27465307216702745


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity_of_distance(d: Column) -> Column:
    """1 - d within 0 and 1; 0 for a negative or missing distance."""
    return F.when(d.isNull() | (d < 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d)))


def softmax(score: Column, *by: str) -> Column:
    """Softmax over a group, shifted by its maximum."""
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def keyword_score_compat(query_terms: Column, tokens: Column) -> Column:
    """Sigmoid of a one-document BM25, whose idf is the same negative constant for every term.

    No hit gives 0.5; every hit lowers the score.
    """
    def term(q: Column) -> Column:
        f = F.size(F.filter(tokens, lambda t: t == q)).cast("double")
        return f * 2.5 / (f + 1.5)

    return keyword_score_of(F.aggregate(F.transform(query_terms, term), F.lit(0.0), lambda a, x: a + x))


def keyword_score_of(total: Column) -> Column:
    """The keyword score of a sum over the query's terms of 2.5 f / (f + 1.5), f being how often a term occurs."""
    return 1 / (1 + F.exp(total * KEYWORD))


def hybrid(semantic: Column, keyword: Column, alpha: float = 0.7) -> Column:
    """alpha of the semantic score and the rest of the keyword score (of five, at most 1)."""
    return semantic * alpha + F.least(keyword / 5, F.lit(1.0)) * (1 - alpha)

"""Vector and token similarity as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    """In double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))


def l2_normalise(a: Column) -> Column:
    # named by a lambda, so that the length is worked out once and not again for each component
    n = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return F.get(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda t: F.length(t) >= 3))


def alpha_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters, by longest matching blocks; for pairs that cheaper bounds have left."""
    return _ratio(F.lower(a), F.lower(b))


def character_set(text: Column) -> Column:
    """The characters of text as a set: each with the number of its occurrence, so that common members are common counts."""
    # named by a lambda, so that the characters are sorted once and not again for each of them
    numbered = lambda ordered: F.transform(ordered, lambda c, i: F.concat(c, (i + 2 - F.array_position(ordered, c)).cast("string")))
    return F.get(F.transform(F.array(F.array_sort(F.split(text, ""))), numbered), F.lit(0))

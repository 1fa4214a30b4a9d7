"""Declared orders of the enumerations; text order is not their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members in declared order.
ENUMS = {
    "question_type": ("mcq", "true_false", "short_answer", "essay"),
    "difficulty": ("easy", "medium", "hard"),
    "bloom_level": ("remember", "understand", "apply", "analyze", "evaluate", "create"),
    "question_status": ("draft", "approved", "rejected", "reviewed"),
}


def ordinal(value: Column, enum: str) -> Column:
    """Place in the declared order, from 0; null for anything else."""
    return F.create_map(*(x for k, v in enumerate(ENUMS[enum]) for x in (F.lit(v), F.lit(k))))[value]


def ordinal_sql(column: str, enum: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(ENUMS[enum])) + " END"

"""The boundary to language and embedding models: a provider protocol, a deterministic stand-in, and hashed embeddings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType


class Provider(Protocol):
    """What a model adapter offers; it is created on the executors, so it must be picklable."""

    def generate(self, prompt: str, as_json: bool) -> str: ...


class StandIn:
    """Replies from the prompt alone: a level by the prompt's length, as JSON, or in words where JSON is not asked for."""

    def generate(self, prompt: str, as_json: bool) -> str:
        level = ("easy", "medium", "hard", "unclear")[len(prompt) % 4]
        reply = json.dumps({"level": level})
        if as_json and len(prompt) % 5 == 0:
            return "no JSON today"
        return reply if as_json else f"Reply: {reply}."


def generate(prompts: DataFrame, provider: Provider, key: str = "id", column: str = "prompt") -> DataFrame:
    """id, reply and attempts: a reply that is not JSON is asked for once more in plain mode and cut to its braces."""

    def ask(prompt: str) -> tuple[str | None, int]:
        for attempt, as_json in enumerate((True, False), 1):
            reply = provider.generate(prompt, as_json)
            start, end = reply.find("{"), reply.rfind("}")
            try:
                return json.dumps(json.loads(reply[start : end + 1])), attempt
            except ValueError:
                continue
        return None, 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = [ask(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"id": pdf["id"], "reply": [r[0] for r in replies], "attempts": [r[1] for r in replies]})

    return prompts.select(F.col(key).alias("id"), F.col(column).alias("prompt")).mapInPandas(run, "id long, reply string, attempts int")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Counts of hashed words, scaled to unit length: an embedding without a model."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double"))
    return F.transform(F.array(counts), lambda c: F.transform(c, lambda x: F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))))[0]


def default_value(kind: DataType):  # noqa: ANN201
    """The empty instance of a schema: zeros, empty texts and lists, nested."""
    if isinstance(kind, StructType):
        return {f.name: default_value(f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return []
    if isinstance(kind, BooleanType):
        return False
    if isinstance(kind, NumericType):
        return 0
    return "" if isinstance(kind, StringType) else None

"""Vectors of texts from a model that is loaded once in each worker and asked in small batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a model is given at a time; words whose hashes a worker keeps, since all words of a corpus have no bound.
BATCH, KNOWN = 32, 1 << 16


class EmbeddingModel(Protocol):
    """What an adapter offers. encode() gives a vector of ``size`` numbers for each text, in their order."""

    size: int

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...

    def health_check(self) -> bool: ...


Loader = Callable[[], EmbeddingModel]
#: Models of this process, by the name under which they were asked for.
_LOADED: dict[str, EmbeddingModel] = {}


def loaded(name: str, loader: Loader) -> EmbeddingModel:
    """The worker's model of that name: Spark keeps workers for many tasks, and the model stays as long as they do."""
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]


class HashedModel:
    """Counts of hashed words: an embedding without a model, for tests and as a baseline."""

    def __init__(self, size: int = 64) -> None:
        self.size, self._slot = size, lru_cache(KNOWN)(self._hashed)

    def _hashed(self, word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in re.findall("[a-z]{3,}", text.lower()):
                row[self._slot(word)] += 1
        return out

    def health_check(self) -> bool:
        return True


def unit(vectors: np.ndarray) -> np.ndarray:
    """Each row with length 1; a row of zeros stays."""
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def embed(rows: DataFrame, text: str, size: int, name: str = "hashed", loader: Loader = HashedModel, batch: int = BATCH) -> DataFrame:
    """rows with ``embedding``, a vector of length 1 of the column text; null for a null or blank text.

    The loader and the name travel to the workers, the model does not. The text column is all that the model sees, BATCH texts
    at a time over the whole partition. A model whose vectors are of another size stops the job.
    """
    kept = [c for c in rows.columns if c.lower() != "embedding"]
    slim = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = part.column(1).to_pylist()
                asked = [k for k, t in enumerate(texts) if t and t.strip()]
                vectors: list = [None] * len(texts)
                if asked:
                    model = model or loaded(name, loader)
                    found = unit(np.asarray(model.encode([texts[k] for k in asked]), dtype=np.float64))
                    if found.shape != (len(asked), size):
                        raise ValueError(f"{name} gave vectors of shape {found.shape} for {len(asked)} texts, not of {size} numbers")
                    for k, v in zip(asked, found):
                        vectors[k] = v
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["row", "embedding"])

    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, embedding array<double>").select("row.*", "embedding")


def health(spark: SparkSession, name: str = "hashed", loader: Loader = HashedModel) -> DataFrame:
    """name, healthy, error: whether a worker can load the model and the model says that it works."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                healthy, error = bool(loaded(name, loader).health_check()), None
            except Exception as broken:  # whatever an adapter raises is the answer
                healthy, error = False, f"{type(broken).__name__}: {broken}"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([healthy]), pa.array([error], pa.string())], names=["name", "healthy", "error"])

    return spark.range(1).repartition(1).mapInArrow(run, "name string, healthy boolean, error string")

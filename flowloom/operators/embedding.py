"""Text encoders as Arrow functions, and checks on vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class Encoder(Protocol):
    """What turns texts into vectors; one is made for each Python worker."""

    name: str

    def dimension(self) -> int: ...

    def encode(self, texts: list[str], normalize: bool = True) -> np.ndarray: ...


class HashingEncoder:
    """Counts of hashed words, signed, with unit length: deterministic and without a model file."""

    def __init__(self, size: int = 64):
        self.name, self.size = f"hashing-{size}", size

    def dimension(self) -> int:
        return self.size

    def encode(self, texts: list[str], normalize: bool = True) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.size] += 1 if h >> 31 else -1
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1)[:, None] if normalize else out


class KeywordEncoder:
    """One axis for each keyword: 1 and the number of its occurrences."""

    def __init__(self, keywords: list[str]):
        self.name, self.keywords = "keywords-" + "-".join(keywords), keywords

    def dimension(self) -> int:
        return len(self.keywords)

    def encode(self, texts: list[str], normalize: bool = True) -> np.ndarray:
        out = np.array([[1.0 + t.lower().count(k) for k in self.keywords] for t in texts])
        return out / np.linalg.norm(out, axis=1)[:, None] if normalize else out


def encode(text: Column, encoder: Encoder, batch: int = 16) -> Column:
    """The vectors of a text column, in batches; a blank text is an error."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("a text to encode is blank")
            made = [v for a in range(0, len(texts), batch) for v in encoder.encode(texts[a : a + batch])]
            if any(len(v) != encoder.dimension() for v in made):
                raise ValueError("the encoder's vectors have another length than it says")
            yield pd.Series([list(map(float, v)) for v in made])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(DoubleType()))(text)


def embedding_input(title: Column, category: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nCategory: "), category, F.lit("\nSection: "), section, F.lit("\n\n"), text)


def embed_chunks(made: DataFrame, encoder: Encoder) -> DataFrame:
    """chunk_id, content_sha256, input_sha256, model_name, dimension, vector of chunks with title and category."""
    text = embedding_input(F.col("title"), F.col("category"), F.col("section"), F.col("text"))
    rows = made.select("chunk_id", "content_sha256", text.alias("_input"))
    return rows.select("chunk_id", "content_sha256", F.sha2("_input", 256).alias("input_sha256"), F.lit(encoder.name).alias("model_name"), F.lit(encoder.dimension()).alias("dimension"), encode(F.col("_input"), encoder).alias("vector"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def checked(vectors: DataFrame, column: str = "vector", unit: bool = True) -> DataFrame:
    """The rows, or an error if a vector isn't finite or (if asked) not of unit length."""
    n = norm(F.col(column))
    bad = F.exists(column, lambda x: F.isnan(x) | x.isNull()) | (F.abs(n - 1.0) > 1e-3 if unit else F.lit(False))
    return vectors.where(F.when(bad, F.raise_error(F.lit("a vector isn't finite or not of unit length")).cast("boolean")).otherwise(F.lit(True)))


def statistics(vectors: DataFrame, column: str = "vector") -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.min(norm(F.col(column))).alias("least_norm"), F.max(norm(F.col(column))).alias("largest_norm"))

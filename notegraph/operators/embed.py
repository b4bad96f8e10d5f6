"""Vectors for texts that have none, by an encoder that is a plain function of a list of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.sync import pending_embed

DIM, BATCH = 384, 32


def hashing_encoder(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A fixed stand-in for a model: each word counts at the place its md5 gives; unit length, or zeros without words."""
    out = np.zeros((len(texts), dim), np.float64)
    for row, text in zip(out, texts):
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            row[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dim] += 1
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def encode_texts(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = BATCH) -> DataFrame:
    """(key, vec array<float>): the vector of each text, `batch` of them a call. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), batch):
                b = big.slice(at, batch)
                x = np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=[key, "vec"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, vec array<float>")


def encode_missing(chunks: DataFrame, vectors: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashing_encoder) -> DataFrame:
    """(stripped_hash, vec) of the texts of chunks (path, seq, text, stripped_hash) without a vector, each hash once: rows to append to the vectors."""
    missing = pending_embed(chunks, vectors).withColumnRenamed("stripped_hash", "missing")
    texts = chunks.join(missing, F.col("stripped_hash") == F.col("missing"), "left_semi").groupBy("stripped_hash").agg(F.min("text").alias("text"))
    return encode_texts(texts, "stripped_hash", "text", encode)

"""Extraction and embedding behind interfaces: the model is the caller's, the dataflow is here."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from loamdex.functions import text as X

ROW = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,keywords:string,description:string>>"


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for an encoder: signed hashes of words, normalised."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_vectors, text: str = "text", prefix: str = "passage: ") -> DataFrame:
    """df with vector, by Arrow batches; the encoder is made once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder([prefix + (t or "") for t in s])), dtype=object)

    return df.withColumn("vector", vectors(text))


def capitalised(text: str) -> dict:
    """A rule extractor for tests: runs of capitalised words are concepts, neighbours are related."""
    import re

    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", text)))[:20]
    return {"entities": [{"name": n, "type": "concept", "description": ""} for n in names], "relationships": [{"source": a, "target": b, "keywords": "near", "description": ""} for a, b in zip(names, names[1:], strict=False)]}


def extract(chunks: DataFrame, extractor: Callable[[str], dict] = capitalised, pv: str = "1") -> DataFrame:
    """doc, idx, h, pv, entities, relationships of each chunk (doc, idx, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [extractor(t) for t in b["text"]]
            yield pd.DataFrame({"doc": b["doc"], "idx": b["idx"], "h": b["h"], "pv": pv, "entities": [g["entities"] for g in got], "relationships": [g["relationships"] for g in got]})

    rows = chunks.select("doc", "idx", X.chunk_hash("text").alias("h"), "text")
    return rows.mapInPandas(run, f"doc {chunks.schema['doc'].dataType.simpleString()}, idx int, h string, pv string, {ROW}")


def to_summarise(fragments: DataFrame, cache: DataFrame, least: int = 8) -> DataFrame:
    """Names with ``least`` descriptions or more whose summary is not cached (by key of name and fragments)."""
    key = F.sha1(F.concat_ws("\u0001", "name", F.array_join("descriptions", "\u0001")))
    return fragments.where(F.size("descriptions") >= least).withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def batches(chunks: DataFrame, size: int, order: str = "chunk_id") -> DataFrame:
    """Adds batch: consecutive rows of an order in groups of ``size``."""
    from loamdex.operators.index import dense_ids

    return dense_ids(chunks, order, "_i").withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")

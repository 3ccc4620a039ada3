"""Model-backed operators: opaque row functions behind Arrow-batched pandas UDFs, with deterministic
stand-ins for tests. Real models plug in through the same protocols."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, texts: list[str], n: int) -> list[list[str]]: ...


class HashingEncoder:
    """Sums hashed word vectors and normalises them; a text without words gets the first unit vector.
    All words of a text count."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v = int.from_bytes(h, "little")
                out[k, v % self.dim] += 1 if v >> 63 else -1
        n = np.linalg.norm(out, axis=1)
        out[n == 0, 0] = 1
        return out / np.where(n == 0, 1, n)[:, None]


def last_states(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of a batch of token states (texts x tokens x dimensions) the state of each text's last token, by the attention
    mask: the last place where all texts end there (padding on the left), else the last place that isn't padding."""
    if len(mask) and mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), np.maximum(mask.sum(1) - 1, 0)]


class PooledEncoder:
    """An encoder from ``model``, which maps a list of texts to (states, mask): states of the last tokens, of
    length one. Texts are taken ``batch`` at a time."""

    def __init__(self, model: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], batch: int = 128):
        self.model, self.batch = model, batch

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [last_states(*self.model(texts[s : s + self.batch])) for s in range(0, len(texts), self.batch)]
        v = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, 1))
        return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def best_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """What the last training state below ``folder`` (checkpoint-*/trainer_state.json, by name) calls the best
    checkpoint; None without any."""
    try:
        rows = spark.read.option("multiLine", True).schema("best_model_checkpoint string").json(f"{folder}/checkpoint-*/trainer_state.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.select("best_model_checkpoint", F.input_file_name().alias("f")).agg(F.max_by(F.coalesce("best_model_checkpoint", F.lit("")), "f").alias("best")).first()
    return last.best or None


class SpanGenerator:
    """Spans of words at fixed places of the text; none for a text without words."""

    def __init__(self, words: int = 6):
        self.words = words

    def __call__(self, texts: list[str], n: int) -> list[list[str]]:
        out = []
        for t in texts:
            w = t.split()
            starts = [len(w) * i // n for i in range(n)] if w else []
            out.append([" ".join(w[s : s + self.words]) for s in starts])
        return out


def encode(docs: DataFrame, key: str, text: str, encoder: Encoder, instruction: str = "") -> DataFrame:
    """(key, embedding ARRAY<FLOAT>); a null text is encoded as an empty one. ``instruction`` goes before
    each text. The encoder is built once for each task, not for each batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder([instruction + (t or "") for t in s]).astype(np.float32)))

    return docs.select(key, run(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))


def pseudo_queries(docs: DataFrame, keys: list[str], text: str, generator: Generator, n: int = 5) -> DataFrame:
    """(keys, pseudo_queries ARRAY<STRING>): ``n`` queries of each document. The generator sees the whole
    text; one with a bounded window has to go over it window by window."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(generator([t or "" for t in s], n))

    return docs.select(*keys, run(F.coalesce(F.col(text), F.lit(""))).alias("pseudo_queries"))


def tokenised(samples: DataFrame, tokenise, max_input: int = 512, max_output: int = 128) -> DataFrame:
    """(input_ids, attention_mask, labels) of (input, output); null texts are empty. ``tokenise`` maps a list of
    texts to lists of ids; lists are cut at the limits."""

    def batch(limit: int):
        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([ids[:limit] for ids in tokenise([t or "" for t in s])])

        return run

    ids = samples.select(batch(max_input)(F.coalesce("input", F.lit(""))).alias("input_ids"), batch(max_output)(F.coalesce("output", F.lit(""))).alias("labels"))
    return ids.select("input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), "labels")


def cached(spark, path: str, want: int, make, exact: bool) -> DataFrame:
    """The table at ``path`` if it can be used, else ``make()``, written there.

    exact: usable with ``want`` rows; else with at least as many, of which those with query_idx < ``want``
    are taken.
    """
    try:
        found = spark.read.parquet(path)
        n = found.count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        n = -1
    if n == want or (not exact and n > want):
        return found if exact or n == want else found.where(F.col("query_idx") < want)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Interfaces to outside models, with deterministic stand-ins that need no network.

A provider is called on batches inside the executors; it must be picklable. Failures of a provider are
its own to retry; `retrying` wraps one with attempts and a growing pause.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from http.client import IncompleteRead
from typing import Protocol
from urllib.error import HTTPError

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of texts, all of the same length."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class CountingEmbedder(Protocol):
    """Vectors and the tokens that were billed for all texts together, None if that is not reported."""

    def __call__(self, texts: list[str]) -> tuple[list[list[float]], int | None]: ...


class Generator(Protocol):
    """One text (or None) for each prompt."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class ChatModel(Protocol):
    """One answer (or None) for each list of messages, which are (role, content)."""

    def __call__(self, chats: list[list[tuple[str, str]]]) -> list[str | None]: ...


class HashedEmbedder:
    """Counts of hashed characters (white space left out): equal texts get equal vectors. For tests and offline runs."""

    def __init__(self, size: int = 32):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            a = np.frombuffer("".join(t.split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            slot = ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.size)
            out.append(np.bincount(slot.astype(np.int64), minlength=self.size).astype(float).tolist())
        return out


def retrying(provider: Callable, attempts: int = 3, pause: float = 1.0) -> Callable:
    """The provider with `attempts` tries; the pause doubles; the last error is raised. An answer with an HTTP error is raised at once."""

    def call(batch: list):
        wait = pause
        for k in range(attempts):
            try:
                return provider(batch)
            except HTTPError:
                raise
            except (OSError, TimeoutError, IncompleteRead):
                if k == attempts - 1:
                    raise
                time.sleep(wait)
                wait *= 2

    return call


def or_none(provider: Generator) -> Generator:
    """The provider, with None for null prompts and for a batch that fails."""

    def call(prompts: list[str | None]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        full = [i for i, p in enumerate(prompts) if p is not None]
        try:
            found = provider([prompts[i] for i in full]) if full else []
        except Exception:  # noqa: BLE001 - whatever a provider may raise
            return out
        for i, text in zip(full, found):
            out[i] = text
        return out

    return call


def chat_or_none(model: ChatModel) -> ChatModel:
    """The model, with None for a batch that fails."""

    def call(chats: list[list[tuple[str, str]]]) -> list[str | None]:
        try:
            return list(model(chats))
        except Exception:  # noqa: BLE001 - whatever a model may raise
            return [None] * len(chats)

    return call


def embed(df: DataFrame, text: str, out: str, provider: Embedder, batch: int = 10, failed_as_null: bool = False) -> DataFrame:
    """`df` with vectors; blank texts get null. failed_as_null: so do the texts of a batch whose provider fails."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            result: list[list[float] | None] = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for k in range(0, len(full), batch):
                part = full[k : k + batch]
                try:
                    vectors = provider([texts.iloc[i] for i in part])
                except Exception:  # noqa: BLE001 - whatever a provider may raise
                    if not failed_as_null:
                        raise
                    continue
                for i, v in zip(part, vectors):
                    result[i] = v
            yield pd.Series(result)

    return df.withColumn(out, run(F.col(text)))


def generate(df: DataFrame, prompt: str, out: str, provider: Generator, batch: int = 10) -> DataFrame:
    """`df` with the provider's texts; null where it gives none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            result: list[str | None] = []
            for k in range(0, len(prompts), batch):
                result += provider(prompts.iloc[k : k + batch].tolist())
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def embed_counting(df: DataFrame, text: str, out: str, tokens: str, provider: CountingEmbedder, batch: int = 10) -> DataFrame:
    """`df` with vectors and tokens, whose sum over any whole batches is the sum that was billed.

    The tokens of a batch stand at its first text; where the provider reports none, each text has its estimate."""

    @F.pandas_udf("vector array<double>, tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors: list[list[float] | None] = [None] * len(texts)
            used = [0] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for k in range(0, len(full), batch):
                part = full[k : k + batch]
                found, billed = provider([texts.iloc[i] for i in part])
                for i, v in zip(part, found):
                    vectors[i] = v
                    used[i] = token_estimate(texts.iloc[i]) if billed is None else 0
                if billed is not None:
                    used[part[0]] = billed
            yield pd.DataFrame({"vector": vectors, "tokens": used})

    return df.withColumn("__both", run(F.col(text))).withColumns({out: F.col("__both.vector"), tokens: F.col("__both.tokens")}).drop("__both")


def chat(df: DataFrame, messages: str, out: str, model: ChatModel, batch: int = 10) -> DataFrame:
    """`df` with the model's answers to `messages` (array of role and content); null where it gives none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for chats in batches:
            result: list[str | None] = []
            for k in range(0, len(chats), batch):
                result += model([[(m["role"], m["content"]) for m in c] for c in chats.iloc[k : k + batch]])
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(messages)))


def token_estimate(text: str) -> int:
    """Half the characters, at least one: used only where a provider reports no usage."""
    return max(1, len(text) // 2)

"""Embedding and reasoning connectors: batching, retries and a deterministic offline embedder."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..schema import EngineError


def backoff_ms(attempt: int, retry_after_s: float | None = None, first_ms: int = 500, most_ms: int = 30_000) -> int:
    """Wait before the next attempt: what the server asks for, else doubling, at most most_ms."""
    return int(retry_after_s * 1000) if retry_after_s is not None else min(first_ms * 2**attempt, most_ms)


def with_retries(call: Callable[[], Sequence], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Sequence:
    """call() again after an error that has `retry` true; its `retry_after` is honoured."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i + 1 == attempts or not getattr(e, "retry", False):
                raise
            sleep(backoff_ms(i, getattr(e, "retry_after", None)) / 1000)
    raise EngineError("PROVIDER_UNAVAILABLE")


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[Sequence[float]]], dimensions: int, batch: int = 32) -> DataFrame:
    """id, embedding at unit length, cut to `dimensions`. embed takes a batch of texts and returns
    their vectors in order, or mappings with `index` and `embedding` in any; it runs on the executors,
    `batch` texts a call, with retries."""

    def rows(batches):
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), batch):
                texts = pdf["content"].iloc[at : at + batch].fillna("").tolist()
                got = with_retries(lambda texts=texts: embed(texts))
                if got and isinstance(got[0], Mapping):
                    got = [g["embedding"] for g in sorted(got, key=lambda g: g["index"])]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} embeddings of {len(texts)} texts")
                out += [list(map(float, v)) for v in got]
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    raw = chunks.select("id", "content").mapInPandas(rows, "id string, embedding array<double>")
    return raw.select("id", V.truncate(F.col("embedding"), dimensions).cast("array<float>").alias("embedding"))


def hash_embedding(chunks: DataFrame, dimensions: int = 256) -> DataFrame:
    """id, embedding: signed token hashing, an offline stand-in for a model. All in the JVM."""
    words = chunks.select("id", F.explode_outer(X.tokens(F.col("content"))).alias("t"))
    h = F.xxhash64("t")
    slots = words.select("id", F.pmod(h, F.lit(dimensions)).cast("int").alias("s"), F.when(F.col("t").isNull(), 0.0).when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0).alias("v"))
    sums = slots.groupBy("id", "s").agg(F.sum("v").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("s", F.lit(0)).alias("s"), "v"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return sums.select("id", V.normalise(vector).cast("array<float>").alias("embedding"))


def ask(provider: Callable[[str], str], context: list[str], prompt: str, attempts: int = 3, delays: tuple[float, ...] = (1, 5, 15), sleep: Callable[[float], None] = time.sleep) -> str:
    """The provider's answer; a PermissionError fails at once, other errors after all attempts."""
    for i in range(attempts):
        try:
            return provider("\n\n".join([*context, prompt]))
        except PermissionError as e:
            raise EngineError("AUTH_INVALID", str(e)) from e
        except Exception as e:  # noqa: BLE001
            if i + 1 == attempts:
                raise EngineError("PROVIDER_UNAVAILABLE", str(e)) from e
            sleep(delays[min(i, len(delays) - 1)])
    raise EngineError("PROVIDER_UNAVAILABLE")

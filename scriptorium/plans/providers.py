"""External models as plain functions, with deterministic stand-ins.

A provider is called on workers, a batch at a time; an ``Embedder`` or
``Reranker`` that loads a model should do so on its first call and keep it.
The stand-ins need no model: they make every plan testable.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[list[tuple[str, str]]], list[float]]
Model = Callable[[str], str]
PageReader = Callable[[bytes], list[str]]
Detector = Callable[[str], str]

PASSAGE, QUERY = "passage: ", "query: "
BATCH = 128


def hashed(dim: int = 64) -> Embedder:
    """Word hashing into ``dim`` signed buckets, scaled to length 1."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return run


#: Embedders by the name that collections know them by.
REGISTRY: dict[str, Embedder] = {}


def register(name: str, embed: Embedder) -> None:
    REGISTRY[name] = embed


def resolved(name: str, dim: int) -> Embedder:
    """The registered embedder of a collection, tried on one text: vectors of another size than the stored ones are an error."""
    if name not in REGISTRY:
        raise LookupError(f"no embedder is registered as {name!r}")
    embed = REGISTRY[name]
    if (got := len(embed(["probe"])[0])) != dim:
        raise ValueError(f"{name!r} makes vectors of {got}, the collection has {dim}")
    return embed


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """A reranker: the share of a query's words that a text has."""
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs]


def no_pages(content: bytes) -> list[str]:
    raise NotImplementedError("no PDF reader is installed; give one as reader=")


def unknown(text: str) -> str:
    return "unknown"


def echo(prompt: str) -> str:
    """A model that answers with the last line of its prompt."""
    return prompt.strip().rsplit("\n", 1)[-1]


class Refused(Exception):
    """A call that the provider answered with an HTTP error ``status``."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


#: Statuses for which another call is of no use (bad request, no authority).
FINAL_STATUSES = (400, 401)


def retried(model: Model, times: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """Calls again after a failure, waiting ``wait`` longer each time; the last failure is raised, and a final one at once."""

    def run(prompt: str) -> str:
        for attempt in range(times):
            try:
                return model(prompt)
            except Exception as e:  # noqa: BLE001 - providers raise anything
                if attempt + 1 == times or getattr(e, "status", None) in FINAL_STATUSES:
                    raise
                sleep(wait * (attempt + 1))
        raise ValueError("times must be positive")

    return run


def embedded(text: Column, embed: Embedder, prefix: str = PASSAGE, batch: int = BATCH, lenient: bool = False) -> Column:
    """Vectors of a text column, ``batch`` texts a call.

    ``lenient``: a batch that fails is tried text by text, and a text that fails has null.
    """

    def vectors(texts: list[str]) -> list:
        try:
            return list(embed(texts))
        except Exception:  # noqa: BLE001 - becomes a null
            if not lenient:
                raise
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [v for i in range(0, len(texts), batch) for v in vectors([prefix + (t or "") for t in texts.iloc[i : i + batch]])]
            yield pd.Series(rows, index=texts.index, dtype=object)

    return run(text)


def reranked(query: Column, text: Column, rerank: Reranker) -> Column:
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(rerank(list(zip(queries, texts, strict=True))), index=texts.index, dtype=float)

    return run(query, text)


def answered(prompt: Column, model: Model) -> Column:
    """(answer, error) of a prompt column; a failure is an error, never an answer."""

    @F.pandas_udf("answer string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            try:
                out.append((model(p), None))
            except Exception as e:  # noqa: BLE001 - becomes a column
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["answer", "error"])

    return run(prompt)


def language(text: Column, detect: Detector = unknown) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return detect(t)
            except Exception:  # noqa: BLE001 - a failure is a value here
                return "unknown"

        return texts.map(one)

    return run(text)


def with_embeddings(chunks: DataFrame, embed: Embedder, name: str, text: str = "text", lenient: bool = False) -> DataFrame:
    """Chunks with their vector, its size and the model's name."""
    return chunks.withColumn("embedding", embedded(F.col(text), embed, lenient=lenient)).withColumn("embedding_dim", F.size("embedding")).withColumn("embedding_model", F.lit(name))

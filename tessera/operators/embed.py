"""Embedding of texts by a pluggable driver, each distinct text once."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship

#: Characters that a HashEmbedder hashes at once, about.
BLOCK = 1 << 17


class Driver(Protocol):
    """What a driver offers. ``embed`` gives a vector for each text, in order; ``generate`` is optional."""

    name: str

    def online(self) -> bool: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def generate(self, prompt: str) -> list[str]: ...


class HashEmbedder:
    """A deterministic stand-in without weights: signed hashes of character trigrams, unit length."""

    def __init__(self, dim: int = 64, name: str = "hash-trigram"):
        self.dim, self.name = dim, name

    def online(self) -> bool:
        return True

    def generate(self, prompt: str) -> list[str]:
        raise NotImplementedError("this driver only embeds")

    def embed(self, texts: list[str]) -> np.ndarray:
        out, lo, size = np.zeros((len(texts), self.dim), np.float32), 0, 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= BLOCK or hi == len(texts):
                self._block(texts[lo:hi], out[lo:hi])
                lo, size = hi, 0
        return out

    def _block(self, texts: list[str], out: np.ndarray) -> None:
        """Fills a row of ``out`` for each text; no trigram crosses a text's border."""
        framed = [f"\2{t.lower()}\3" for t in texts]
        c = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = np.array([len(t) for t in framed])
        with np.errstate(over="ignore"):
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        row, end = np.repeat(np.arange(len(n)), n)[:-2], np.cumsum(n)
        inside = np.arange(len(h)) + 2 < end[row]
        slot = row * self.dim + ((h >> np.uint64(40)) % np.uint64(self.dim)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        out[:] = np.bincount(slot[inside], sign[inside], len(n) * self.dim).reshape(len(n), self.dim)
        out /= np.array([[max(float(np.linalg.norm(x)), 1e-9)] for x in out], np.float32)


def embed(texts: DataFrame, driver: Driver, text: str = "text", out: str = "vector") -> DataFrame:
    """(text, vector) for each distinct text; the driver is loaded once by a worker, batches go through it."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(driver)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({text: b[text], out: list(shared.value.embed(b[text].tolist()))})

    return texts.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, `{out}` array<float>")


def with_vectors(rows: DataFrame, driver: Driver, text: str = "text", out: str = "vector") -> DataFrame:
    """``rows`` with the vector of each text."""
    return rows.join(embed(rows, driver, text, out), text, "left")

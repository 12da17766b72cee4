"""Vectors and matrices: dot products and cosine as expressions, the hashing encoder as a pandas UDF."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is empty or zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def features(text: str) -> list[tuple[str, float]]:
    """Weighted features: Chinese character n-grams, words and word pairs; a piece of the text itself where there are none."""
    flat = re.sub(r"\s+", " ", text.lower())
    han, words = "".join(re.findall(fixed.CJK, flat)), re.findall(r"[a-z0-9_./-]+", flat)
    named = [(f"c{n}", han[i : i + n]) for n in (1, 2, 3) for i in range(len(han) - n + 1)]
    named += [("w1", w) for w in words] + [("w2", f"{a}_{b}") for a, b in zip(words, words[1:], strict=False)]
    if not named and flat:
        named = [("raw", flat[:64])]
    return [(f"{kind}:{value}", fixed.FEATURE_WEIGHTS[kind]) for kind, value in named]


@functools.lru_cache(maxsize=1 << 17)
def _hashed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def hash_encode(texts: list[str], dimensions: int = 1024) -> np.ndarray:
    """Unit vectors of signed hashed features: BLAKE2b-64 gives place and sign."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        if found := features(text or ""):
            h = np.array([_hashed(name) for name, _ in found], np.uint64)
            weights = np.array([weight for _, weight in found], np.float32)
            np.add.at(row, (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(63), -weights, weights))  # one by one, in order
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def no_encode(texts: list[str]) -> np.ndarray:
    """The encoder that knows nothing: one zero per text."""
    return np.zeros((len(texts), 1), np.float32)


@functools.lru_cache(maxsize=8)
def _loaded(load: Callable[[], Callable]) -> Callable[[list[str]], np.ndarray]:
    """This worker's model of a plug-in: loaded once, at the first batch."""
    return load()


def register(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """Add an encoder. ``load()`` gives ``f(texts) -> rows`` and runs once on every worker; rows are made unit vectors."""

    def run(texts: list[str]) -> np.ndarray:
        rows = np.asarray(_loaded(load)(texts), np.float32).reshape(len(texts), -1)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(length == 0, 1, length)

    ENCODERS[name] = run


#: Encoders by name: ``f(texts) -> array of unit rows``. Others can be registered.
ENCODERS: dict[str, Callable[[list[str]], np.ndarray]] = {"none": no_encode, "hashing": hash_encode}


def encoder(name: str, dimensions: int = 1024) -> Callable[[list[str]], np.ndarray]:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; known are {sorted(ENCODERS)}")
    return (lambda texts: hash_encode(texts, dimensions)) if name == "hashing" else ENCODERS[name]


def encode(c: Column, name: str = "hashing", dimensions: int = 1024) -> Column:
    """Vectors of a column of texts, batch by batch."""
    chosen = encoder(name, dimensions)  # goes to the workers with the plan, so plug-ins need no registration there

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(chosen([x or "" for x in s])), index=s.index, dtype=object)

    return F.pandas_udf(run, "array<float>")(c)

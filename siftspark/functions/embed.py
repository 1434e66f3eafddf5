"""Hash embeddings: FNV-1a-64 of terms and character 3-grams, added into a vector of fixed length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SLICE, TERMINATORS, _tokenizer, split_sentences, tokenize_text

# The hash function's parameters and the weights of the features.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
TERM_WEIGHT, GRAM_WEIGHT, SHORT_WEIGHT, SECOND = 1.0, 0.4, 1.2, 0.35


def fnv1a64(words: list[bytes]) -> np.ndarray:
    """Hashes of all words at once: one step for each byte place over the words that reach it."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.full(len(words), FNV_OFFSET, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    at = np.cumsum(n) - n
    for k in range(int(n.max()) if len(words) else 0):
        own = np.flatnonzero(n > k)
        h[own] = (h[own] ^ data[at[own] + k]) * np.uint64(FNV_PRIME)
    return h


def _gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash of "g:" and the gram) of every run of three characters."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.maximum(chars - 2, 0)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(n.sum()) + np.repeat((np.cumsum(chars) - chars) - (np.cumsum(n) - n), n)
    at = np.append(lead, len(data))
    start, size = at[first], at[first + 3] - at[first]
    h = np.full(len(first), fnv1a64([b"g:"])[0], np.uint64)
    for k in range(int(size.max())):
        own = np.flatnonzero(size > k)
        h[own] = (h[own] ^ data[start[own] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return np.repeat(np.arange(len(texts)), n), h


def embed_texts(texts: list[str | None], dim: int, block: int = 2000) -> np.ndarray:
    """One unit vector a text; an empty or null text is the first axis."""
    if len(texts) > block:
        return np.concatenate([embed_texts(texts[i : i + block], dim) for i in range(0, len(texts), block)])
    run = _tokenizer()
    given = [x or "" for x in texts]
    tokens = [tokenize_text(x, run) for x in given]
    index: dict[str, int] = {}
    feat = np.array([index.setdefault("t:" + t, len(index)) for own in tokens for t, _, _ in own], np.int64)
    row = np.repeat(np.arange(len(given)), [len(own) for own in tokens])
    hashes = fnv1a64([k.encode() for k in index])[feat] if len(feat) else np.zeros(0, np.uint64)
    short = [i for i, x in enumerate(given) if 0 < len(x) < 3]
    gram_row, gram_hash = _gram_hashes(given)
    r = np.concatenate([row, gram_row, np.array(short, np.int64)])
    v = np.concatenate([hashes, gram_hash, fnv1a64([("raw:" + given[i]).encode() for i in short])])
    w = np.concatenate([np.full(len(row), TERM_WEIGHT), np.full(len(gram_row), GRAM_WEIGHT), np.full(len(short), SHORT_WEIGHT)])
    out = np.zeros((len(texts), dim))
    if len(r):
        w = np.where(v & np.uint64(1), -w, w)
        i = (v % np.uint64(dim)).astype(np.int64)
        j = ((v >> np.uint64(17)) % np.uint64(dim)).astype(np.int64)
        out += np.bincount(r * dim + i, w, out.size).reshape(out.shape)
        other = j != i
        out += np.bincount((r * dim + j)[other], (w * SECOND)[other], out.size).reshape(out.shape)
    out[[not x for x in texts], 0] = 1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(n > 0, out / np.where(n > 0, n, 1), out)


def hash_embed(text: Column, dim: int = 1024, kind: str = "float") -> Column:
    """The vector of each text, an array of float or, with ``kind`` double, of double."""

    @F.pandas_udf(f"array<{kind}>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            for lo in range(0, len(s), SLICE):
                yield pd.Series(list(embed_texts(s.iloc[lo : lo + SLICE].tolist(), dim).astype(np.float32 if kind == "float" else np.float64)))

    return run(text)


def hash_fnv(text: Column) -> Column:
    """FNV-1a-64 of a string as a signed long; null gives null."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        h = fnv1a64([(x or "").encode() for x in s]).view(np.int64)
        return pd.Series(h).where(s.notna().values, None).astype("Int64")

    return run(text)


def embed_sentences(text: Column, dim: int = 1024) -> Column:
    """array of (start, end, vector) of each sentence."""
    return F.arrow_udf(sentence_vectors(dim), "array<struct<start:int,end:int,vector:array<float>>>")(text)


def sentence_vectors(dim: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The sentences of each text with their vectors, SLICE sentences or one text at a time; a null has none."""

    def part(texts: list[str]) -> pa.Array:
        spans = [split_sentences(x) for x in texts]
        parts = [raw[a:b].decode() for raw, sp in zip((x.encode() for x in texts), spans) for a, b in sp]
        v = np.concatenate([np.zeros((0, dim), np.float32), *(embed_texts(parts[i : i + SLICE], dim).astype(np.float32) for i in range(0, len(parts), SLICE))])
        start, end = (pa.array([s[k] for sp in spans for s in sp], pa.int32()) for k in (0, 1))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel(), pa.float32()))
        at = np.append(0, np.cumsum([len(sp) for sp in spans])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([start, end, vectors], names=["start", "end", "vector"]))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in texts:
            own, held = [], 0
            for x in s.to_pylist():
                own.append(x or "")
                held += 1 + sum(own[-1].count(c) for c in TERMINATORS)
                if held >= SLICE:
                    yield part(own)
                    own, held = [], 0
            if own:
                yield part(own)

    return run


class Embedder(Protocol):
    """Gives a text column's vectors; ``space`` names the space in which they compare."""

    space: str
    dim: int

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    def __init__(self, dim: int = 1024):
        self.dim, self.space = dim, "text-hash"

    def embed(self, text: Column) -> Column:
        return hash_embed(text, self.dim)


class FunctionEmbedder:
    """An embedder from a function of a list of texts, for a remote or local model."""

    def __init__(self, f: Callable[[list[str]], list[list[float]]], dim: int, space: str):
        self.f, self.dim, self.space = f, dim, space

    def embed(self, text: Column) -> Column:
        f, dim = self.f, self.dim

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            out = []
            for v in f([x or "" for x in s]):
                v = np.asarray(v, np.float64)
                v = v[:dim] if len(v) >= dim else np.concatenate([v, 0.15 * np.resize(v, dim)[len(v):]]) if len(v) else np.eye(1, dim)[0]
                out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32))
            return pd.Series(out)

        return run(text)


class BudgetedEmbedder:
    """An embedder that costs, and one that doesn't, which stands in while ``allowed()`` is false.

    It is asked for each batch of texts before it is embedded; ``space`` names the space of the last answer, so a caller can
    tell vectors of one from those of the other, which don't compare.
    """

    def __init__(self, paid: Embedder, free: Embedder, allowed: Callable[[], bool]):
        if paid.dim != free.dim:
            raise ValueError("both embedders must have one dimension")
        self.paid, self.free, self.allowed, self.dim, self.space = paid, free, allowed, paid.dim, paid.space

    def embed(self, text: Column) -> Column:
        own = self.paid if self.allowed() else self.free
        self.space = own.space
        return own.embed(text)

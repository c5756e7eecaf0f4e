"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words and the shapes of words and lines (case, digits, symbols, repetition). A truncated singular value decomposition of the labelled
sample's weighted term counts gives the latent space. The labelled vectors, at most ``sample_rows``, are broadcast; every
document's cosines to all of them are exact, computed in blocks; the nearest vote, weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm import labelled
from touchline.llm.common import parts, slices, text_bytes

WORDS, SHAPES, FACTS = 3072, 896, 128
TERMS = WORDS + SHAPES + FACTS
LATENT = 48
NEIGHBOURS = 25
THRESHOLD = 0.7
CACHE = 200_000
#: A word's shape: each byte's kind, runs made one.
KINDS = bytes.maketrans(
    bytes(range(256)),
    bytes(ord("x") if 97 <= c < 123 or c >= 128 else ord("X") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else c if 33 <= c < 127 else 32 for c in range(256)),
)
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _terms(word: bytes) -> tuple[int, int]:
    shape = RUNS.sub(rb"\1", word.translate(KINDS))[:8]
    return zlib.crc32(word.lower()) % WORDS, WORDS + zlib.crc32(shape) % SHAPES


class _Terms(dict):
    """word -> packed pair of its terms; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        a, b = _terms(word)
        out = self[word] = a << 16 | b
        return out


def _facts(n: int, distinct: int, most: int, text: bytes) -> list[int]:
    """Terms for whole-text properties in eight steps each: distinct words, repeated lines, length, words a line, bytes a word."""
    lines = text.split(b"\n")
    step = lambda x: int(min(7, max(0, x)))
    values = (
        step(8 * distinct / max(1, n)), step(8 * (1 - len(set(lines)) / len(lines))), step(np.log2(n + 1) - 3),
        step(np.log2(max(1, n / len(lines)))), step(len(text) / max(1, n) / 2), step(0 if not n else 8 * most / n),
    )
    return [WORDS + SHAPES + 8 * i + v for i, v in enumerate(values)]


def counted(texts: list[bytes], cache: _Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, term, count)."""
    rows, terms, counts = [], [], []
    for i, text in enumerate(texts):
        sums, seen, n = np.zeros(TERMS, dtype=np.int64), Counter(), 0
        for words in parts(text):
            pair = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
            sums += np.bincount(pair >> 16, minlength=TERMS) + np.bincount(pair & 65535, minlength=TERMS)
            seen.update(words)
            n += len(words)
        sums += np.bincount(_facts(n, len(seen), max(seen.values(), default=0), text), minlength=TERMS)
        own = np.flatnonzero(sums)
        rows.append(np.full(len(own), i, dtype=np.int64))
        terms.append(own)
        counts.append(sums[own])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(counts)


def weighted(row: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of sparse rows: 1 + log of the count, times idf, with words, shapes and facts each of length 1."""
    weight = (1 + np.log(n)) * idf[term]
    group = row * 3 + np.searchsorted([WORDS, WORDS + SHAPES], term, side="right")
    norm = np.sqrt(np.bincount(group, weights=weight * weight))
    return weight / norm[group]


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x latent
    vectors: np.ndarray  # labelled documents x latent, of length 1
    labels: np.ndarray
    prior: float


def latent(texts: list[bytes], idf: np.ndarray, basis: np.ndarray, cache: _Terms) -> np.ndarray:
    """Latent vectors of length 1 (zero where a text has no known term)."""
    row, term, n = counted(texts, cache)
    out = np.zeros((len(texts), basis.shape[1]), dtype=np.float32)
    if len(row):
        weight = weighted(row, term, n, idf)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for at in range(0, len(first), 32):  # few at a time: terms x latent values each
            a, b = first[at], first[at + 32] if at + 32 < len(first) else len(row)
            out[row[first[at : at + 32]]] = np.add.reduceat(basis[term[a:b]] * weight[a:b, None].astype(np.float32), first[at : at + 32] - a, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def term_counts(texts: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Sparse rows (row, term, count) of 256 texts at a time, and their labels, from rows of t and y without repeated texts of one label.

    Terms are counted in the tasks, so the driver holds at most TERMS numbers a text, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Terms()
        for batch in batches:
            terms, counts = [], []
            for part in slices(batch.column(0)):
                row, term, n = counted(part, cache)
                at = np.searchsorted(row, np.arange(len(part) + 1))
                terms += [term[a:b] for a, b in zip(at, at[1:], strict=False)]
                counts += [n[a:b] for a, b in zip(at, at[1:], strict=False)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(terms, kind), pa.array(counts, kind)], names=["y", "place", "terms", "counts"])

    # One partition, as they were ordered and limited; repeated texts follow each other by digest only, so they are dropped by it.
    rows = texts.select("t", "y", F.struct(F.xxhash64("t"), F.md5("t")).cast("string").alias("place"))
    got = rows.mapInArrow(run, "y int, place string, terms array<int>, counts array<int>").toArrow().combine_chunks()
    keys = list(zip(got.column("place").to_pylist(), got.column("y").to_pylist(), strict=True))
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    keep = sorted(first.values())
    got = got.take(pa.array(keep, pa.int64()))
    sparse = []
    for at in range(0, len(keep), 256):
        own = got.slice(at, 256)
        terms = [np.array(x, dtype=np.int64) for x in own.column("terms").to_pylist()]
        n = [np.array(x, dtype=np.int64) for x in own.column("counts").to_pylist()]
        sparse.append((np.repeat(np.arange(len(terms)), [len(x) for x in terms]), np.concatenate(terms), np.concatenate(n)))
    return sparse, np.array(got.column("y").to_pylist(), dtype=np.float32)


def fit(sparse: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """A model from term counts and labels; without rows every score is one half."""
    seen = sum((np.bincount(term, minlength=TERMS) for _, term, _ in sparse), np.zeros(TERMS))
    idf = np.log((1 + len(y)) / (1 + seen)) + 1
    dense = np.zeros((len(y), TERMS), dtype=np.float32)
    for i, (row, term, n) in enumerate(sparse):
        dense[row + 256 * i, term] = weighted(row, term, n, idf)
    basis = _top_vectors(dense)
    vectors = dense @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, vectors, y, float(y.mean()) if len(y) else 0.5)


def _top_vectors(dense: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The first LATENT right singular vectors, by subspace iteration from a fixed start: no matrix of rows by rows or terms by terms."""
    k = min(LATENT + 16, *dense.shape)
    if not k:
        return np.zeros((dense.shape[1], 0), dtype=np.float32)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(dense.shape[1], k)))[0].astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(dense.T @ (dense @ q))[0]
    _, size, turn = np.linalg.svd(dense @ q, full_matrices=False)
    keep = size[:LATENT] > 1e-4
    return (q @ turn.T[:, :LATENT])[:, keep].astype(np.float32)


def vote(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity to the fourth power; one prior vote of weight 0.02."""
    k = min(neighbours, len(model.labels))
    if not k:
        return np.full(len(vectors), model.prior)
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), 1024):
        # Rounded, so that equal texts score alike whatever block they are in.
        cos = np.round(vectors[at : at + 1024].astype(np.float64) @ model.vectors.T.astype(np.float64), 10)
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0.0) ** 4
        out[at : at + 1024] = ((w * model.labels[near]).sum(1) + 0.02 * model.prior) / (w.sum(1) + 0.02)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    return fit(*term_counts(labelled.picked(docs, labels, "quality", rows=sample_rows)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score (0 to 1) of a text column. Null and empty texts are scored by their whole-text properties."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = shared.value, _Terms()
        for array in texts:
            votes = [vote(own, latent(part, own.idf, own.basis, cache)) for part in slices(array)]
            yield pa.array(np.concatenate(votes) if votes else np.zeros(0), pa.float64())

    return scored(text_bytes(text_col))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Repeated rows stay; an empty table gives no rows; without labels every score is one half."""
    model = fit_quality(docs, labels, sample_rows=sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), labelled.held_out(id_col).alias("held_out"), score(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = 4000) -> DataFrame:
    """docs whose score reaches the threshold, in the same columns.

    Null and empty texts are scored by their whole-text properties, and stay or go by that; scores that equal the threshold stay; repeated rows stay or go together;
    columns of any name pass; an empty table gives no rows; without labels every score is one half, so none reaches the threshold as given.
    """
    return docs.filter(score(docs, fit_quality(docs, labels, sample_rows=sample_rows), text_col) >= threshold)

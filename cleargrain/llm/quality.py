"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

The terms of a document are its words and pairs of neighbouring words, hashed, and beside them trigrams of its character classes
(letters, digits, each punctuation sign, breaks; runs of letters drawn together) and how often words and lines repeat. They are
weighted by tf-idf and projected by a truncated singular value decomposition fitted on a bounded sample of labelled rows. The
labelled vectors are broadcast; each block of documents takes its exact cosine products with all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import share, shared, small_batches, split_of
from cleargrain.llm.langid import labelled_texts, sample_rows
from cleargrain.llm.ngram_join import Shingler, mix

#: Powers of two.
WORD_CELLS, CLASS_CELLS = 8192, 2048
REPEAT_BINS = 8
DIMENSION = WORD_CELLS + CLASS_CELLS + 3 * REPEAT_BINS
#: Shares of a document's length in the space that words, character classes and repeats take.
WORD_PART, CLASS_PART, REPEAT_PART = 0.35, 0.5, 0.15
BLOCK = 256


def _classes() -> np.ndarray:
    """Byte to class: 1 small or non-ASCII letters, 2 capitals, 3 digits, 4 spaces, 5 breaks, then each sign its own."""
    table = np.arange(256, dtype=np.int64) + 8
    table[128:] = 1
    for first, last, value in (("a", "z", 1), ("A", "Z", 2), ("0", "9", 3)):
        table[ord(first) : ord(last) + 1] = value
    table[[9, 32]] = 4
    table[[10, 11, 12, 13]] = 5
    return table


CLASSES = _classes()


def repeat_shares(text: str) -> list[float]:
    """Shares of words that equal the one before, that are not the first of their kind, and of repeated lines."""
    words = text.lower().split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    same = sum(map(eq, words, words[1:])) / n
    # vocabulary grows like the square root of the length, so long texts repeat words by nature
    return [same, 1 - min(1.0, len(set(words)) / (n**0.8)), 1 - len(set(lines)) / max(1, len(lines))]


def term_weights(text: str | None, shingler: Shingler) -> np.ndarray:
    """Weights of a document's terms before idf: square roots of their shares among the words and pairs, and among the class
    trigrams, and one-hot bins of the repeat shares. Each part's squares sum to its share of the length."""
    out = np.zeros(DIMENSION, dtype=np.float32)
    words = shingler.words(text)
    if not len(words):
        return out
    terms = np.concatenate((words, mix(words[:-1] * np.uint64(3) + words[1:])))
    out[:WORD_CELLS] = np.sqrt(WORD_PART * np.bincount((terms & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=WORD_CELLS) / len(terms))
    c = CLASSES[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != c[:-1]) | (c[1:] > 2)
    c = np.concatenate(([0, 0], c[keep], [0]))
    code = (c[:-2] * 40503 + c[1:-1] * 10007 + c[2:] * 101) & (CLASS_CELLS - 1)
    at = WORD_CELLS + CLASS_CELLS
    out[WORD_CELLS:at] = np.sqrt(CLASS_PART * np.bincount(code, minlength=CLASS_CELLS) / len(code))
    for k, share in enumerate(repeat_shares(text)):
        out[at + k * REPEAT_BINS + min(REPEAT_BINS - 1, int(share * REPEAT_BINS))] = (REPEAT_PART / 3) ** 0.5
    return out


class Lines:
    """Sparse rows of term weights, made dense a block at a time: no more than BLOCK rows of full width are ever held."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.rows = [(np.frombuffer(t, dtype=np.int16), np.frombuffer(w, dtype=np.float16)) for t, w in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def blocks(self) -> Iterator[np.ndarray]:
        for i in range(0, len(self.rows), BLOCK):
            part = self.rows[i : i + BLOCK]
            dense = np.zeros((len(part), DIMENSION), np.float32)
            for line, (at, weights) in zip(dense, part):
                line[at] = weights
            yield dense

    def counts(self) -> np.ndarray:
        """Rows that hold each term."""
        out = np.zeros(DIMENSION, dtype=np.int64)
        for at, weights in self.rows:
            out[at[weights != 0]] += 1
        return out


def latent_axes(lines: Lines, idf: np.ndarray, rank: int, seed: int, turns: int = 6) -> np.ndarray:
    """The leading right singular vectors of the weighted rows, by subspace iteration with room for half as many more."""
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((DIMENSION, rank + rank // 2)).astype(np.float32)
    for _ in range(turns):
        total = np.zeros_like(basis)
        for block in lines.blocks():
            block *= idf
            total += block.T @ (block @ basis)
        basis, _ = np.linalg.qr(total)
    _, _, axes = np.linalg.svd(np.vstack([(block * idf) @ basis for block in lines.blocks()]), full_matrices=False)
    return (basis @ axes.T)[:, :rank].astype(np.float32)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    components: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, weighted: np.ndarray) -> np.ndarray:
        latent = weighted @ (self.idf[:, None] * self.components)
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 1e-9)

    def vote(self, weighted: np.ndarray, k: int) -> np.ndarray:
        """Share of label 1 among the k most similar labelled rows, weighted by similarity (cosines below 0 count as 0)."""
        if not len(self.labels):
            return np.full(len(weighted), self.prior)
        cosine = self.project(weighted) @ self.vectors.T
        k = min(k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0)
        total = weight.sum(axis=1)
        score = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, score, self.prior), 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, rank: int = 48, seed: int = 7) -> NeighbourModel:
    """Fit on about max_labelled labelled rows whose crc32(doc_id) mod 5 is not 0; null labels and texts don't count."""
    usable = labels.select("doc_id", F.col("quality").alias("label")).where(F.col("label").isNotNull() & (split_of(F.col("doc_id"), 5) != 0))
    chosen = sample_rows(usable, max_labelled, seed, "doc_id")  # bounded, so it may be broadcast
    train = labelled_texts(docs, chosen).select("text", "label")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                w = term_weights(text, shingler)
                at = np.flatnonzero(w)
                yield pd.DataFrame({"key": [zlib.crc32(text.encode("utf-8", "replace"))], "label": [int(label)], "terms": [at.astype(np.int16).tobytes()], "weights": [w[at].astype(np.float16).tobytes()]})

    rows = sorted(train.mapInPandas(weigh, "key long, label int, terms binary, weights binary").collect())  # about max_labelled rows
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    lines = Lines([(r["terms"], r["weights"]) for r in rows])
    idf = np.log((1 + len(lines)) / (1 + lines.counts())).astype(np.float32) + 1
    rank = min(rank, max(1, len(lines)))
    axes = latent_axes(lines, idf, rank, seed) if len(lines) else np.zeros((DIMENSION, rank), np.float32)
    model = NeighbourModel(idf, axes, np.zeros((0, rank), np.float32), y, float(y.mean()) if len(y) else 0.5)
    if len(lines):
        model.vectors = np.vstack([model.project(block) for block in lines.blocks()])
    return model


def with_quality(docs: DataFrame, model: NeighbourModel, k: int = 15, name: str = "score") -> DataFrame:
    """docs and a score (0 to 1, higher: better) of each whole text.

    Null or empty text, or nothing learned: the share of label 1 among the labelled rows (0.5 without any).
    Ties among neighbours fall as the labelled rows stand. Repeated rows repeat; other columns stay as they are.
    """
    small_batches(docs)
    held = share(docs, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, shingler = shared(held), Shingler()
        for batch in batches:
            texts, out = list(batch), []
            for i in range(0, len(texts), BLOCK):
                out.append(own.vote(np.vstack([term_weights(t, shingler) for t in texts[i : i + BLOCK]]), k))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score("text"))


def score_quality(docs: DataFrame, model: NeighbourModel, k: int = 15) -> DataFrame:
    """doc_id and score: one row per document, as with_quality() finds them."""
    return with_quality(docs.select("doc_id", "text"), model, k).select("doc_id", "score")

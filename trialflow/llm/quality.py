"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are the shapes of a text: trigrams of character classes, repeats of words and of
lines. Weighted term counts of a bounded labelled sample give a truncated SVD; the labelled vectors are
broadcast (bounded by ``SAMPLE``) and every document's exact cosine products with all of
them are computed block by block. The most similar neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.llm.text import _SPACE, chunks, encoded, word_hashes

#: most labelled rows of each label that a fit uses; bounds the broadcast to SAMPLE * RANK * 16 bytes
SAMPLE = 1000
RANK, NEIGHBOURS, SHARPNESS = 48, 25, 8
_CLASSES = 16
_REPEATS = 8
TERMS = _CLASSES**3 + 4 * _REPEATS


def _classes() -> np.ndarray:
    """Character class of every byte: space, line end, digit, lower, upper, other bytes, common marks."""
    out = np.full(256, 15, np.uint16)
    out[128:] = 4
    for code, chars in enumerate((" \t", "\n\r", "0123456789", "abcdefghijklmnopqrstuvwxyz"), 0):
        out[[ord(c) for c in chars]] = code
    out[65:91] = 5
    for code, chars in enumerate((".", ",;:", "!?", "|", "#*", "$%&", "\"'()", "<>/=", "_-"), 6):
        out[[ord(c) for c in chars]] = code
    return out


_CLASS = _classes()


def _bucketed(share: float) -> int:
    return min(_REPEATS - 1, int(share * _REPEATS))


def term_counts(texts: list[bytes]) -> np.ndarray:
    """One row of term weights per text (before inverse document frequency), float32."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words, counts = word_hashes(texts)
    at = 0
    for i, (t, n) in enumerate(zip(texts, counts, strict=True)):
        c = _CLASS[np.frombuffer(t, np.uint8)]
        if len(c) > 2:
            # a run of one class counts once, so that word length does not matter
            c = c[np.concatenate([[True], c[1:] != c[:-1]])]
        if len(c) > 2:
            grams = np.bincount(c[:-2] * (_CLASSES * _CLASSES) + c[1:-1] * _CLASSES + c[2:], minlength=_CLASSES**3)
            out[i, : _CLASSES**3] = np.sqrt(grams / grams.sum())
        w = words[at : at + n]
        at += n
        if n:
            base = _CLASSES**3
            same = np.mean(w[1:] == w[:-1]) if n > 1 else 0.0
            lines = [x for x in t.split(b"\n") if x.strip()]
            upper = np.frombuffer(t, np.uint8)
            letters = max(1, int(np.count_nonzero(~_SPACE[upper])))
            caps = np.count_nonzero((upper >= 65) & (upper < 91)) / letters
            for k, share in enumerate((same, 1 - len(set(lines)) / max(1, len(lines)), caps, 1 - len(np.unique(w)) / n)):
                # a share lights its step and all below, so near shares stay near
                out[i, base + k * _REPEATS : base + k * _REPEATS + _bucketed(share)] = 0.5
                out[i, base + k * _REPEATS] = share
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    #: labelled rows that one sampled row of label 0 and of label 1 stands for
    weights: tuple = (1.0, 1.0)

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.idf) @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        x = self.project(counts)
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), 256):
            products = x[i : i + 256] @ self.vectors.T
            near = np.argpartition(-products, k - 1, axis=1)[:, :k] if k else np.zeros((len(products), 0), int)
            weight = np.clip(np.take_along_axis(products, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
            # labels were drawn to equal numbers: undo that by weighing them with their true shares
            label = self.labels[near]
            weight *= np.where(label == 1, self.weights[1], self.weights[0])
            total = weight.sum(axis=1)
            some = total > 0
            out[i : i + 256][some] = (weight * label).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def sample(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Up to ``most`` labelled documents of each label, by seeded hash: doc_id, text, label.

    ``labelled`` has doc_id and label; rows with nulls in either are left out.
    """
    rows = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["doc_id"])
    order = F.xxhash64(F.lit(7), "doc_id")
    chosen = rows.where("label = 1").orderBy(order, "doc_id").limit(most).unionByName(rows.where("label = 0").orderBy(order, "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def leading_axes(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by seeded subspace iteration."""
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :rank]).astype(np.float32)


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE, rank: int = RANK) -> Model:
    """Fit on a bounded sample of the labelled rows (``most`` of each label)."""

    def run(batches):
        for pdf in batches:
            raw = encoded(pdf["text"])
            for i, j in chunks(raw):
                counts = term_counts(raw[i:j])
                yield pd.DataFrame({"doc_id": pdf["doc_id"][i:j], "label": pdf["label"][i:j], "terms": [c.tobytes() for c in counts]})

    got = sample(docs, labelled, most).mapInPandas(run, "doc_id bigint, label int, terms binary")
    got = got.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    shares = {r[0]: r[1] for r in labelled.where("doc_id IS NOT NULL").groupBy(F.col("label").cast("int")).count().collect()}
    if not len(got):
        none = np.zeros((0, 1), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), none, np.zeros(0, np.int8), 0.5)
    counts = np.frombuffer(b"".join(got["terms"]), np.float32).reshape(len(got), TERMS)
    labels = got["label"].to_numpy(np.int8)
    idf = np.log1p(len(counts) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    x = counts * idf
    axes = leading_axes(x, rank)
    ones, zeros = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    total1, total0 = shares.get(1, 0), shares.get(0, 0)
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labels, total1 / max(1, total1 + total0))
    model.weights = (total0 / zeros, total1 / ones)
    model.vectors = model.project(counts)
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each document's whole text.

    Null and empty texts, and texts without any known term, get the share of label 1 among
    the labels. Without labels every score is 0.5. Rows stand for themselves, repeated or
    not; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            raw = encoded(pdf["text"])
            scores = [held.value.vote(term_counts(raw[i:j])) for i, j in chunks(raw)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.concatenate(scores) if scores else []})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, "doc_id bigint, score double")


def of_quality(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """All columns of the documents whose score is at least ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        raw = encoded(texts)
        got = [held.value.vote(term_counts(raw[i:j])) for i, j in chunks(raw)]
        return pd.Series(np.concatenate(got) if got else [])

    return docs.where(score(F.col("text").cast("string")) >= least)

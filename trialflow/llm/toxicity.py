"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of ``LENGTH`` characters, gaps
weighted down by ``DECAY``, and is normalised, so gapped spellings and inserted characters
keep most of it. Landmarks are words of the sample that tell the labels apart, and words
of clean texts that come nearest to them; the inverse root of the landmarks' own kernel
turns kernel values into features of a linear support vector machine. Sentences inherit
their document's label and stand for themselves by their highest word; of a toxic document
the highest sentence is the example, of a clean one every sentence. A document scores as
its highest sentence, calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.llm.quality import sample
from trialflow.session import materialized

#: most labelled documents of each label in a fit
SAMPLE = 3000
LANDMARKS = 64
LENGTH, DECAY = 4, 0.6
#: kernel values below this count as none; a word needs that share of a landmark's letters
FLOOR, SHARED = 0.2, 0.5
#: longer words are read in overlapping pieces
PIECE = 24
#: marks of a word's first and last edge; no letters
EDGES = "^_"
#: words a task keeps the values of
KNOWN_WORDS = 400_000
#: odds of a landmark's sentences under label 1 against label 0, at least
LIFT = 4
SENTENCE_END = r"[.!?]+\s+|\n"
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def pieces(word: str) -> list[str]:
    """The letters of a word between edge marks, none for short words; long ones in halves that overlap.

    Edge marks are characters like others, so words that begin or end alike come nearer
    than words that hold the same letters further inside.
    """
    w = word if word.isalpha() else _NOT_LETTERS.sub("", word)
    if len(w) < LENGTH:
        return []
    w = EDGES[0] + w + EDGES[1]
    if len(w) <= PIECE + 2:
        return [w]
    return [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words), default=0)
    flat = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.int32).reshape(len(words), width)


def _width(codes: np.ndarray) -> int:
    return int((codes != 0).any(axis=0).sum())


def _kernel_of_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of the words in equal rows of two code tables; padding (0) matches nothing."""
    if len(a) > 2048:
        return np.concatenate([_kernel_of_codes(a[i : i + 2048], b[i : i + 2048]) for i in range(0, len(a), 2048)])
    a, b = a[:, : _width(a)], b[:, : _width(b)]
    n, width = len(a), b.shape[1]
    out = np.zeros(n, np.float32)
    d = np.float32(DECAY)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    # held[i][t]: weighted matches of i characters up to the present one of a and the t-th of b
    held = [np.ones((width + 1, n), np.float32)] + [np.zeros((width + 1, n), np.float32) for _ in range(LENGTH - 1)]
    for x in a:
        same = ((x == b) & (x != 0)) * (d * d)
        out += (same * held[LENGTH - 1][:width]).sum(axis=0)
        for i in range(LENGTH - 1, 0, -1):
            gained = same * held[i - 1][:width]
            for t in range(1, width):
                gained[t] += d * gained[t - 1]
            held[i] *= d
            held[i][1:] += gained
    return out


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of the words of equal position, not normalised."""
    return _kernel_of_codes(_codes(left), _codes(right))


def normalised(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel of the words of equal position."""
    return kernel(left, right) / np.sqrt(np.maximum(kernel(left, left) * kernel(right, right), 1e-30))


def _letters(words: list[str]) -> np.ndarray:
    """Letter counts folded into 32 columns, without edges."""
    codes = _codes([w.strip(EDGES) for w in words])
    flat = np.arange(len(words))[:, None] * 32 + codes % 32
    return np.bincount(flat[codes != 0], minlength=len(words) * 32).reshape(len(words), 32).astype(np.uint8)


@dataclass
class Model:
    landmarks: list
    #: so many landmarks from the first speak for label 1
    positive: int
    weights: np.ndarray
    bias: float
    scale: tuple

    def word_values(self, words: list[str]) -> dict[str, np.ndarray]:
        """Normalised kernel with every landmark, for the words near one that speaks for label 1."""
        parts = [(w, p) for w in words for p in pieces(w)]
        parts.sort(key=lambda x: len(x[1]))
        marks, mark_codes = _letters(self.landmarks), _codes(self.landmarks)
        mark_own = kernel(self.landmarks, self.landmarks)
        need = np.maximum(LENGTH, np.ceil(SHARED * marks.sum(axis=1, dtype=int)))
        out: dict[str, np.ndarray] = {}
        for i in range(0, len(parts), 8192):
            part = parts[i : i + 8192]
            names = [p for _, p in part]
            letters, codes = _letters(names), _codes(names)
            values = np.zeros((len(part), len(self.landmarks)), np.float32)
            for some in (range(self.positive), range(self.positive, len(self.landmarks))):
                rows, cols = [], []
                hot = np.arange(len(part)) if some.start == 0 else np.flatnonzero(values.any(axis=1))
                for j in some:
                    used = np.flatnonzero(marks[j])
                    near = hot[np.minimum(letters[hot][:, used], marks[j, used]).sum(axis=1, dtype=np.uint8) >= need[j]]
                    rows.append(near)
                    cols.append(np.full(len(near), j))
                rows, cols = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols))
                used, at = np.unique(rows, return_inverse=True)
                own = _kernel_of_codes(codes[used], codes[used])
                got = _kernel_of_codes(codes[rows], mark_codes[cols])
                got /= np.sqrt(np.maximum(own[at] * mark_own[cols], 1e-30))
                keep = got >= FLOOR
                values[rows[keep], cols[keep]] = got[keep]
            for k in np.flatnonzero(values.any(axis=1)):
                w = part[k][0]
                out[w] = np.maximum(out[w], values[k]) if w in out else values[k]
        return out

    def gains(self, words: list[str]) -> dict[str, float]:
        """What each word adds to the bias; words that add nothing are left out."""
        return {w: g for w, v in self.word_values(words).items() if (g := float(v @ self.weights)) > 0}

    def probability(self, gain: np.ndarray) -> np.ndarray:
        slope, offset = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * (gain + self.bias) + offset, -30, 30)))


def words_of(text: str) -> set[str]:
    """Distinct words of a text in lower case; runs of single characters also count as one word."""
    text = text.lower()
    words = set(text.split())
    if _SPACED.search(text):
        words.update("".join(m.split()) for m in _SPACED.findall(text))
    return words


class Reader:
    """Scores of whole texts, with a bounded memory of words already judged."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def gains(self, texts: list[str]) -> np.ndarray:
        known, out = self.known, np.zeros(len(texts))
        for i in range(0, len(texts), 128):
            each = [words_of(t) for t in texts[i : i + 128]]
            new = [w for w in set().union(*each) if w not in known]
            if len(known) > KNOWN_WORDS:
                known.clear()
                new = list(set().union(*each))
            known.update(dict.fromkeys(new, 0.0))
            known.update(self.model.gains(new))
            # the empty sentence gains nothing, and words against label 1 take nothing away
            out[i : i + 128] = [max(map(known.__getitem__, words), default=0.0) for words in each]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.model.probability(self.gains(texts))


def _words(column: str):
    return F.array_distinct(F.transform(F.split(F.lower(column), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")))


def _landmarks(rows: DataFrame, most: int) -> list[str]:
    """Words that speak for label 1, by the distinct sentences that hold them.

    Sentences that copies share count once, or the words of a copied document would look
    like insults. A word counts if its likelihood ratio against "no more frequent under
    label 1" stands out among all words tried, and its odds are ``LIFT`` times higher.
    """
    parts = rows.select("label", F.explode(F.split(F.lower("text"), SENTENCE_END)).alias("text"))
    parts = parts.groupBy("label", F.xxhash64("text")).agg(F.min("text").alias("text"))
    held = parts.select("label", F.explode(_words("text")).alias("w")).where(F.length("w").between(LENGTH, PIECE))
    seen = materialized(held.groupBy("w").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    sizes = parts.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = max(1, sizes[0] or 0), max(1, sizes[1] or 0)
    share = n1 / (n1 + n0)
    pos, neg, both = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    ratio = 2 * (pos * F.log(pos / (both * share)) + F.when(neg > 0, neg * F.log(neg / (both * (1 - share)))).otherwise(0.0))
    lift = (pos + 0.5) / (n1 + 1.0) / ((neg + 0.5) / (n0 + 1.0))
    top = seen.where("pos >= 2").select("w", ratio.alias("g"), lift.alias("lift"))
    top = top.where((F.col("g") > 2 * math.log(max(2, seen.count()))) & (F.col("lift") > LIFT)).orderBy(F.col("g").desc(), "w").limit(most)
    return [EDGES[0] + r["w"] + EDGES[1] for r in top.collect()]


def _against(rows: DataFrame, positive: list[str], most: int) -> list[str]:
    """Words of label 0 that come nearest to the landmarks, by how many documents hold them."""
    blank = Model(positive, len(positive), np.ones(len(positive)), 0.0, (1.0, 0.0))
    held = rows.sparkSession.sparkContext.broadcast(blank)

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                each = [words_of(t) for t in pdf["text"][i : i + 128]]
                near = held.value.word_values(sorted(set().union(*each)))
                found = [(p, float(near[w].max())) for words in each for w in words if w in near for p in pieces(w)]
                yield pd.DataFrame(found, columns=["w", "near"])

    near = rows.where("label = 0").select("text").mapInPandas(run, "w string, near double").groupBy("w").agg(
        F.count("*").alias("n"), F.max("near").alias("near"))
    top = near.orderBy((F.col("near") * F.log1p("n")).desc(), "w").limit(most).collect()
    return [r["w"] for r in top if r["w"] not in set(positive)]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Linear support vector machine with squared hinge loss; last entry is the bias.

    Newton steps, each halved until the loss falls: a full step would let rows leave and
    enter the margin in turn without end.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6

    def loss(w):
        return w @ penalty @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2

    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], cost[inside][:, None]
        step = np.linalg.solve(penalty + 2 * xs.T @ (cs * xs), 2 * xs.T @ (cs[:, 0] * y[inside])) - w
        share = 1.0
        while (then := loss(w + share * step)) > now and share > 1e-6:
            share /= 2
        if then >= now * (1 - 1e-9):
            break
        w, now = w + share * step, then
    return w


def _platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with softened targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (w - [1, 0]))
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Fit on up to ``most`` labelled documents of each label (see ``quality.sample``)."""
    rows = materialized(sample(docs, labelled, most).dropDuplicates(["doc_id"]))
    positive = _landmarks(rows, landmarks * 3 // 4)
    if not positive:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        return Model([], 0, np.zeros(0), 0.0, (1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))))
    marks = positive + _against(rows, positive, landmarks - len(positive))
    held = docs.sparkSession.sparkContext.broadcast(Model(marks, len(positive), np.zeros(len(marks)), 0.0, (1.0, 0.0)))

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                part = pdf.iloc[i : i + 128]
                each = [words_of(t) for t in part["text"]]
                values = held.value.word_values(sorted(set().union(*each)))
                out = []
                for words in each:
                    # the 24 words nearest to a landmark bound what reaches the driver
                    mine = sorted((w for w in words if w in values), key=lambda w: (-values[w].max(), w))[:24]
                    out.append(np.array([values[w] for w in mine], np.float32).tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "v": out})

    got = rows.mapInPandas(run, "doc_id bigint, label int, v binary").toPandas().sort_values("doc_id")
    y_doc = np.where(got["label"].to_numpy() == 1, 1.0, -1.0)
    return train([np.frombuffer(v, np.float32).reshape(-1, len(marks)).astype(np.float64) for v in got["v"]], y_doc, marks, len(positive))


def train(bags: list[np.ndarray], y_doc: np.ndarray, marks: list[str], positive: int) -> Model:
    """The machine over documents that are bags of words' kernel values.

    A toxic document's examples are its highest word and all words equal to a landmark, so
    that an insult that always comes with others also gets its weight.
    """
    first, second = np.divmod(np.arange(len(marks) ** 2), len(marks))
    among = normalised([marks[i] for i in first], [marks[i] for i in second]).reshape(len(marks), -1).astype(np.float64)
    values, turn = np.linalg.eigh((among + among.T) / 2)
    root = turn / np.sqrt(np.maximum(values, 1e-3)) @ turn.T
    equal = [np.flatnonzero(b[:, :positive].max(axis=1, initial=0.0) > 0.999) for b in bags]
    bags = [np.vstack([b, np.zeros(len(marks))]) @ root for b in bags]
    clean = [b for b, y in zip(bags, y_doc, strict=True) if y < 0] or [np.zeros((1, len(marks)))]
    clean = np.unique(np.round(np.concatenate(clean), 6), axis=0)
    w = np.append(np.linalg.solve(root, (np.arange(len(marks)) < positive).astype(float)), 0.0)
    for _ in range(8):
        stand = [b[np.union1d(e, np.argmax(b @ w[:-1])).astype(int)] for b, e, y in zip(bags, equal, y_doc, strict=True) if y > 0]
        share = np.concatenate([np.full(len(b), 1 / len(b)) for b in stand])
        x, y = np.vstack([*stand, clean]), np.concatenate([np.ones(len(share)), -np.ones(len(clean))])
        cost = np.concatenate([30000.0 / len(stand) * share, np.full(len(clean), 30000.0 / len(clean))])
        new = _svm(x, y, cost)
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    margin = np.array([max((b @ w[:-1]).max(), 0.0) + w[-1] for b in bags])
    return Model(marks, positive, root @ w[:-1], float(w[-1]), _platt(margin, y_doc))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each document's whole text.

    Null and empty texts, and texts without any word near a landmark, get the score of the
    empty sentence. A fit without landmarks gives every text the share of label 1. Very
    long words are read in overlapping pieces. Other columns are ignored; repeated rows
    are scored alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(held.value)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": reader.scores(texts)})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """All columns of the documents whose score stays below ``limit``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(held.value)
        for texts in parts:
            yield pd.Series(reader.scores([t if isinstance(t, str) else "" for t in texts]))

    return docs.where(score(F.col("text").cast("string")) < limit)

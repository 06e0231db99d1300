"""Subword lattice likelihood: the marginal probability of a text over all segmentations.

The pieces and their first weights come from an existing vocabulary; its scores order the
pieces, and a Zipf law over that order makes them probabilities. Expected piece counts
over the training words (forward-backward on every word's lattice) then re-weigh them. A
word's probability is the sum over all its segmentations, by a forward recursion in log
space; a text is the product over its words and one end piece.

Tasks cut documents into blocks and write, beside each document's word counts, one
dictionary per block. Words are counted, scored once each for the whole corpus and sent
back to the blocks, so no word and no document is ever gathered in one place.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.session import materialized

SPACE = "▁"
#: bytes of text in a block, one document at least
BLOCK_BYTES = 16 << 20
_CHUNK = 20_000
#: words up to this many characters with their mark are read in tables, longer ones one by one
_TABLE = 40


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


class Pieces:
    """Pieces of a vocabulary file with log probabilities; bytes stand for other characters."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names, self.logp = names, logp
        self.at = {n: i for i, n in enumerate(names)}
        self.longest = max(len(n) for n in names if not n.startswith("<0x"))
        self.byte = [self.at[f"<0x{b:02X}>"] for b in range(256)]
        self.end = self.at["</s>"]
        order = sorted((_hash_of(n), i) for n, i in self.at.items() if not n.startswith("<"))
        self.keys = np.array([h for h, _ in order], np.uint64)
        self.ids = np.array([i for _, i in order], np.int64)

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]


_RNG = np.random.default_rng(8)
_CHAR = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _char_values(codes: np.ndarray) -> np.ndarray:
    return _CHAR[codes & 4095] * (codes.astype(np.uint64) * np.uint64(2) + np.uint64(1))


def _hash_of(name: str) -> int:
    h = 0
    for v in _char_values(np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)):
        h = (h * int(_BASE) + int(v)) % (1 << 64)
    return h


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Names and first log probabilities: rank by the file's scores, weights 1 / (rank + 3)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(names))])
    special = np.array([n.startswith("<") and n.endswith(">") and len(n) > 2 for n in names])
    weight = np.zeros(len(names))
    order = np.argsort(-scores[~special], kind="stable")
    weight[np.flatnonzero(~special)[order]] = 1 / (np.arange(len(order)) + 3.0)
    weight[special] = weight[weight > 0].min() / 10
    return names, np.log(weight / weight.sum())


def _tables(some: list[str], pieces: Pieces):
    """Log weights of the pieces that end at each position: lists per end of (start, piece ids, log weights)."""
    n, width = len(some), len(some[0])
    codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
    values = _char_values(codes)
    out = []
    for end in range(1, width + 1):
        rows = []
        h, power = np.zeros(n, np.uint64), 1
        for start in range(end - 1, max(-1, end - 1 - pieces.longest), -1):
            h = h + values[:, start] * np.uint64(power)
            power = power * int(_BASE) % (1 << 64)
            at = np.minimum(np.searchsorted(pieces.keys, h), len(pieces.keys) - 1)
            hit = pieces.keys[at] == h
            if hit.any():
                ids = np.where(hit, pieces.ids[at], -1)
                rows.append((start, ids, np.where(hit, pieces.logp[ids], -np.inf)))
        single = rows[0] if rows and rows[0][0] == end - 1 else (end - 1, np.full(n, -1), np.full(n, -np.inf))
        missing = single[1] < 0
        if missing.any():
            spelled = {c: sum(pieces.logp[i] for i in pieces.fallback(chr(c))) for c in np.unique(codes[missing, end - 1])}
            weight = single[2].copy()
            weight[missing] = [spelled[c] for c in codes[missing, end - 1]]
            rows = [(end - 1, single[1], weight)] + [r for r in rows if r[0] != end - 1]
        out.append(rows)
    return codes, out


def _forward(table, n: int) -> list[np.ndarray]:
    alpha = [np.zeros(n)]
    for rows in table:
        total = np.full(n, -np.inf)
        for start, _, weight in rows:
            total = np.logaddexp(total, alpha[start] + weight)
        alpha.append(total)
    return alpha


def _ending(word: str, end: int, pieces: Pieces):
    """Pieces of one word that end at ``end``: start, piece ids, log weight."""
    for start in range(max(0, end - pieces.longest), end):
        i = pieces.at.get(word[start:end], -1)
        if i >= 0:
            yield start, (i,), pieces.logp[i]
    if word[end - 1] not in pieces.at:
        ids = pieces.fallback(word[end - 1])
        yield end - 1, ids, sum(pieces.logp[i] for i in ids)


def _one_alpha(word: str, pieces: Pieces) -> np.ndarray:
    alpha = np.full(len(word) + 1, -np.inf)
    alpha[0] = 0
    for end in range(1, len(word) + 1):
        alpha[end] = np.logaddexp.reduce([alpha[start] + weight for start, _, weight in _ending(word, end, pieces)])
    return alpha


def _one_forward(word: str, pieces: Pieces) -> float:
    """The forward recursion for one word of any length."""
    return float(_one_alpha(word, pieces)[-1])


def _one_expected(word: str, count: float, pieces: Pieces, out: np.ndarray) -> None:
    """Add the expected uses of each piece over one word of any length, by forward-backward."""
    alpha = _one_alpha(word, pieces)
    beta = np.full(len(word) + 1, -np.inf)
    beta[-1] = 0
    for end in range(len(word), 0, -1):
        for start, ids, weight in _ending(word, end, pieces):
            use = count * math.exp(alpha[start] + weight + beta[end] - alpha[-1])
            for i in ids:
                out[i] += use
            beta[start] = np.logaddexp(beta[start], beta[end] + weight)


def _by_length(some: list[str]):
    by: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        by.setdefault(len(w), []).append(i)
    for size, at in by.items():
        for i in range(0, len(at), _CHUNK // 4):
            yield size, at[i : i + _CHUNK // 4]


def log10_of(some: list[str], pieces: Pieces) -> np.ndarray:
    """log10 probability of each word, over all segmentations of its start mark and letters."""
    marked, out = [SPACE + w for w in some], np.zeros(len(some))
    for size, at in _by_length(marked):
        if size > _TABLE:
            out[at] = [_one_forward(marked[i], pieces) for i in at]
        else:
            _, table = _tables([marked[i] for i in at], pieces)
            out[at] = _forward(table, len(at))[-1]
    return out / math.log(10)


def expected(some: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over words with these counts, by forward-backward."""
    marked, out = [SPACE + w for w in some], np.zeros(len(pieces.names))
    for size, at in _by_length(marked):
        if size > _TABLE:
            for i in at:
                _one_expected(marked[i], counts[i], pieces, out)
            continue
        part, c = [marked[i] for i in at], counts[at]
        codes, table = _tables(part, pieces)
        alpha = _forward(table, len(at))
        beta = [np.full(len(at), -np.inf) for _ in range(size)] + [np.zeros(len(at))]
        for end in range(size, 0, -1):
            for start, ids, weight in table[end - 1]:
                beta[start] = np.logaddexp(beta[start], beta[end] + weight)
        for end in range(1, size + 1):
            for start, ids, weight in table[end - 1]:
                use = np.exp(alpha[start] + weight + beta[end] - alpha[-1]) * c
                known = ids >= 0
                np.add.at(out, ids[known], use[known])
                if start == end - 1 and not known.all():
                    for code, u in zip(codes[~known, start], use[~known], strict=True):
                        if u > 0:
                            for b in pieces.fallback(chr(code)):
                                out[b] += u
    return out


def _gathered(batches, rows: int = 60_000):
    """Batches of about ``rows`` rows, since tables of equal word length want many words."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _blocks(docs: DataFrame) -> DataFrame:
    """Word counts by document, and by block of documents, in one written table.

    Rows with ``word`` null are documents (ids and counts of words by their place in the
    block's dictionary); the others are the dictionaries, with counts over training rows.
    """

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        kept, index, size = [], {}, 0

        def closed():
            block = (task << 32) + number
            train = np.zeros(len(index), np.int64)
            for _, learns, _, ids, counts in kept:
                if learns:
                    train[np.frombuffer(ids, "<i4")] += np.frombuffer(counts, "<i4")
            none = dict.fromkeys(("doc_id", "learns", "n_tokens", "ids", "counts", "word", "place", "c"))
            for i in range(0, len(kept), 1000):
                columns = zip(*kept[i : i + 1000], strict=True)
                yield pd.DataFrame({"block": block} | none | dict(zip(("doc_id", "learns", "n_tokens", "ids", "counts"), columns, strict=True)))
            names = [w.decode("utf-8") for w in index]
            for i in range(0, len(names), _CHUNK):
                part = names[i : i + _CHUNK]
                yield pd.DataFrame({"block": block} | none | {"word": part, "place": np.arange(i, i + len(part)), "c": train[i : i + len(part)]})

        for pdf in batches:
            for doc_id, text, learns in zip(pdf["doc_id"], pdf["text"], pdf["learns"], strict=True):
                found = Counter(words(text)) if isinstance(text, str) else Counter()
                place = index.setdefault
                ids = np.array([place(w, len(index)) for w in found], "<i4").tobytes()
                kept.append((doc_id, bool(learns), sum(found.values()), ids, np.array(list(found.values()), "<i4").tobytes()))
                size += len(text) if isinstance(text, str) else 0
                if size >= BLOCK_BYTES:
                    yield from closed()
                    kept, index, size, number = [], {}, 0, number + 1
        yield from closed()

    return docs.mapInPandas(run, "block bigint, doc_id bigint, learns boolean, n_tokens bigint, ids binary, counts binary, word string, place int, c bigint")


def lattice_scores(docs: DataFrame, learns, path: str, rounds: int = 2) -> DataFrame:
    """Lattice log10 probability of each text beside a word-count base score.

    ``learns`` is a boolean column: rows to learn from (null counts as no). Returns doc_id,
    learns, n_tokens and n_known (words and one end), train_tokens, base_score and score. Null and
    empty texts are one end. Without any training row the first weights of the vocabulary
    hold and the base score is that of an empty count. Repeated rows count each; other
    columns are ignored. Words of every length are scored and move the weights of pieces.
    """
    spark = docs.sparkSession
    names, logp = vocabulary(path)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    table = materialized(_blocks(rows))
    places = table.where("word IS NOT NULL").select("block", "place", "word", "c")
    counted = materialized(places.groupBy("word").agg(F.sum("c").alias("c")))
    totals = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = table.where("word IS NULL AND learns").count()
    # the end is a token of its own, counted once for each training text
    n_all, v_all = totals[0] + ends, totals[1] + (ends > 0)

    def counts_under(weights):
        held = spark.sparkContext.broadcast((names, weights))

        def run(batches):
            pieces = Pieces(*held.value)
            total = np.zeros(len(pieces.names))
            for pdf in _gathered(batches):
                total += expected(list(pdf["word"]), pdf["c"].to_numpy(np.float64), pieces)
            yield pd.DataFrame({"piece": np.flatnonzero(total), "n": total[total > 0]})

        got = counted.where("c > 0").mapInPandas(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(len(names))
        for r in got:
            out[r["piece"]] = r["n"]
        return out

    for _ in range(rounds if totals[0] else 0):
        n = counts_under(logp)
        n[names.index("</s>")] = ends
        n += 0.1 / len(n)
        logp = np.log(n / n.sum())
    held = spark.sparkContext.broadcast((names, logp))

    def scored(batches):
        pieces = Pieces(*held.value)
        for pdf in _gathered(batches):
            yield pd.DataFrame({"word": pdf["word"], "c": pdf["c"], "lp": log10_of(list(pdf["word"]), pieces)})

    known = counted.mapInPandas(scored, "word string, c bigint, lp double")
    back = places.select("block", "place", "word").join(known, "word").select(F.col("block").alias("of_block"), "place", "c", "lp")
    unit = math.log10(n_all + 0.5 * (v_all + 1)) if n_all else math.log10(0.5)
    end_base, end_lp = math.log10(ends + 0.5) - unit, float(logp[names.index("</s>")]) / math.log(10)

    def total(pdf, lookup):
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "learns": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        c, lp = np.zeros(len(lookup)), np.zeros(len(lookup))
        c[lookup["place"]], lp[lookup["place"]] = lookup["c"], lookup["lp"]
        base = np.log10(c + 0.5) - unit
        out = []
        for doc_id, learned, n, ids, counts in zip(pdf["doc_id"], pdf["learns"], pdf["n_tokens"], pdf["ids"], pdf["counts"], strict=True):
            i, k = np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i4")
            out.append((doc_id, learned, n + 1, int(k[c[i] > 0].sum()) + (ends > 0), float((base[i] * k).sum()) + end_base, float((lp[i] * k).sum()) + end_lp))
        return pd.DataFrame(out, columns=["doc_id", "learns", "n_tokens", "n_known", "base_score", "score"])

    texts = table.where("word IS NULL").select("block", "doc_id", "learns", "n_tokens", "ids", "counts")
    out = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInPandas(
        total, "doc_id bigint, learns boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_all).cast("bigint"))

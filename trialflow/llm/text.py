"""Word hashes over whole batches of texts, and small helpers the operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_RNG = np.random.default_rng(20)
#: one random 64-bit number per byte value; A-Z hash like a-z
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 2**63, 8, dtype=U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a murmur-style finaliser)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, U64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z as a-z), and each text's word count."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(sizes)
    blank = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    hashes = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(U64))
    return hashes, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes per text; fewer words are one shingle, no words none."""
    hashes, counts = word_hashes(texts)
    rows = max(0, len(hashes) - width + 1)
    runs = np.zeros(rows, U64)
    for k in range(width):
        runs += hashes[k : k + rows] * _STEP[k]
    runs = mixed(runs)
    at = 0
    for n in counts:
        if n >= width:
            yield np.unique(runs[at : at + n - width + 1])
        elif n:
            yield mixed((hashes[at : at + n] * _STEP[:n]).sum(dtype=U64, keepdims=True) + U64(n))
        else:
            yield hashes[:0]
        at += n


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``most`` bytes, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def encoded(column) -> list[bytes]:
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in column]


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; the folds of the contracts. A null key gives null."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus


def spread(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df`` in batches small enough for texts to pass through Python in bounded memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def with_id(df: DataFrame, kind: str = "bigint") -> str:
    return dict(df.dtypes).get("doc_id", kind)


def parts_for(size: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(size / each))

"""Artifact inventories: path, size and digest of files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a file above this size is read in parts of it, each by a task of its own
PART = 128 << 20
#: line readers unpack files of these names
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
#: line readers skip it where a file begins with it
MARK = b"\xef\xbb\xbf"


def inventory(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, size_bytes, sha256`` of every file below ``path``.

    A file up to ``PART`` is read whole. A larger one is read part after part: SHA-256 goes
    through the bytes in order, so each part's task takes the digest up where the one before
    left it. Several files go on side by side; the driver sees names, sizes and digests only.
    Packed files, and all if the executors lack libcrypto, are read whole up to Spark's 2 GB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path if isinstance(path, str) else list(path))
    out = _read_whole(files.where(F.col("length") <= PART))
    large = files.where(F.col("length") > PART).select("path", "length").collect()
    if not large:
        return out
    with ThreadPoolExecutor(8) as pool:
        digests = list(pool.map(lambda f: _read_in_parts(spark, f["path"], f["length"]), large))
    known = [(f["path"], f["length"], d) for f, d in zip(large, digests) if d is not None]
    rest = [_literal(f["path"]) for f, d in zip(large, digests) if d is None]
    if known:
        out = out.unionByName(spark.createDataFrame(known, "path string, size_bytes long, sha256 string"))
    return out.unionByName(_read_whole(spark.read.format("binaryFile").load(rest))) if rest else out


def _read_whole(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def _literal(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A file's bytes in order, cut behind each newline, and where the part they lie in begins.

    A newline is put behind the last row too. One partition is one part.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", PART)
    own.conf.set("spark.sql.files.minPartitionNum", 1)
    return own.read.option("lineSep", "\n").text(_literal(path)).select(
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"), F.col("_metadata.file_block_start").alias("start"))


def _read_in_parts(spark: SparkSession, path: str, size: int) -> str | None:
    """The SHA-256 of one file, or NULL where it can't be taken in parts."""
    if path.lower().endswith(PACKED):
        return None
    lines = _lines(spark, path)
    parts = lines.rdd.getNumPartitions()
    for head in (b"", MARK):
        state, seen, start, digest = None, 0, 0, None
        for part in range(parts):
            rows = lines.mapInArrow(_step(state, seen, start, size, head), "state binary, seen long, start long, digest string").rdd
            [(state, seen, start, digest)] = spark.sparkContext.runJob(rows, list, [part])
            if digest is None:
                return None
        if seen == size:
            return digest
    raise RuntimeError(f"{path} has no {size} bytes, it may have changed while it was read")


def _step(state: bytes | None, seen: int, start: int, size: int, head: bytes):
    """One part of a digest: goes on from ``state``, which holds ``seen`` of ``size`` bytes.

    hashlib can't hand a digest on that is not finished; libcrypto's SHA256_CTX can be copied.
    """

    def step(batches):
        import ctypes

        import pyarrow as pa

        crypto = None
        for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.so"):
            try:
                crypto = ctypes.CDLL(name)
                break
            except OSError:
                continue
        schema = pa.schema([("state", pa.binary()), ("seen", pa.int64()), ("start", pa.int64()), ("digest", pa.string())])
        if crypto is None or not hasattr(crypto, "SHA256_Init"):
            for _ in batches:
                pass
            yield pa.RecordBatch.from_pylist([{"seen": seen, "start": start}], schema)
            return
        # 8 words of the digest, 2 of the length, a block of 16 and 2 counters, 32 bits each
        words, at, begun = ctypes.create_string_buffer(112), seen, start

        def add(data):
            crypto.SHA256_Update(words, data, ctypes.c_size_t(len(data)))
            return len(data)

        if state is None:
            crypto.SHA256_Init(words)
            at += add(head)
        else:
            words.raw = bytes(state)
        for batch in batches:
            data, starts = b"".join(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            if starts and (starts[0] < begun or starts != sorted(starts)):
                raise ValueError("parts of a file out of order")
            begun = starts[-1] if starts else begun
            # the newline behind the last row may not be the file's
            at += add(data[:-1] if at + len(data) == size + 1 else data)
        last, out = ctypes.create_string_buffer(words.raw, 112), ctypes.create_string_buffer(32)
        crypto.SHA256_Final(out, last)
        yield pa.RecordBatch.from_pylist([{"state": words.raw, "seen": at, "start": begun, "digest": out.raw.hex()}], schema)

    return step

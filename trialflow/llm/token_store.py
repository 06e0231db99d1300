"""Token ids in directly addressable codes, written as files and read back.

An id is cut into chunks of bits. Level k holds chunk k of all ids that have one, packed
side by side, and a bitmap that tells which of them go on at the next level; ranks of that
bitmap, kept every 512 bits, are the places there. So any id is read from one chunk and
one rank a level, without decoding what stands before it.

Files: a Parquet table of blocks, uncompressed. A block holds whole documents in order of
their key: ``file``, ``block``, ``before`` (ids of the file before it), ``n`` (its ids),
``keys``, ``sizes`` and ``code``. A code is, little-endian: ``DAC1``, the number of levels
(uint32), n (uint64), each level's width (uint32) and length (uint64); then per level its
chunks, and, but for the last, the bitmap and its ranks (uint64), each filled up to 8 bytes.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from trialflow.functions.scaled import running

BLOCK_IDS = 1 << 20
PART_BYTES = 64 << 20
RANKED = 512
#: stretches a Python worker remembers twice over (about 200 bytes each), and the longest of them
KNOWN = 700_000
KNOWN_LENGTH = 48
#: files whose start (16 bytes) is broadcast to their blocks; beyond it they meet in a shuffle
BROADCAST_FILES = 1 << 20
_SLICE = 1 << 16
_BLANK = "\t-\r \x85\xa0  -     　"


def widths_for(bits: np.ndarray) -> list[int]:
    """The chunk widths with the fewest stored bits; ``bits[b]`` ids are b bits long."""
    top = max(1, int(np.flatnonzero(bits).max(initial=1)))
    more = [int(bits[b + 1 :].sum()) if b else int(bits.sum()) for b in range(top + 1)]
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for low in range(top - 1, -1, -1):
        best[low] = min((more[low] * (high - low + (1 + 64 / RANKED) * (high < top)) + best[high][0], [high - low, *best[high][1]])
                        for high in range(low + 1, top + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    places = np.arange(width, dtype=np.uint32)
    out = [np.packbits((values[i : i + _SLICE, None] >> places & 1).astype(np.uint8), bitorder="little").tobytes() for i in range(0, len(values), _SLICE)]
    return b"".join(out)


def _filled(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack(ids: np.ndarray, widths: Sequence[int] | None = None) -> bytes:
    """The code of ids (0 to 2**32 - 1); widths that do not hold the largest get one more level."""
    rest = np.ascontiguousarray(ids, np.uint32)
    if widths is None:
        widths = widths_for(np.bincount(np.frexp(rest.astype(float))[1].clip(1), minlength=2))
    largest = int(rest.max(initial=0)).bit_length()
    widths = [*widths, *([largest - sum(widths)] if largest > sum(widths) else [])]
    levels, parts = [], []
    for k, width in enumerate(widths):
        levels.append((width, len(rest)))
        parts.append(_filled(_packed(rest & np.uint32((1 << width) - 1), width)))
        if k + 1 < len(widths):
            high = rest >> np.uint32(width)
            on = high > 0
            marks = _filled(np.packbits(on, bitorder="little").tobytes())
            starts = np.arange(0, len(on), RANKED)
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(on, starts, dtype=np.uint64))[:-1]]) if len(on) else starts
            parts += [marks, ranks.astype("<u8").tobytes()]
            rest = high[on]
    head = b"DAC1" + struct.pack("<IQ", len(levels), len(ids)) + b"".join(struct.pack("<IQ", *x) for x in levels)
    return _filled(head) + b"".join(parts)


class Code:
    """Reads a code; nothing is decoded before it is asked for."""

    def __init__(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        if raw[:4] != b"DAC1":
            raise ValueError("not a directly addressable code")
        depth, self.n = struct.unpack_from("<IQ", raw, 4)
        at = 16 + 12 * depth
        at += -at % 8
        self.levels = []
        for k in range(depth):
            width, size = struct.unpack_from("<IQ", raw, 16 + 12 * k)
            sections = []
            for length in ((size * width + 7) // 8, (size + 7) // 8, 8 * -(-size // RANKED))[: 3 if k + 1 < depth else 1]:
                sections.append(buf[at : at + length])
                at += length + -length % 8
            self.levels.append((width, size, *sections))

    def all(self) -> np.ndarray:
        """Every id."""
        out, where, shift = np.zeros(self.n, np.uint32), None, 0
        for width, size, chunks, *marks in self.levels:
            part = np.empty(size, np.uint32)
            for i in range(0, size, _SLICE):
                count = min(_SLICE, size - i)
                bits = np.unpackbits(chunks[i * width // 8 :], count=count * width, bitorder="little").reshape(count, width)
                part[i : i + count] = bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
            if where is None:
                out = part
                where = np.arange(size) if marks else None
            else:
                out[where] |= part << np.uint32(shift)
            if marks:
                where = where[np.unpackbits(marks[0], count=size, bitorder="little").view(bool)]
            shift += width
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places, each from one chunk and one rank a level."""
        p, out = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        live, shift = np.arange(len(p)), 0
        for width, _, chunks, *marks in self.levels:
            spans = chunks[np.minimum((p * width >> 3)[:, None] + np.arange(8), len(chunks) - 1)] if len(p) else np.zeros((0, 8), np.uint8)
            word = np.ascontiguousarray(spans).view("<u8")[:, 0] >> (p * width & 7).astype(np.uint64)
            out[live] |= (word & np.uint64((1 << width) - 1)).astype(np.uint32) << np.uint32(shift)
            if not marks:
                break
            on = (marks[0][p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            p, live = p[on], live[on]
            cells = np.minimum((p // RANKED * (RANKED // 8))[:, None] + np.arange(RANKED // 8), len(marks[0]) - 1)
            inside = (p % RANKED)[:, None] - 8 * np.arange(RANKED // 8)
            kept = marks[0][cells] & ((1 << inside.clip(0, 8)) - 1).astype(np.uint8)
            p = marks[1].view("<u8")[p // RANKED].astype(np.int64) + np.bitwise_count(kept).sum(1, dtype=np.int64)
            shift += width
        return out


class Encoder:
    """The tokenizers library over texts; the ids of short stretches are remembered.

    A byte-level vocabulary cuts a text into stretches of non-blanks with at most one space
    before them, and runs of blanks, before anything else; their ids joined are the ids of
    the text. Texts that hold a special token are encoded whole.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.stretches = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
        self.blank = re.compile(f"[{_BLANK}]")
        # a word and the marks behind it are apart in the vocabulary's own first cut
        self.word_and_marks = re.compile("( ?[A-Za-z]+)([.,;:!?]+)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        line = self._ids(["\n"])[0]
        self.line = int(np.frombuffer(line, "<u4")[0]) if len(line) == 4 else None

    def _of_stretches(self, found: list[str]) -> list[bytes]:
        """Ids of stretches without blanks, encoded as the lines of one text."""
        if self.line is not None:
            ids = np.frombuffer(self._ids(["\n".join(found)])[0], "<u4")
            ends = np.flatnonzero(ids == self.line).tolist()
            if len(ends) + 1 == len(found):
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)]
        return self._ids(found)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        whole = [any(x in t for x in self.special) for t in texts]
        found = [[] if w else self.stretches.findall(t) for t, w in zip(texts, whole, strict=True)]
        young, old = self.young, self.old
        new: set[str] = set()
        for stretches in found:
            new.update(stretches)
        missing, joined = {}, []
        for x in new.difference(young):
            got = old.get(x)
            if got is not None:
                young[x] = got
                continue
            both = self.word_and_marks.fullmatch(x)
            if both:
                joined.append((x, *both.groups()))
            else:
                missing[x] = None
        for _, *parts in joined:
            for x in parts:
                if x not in young:
                    got = old.get(x)
                    if got is not None:
                        young[x] = got
                    else:
                        missing[x] = None
        blanks = [x for x in missing if self.blank.match(x[-1])]
        words = [x for x in missing if not self.blank.match(x[-1])]
        for part, encode in ((blanks, self._ids), (words, self._of_stretches)):
            for start in range(0, len(part), 4096):
                some = part[start : start + 4096]
                young.update(zip(some, encode(some), strict=True))
        young.update([(x, young[word] + young[marks]) for x, word, marks in joined])
        known = young.__getitem__
        out = [self._ids([t])[0] if w else b"".join(map(known, f)) for t, w, f in zip(texts, whole, found, strict=True)]
        for x in [*missing, *[x for x, *_ in joined]]:
            if len(x) > KNOWN_LENGTH:
                del young[x]
        if len(young) > KNOWN:
            # stretches of the last round are still at hand in the next one
            self.young, self.old = {}, young
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(source: str) -> Encoder:
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = Encoder(source)
    return _encoders[source]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts of ``docs`` and write their ids to ``path`` in ascending order of ``key``.

    ``vocabulary`` is the path of a byte-level tokenizer file on the driver; its content (a
    few MB) is broadcast. Each document ends with ``end_id``; a null text is empty and has
    that id alone. Null keys come first; rows of one key follow in the order of the table's
    files, all of them kept. Rows are dealt out by ranges of (key, place in the table), so
    one key with many rows is split. A block is closed at ``block_ids`` ids, so it holds
    that many and one document at most; a task holds one block. Other columns are not read;
    an empty table writes no block.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place")
    kind = rows.schema["key"].dataType
    schema = StructType([StructField("file", IntegerType()), StructField("block", IntegerType()), StructField("before", LongType()), StructField("n", LongType()),
                         StructField("keys", ArrayType(kind)), StructField("sizes", ArrayType(LongType())), StructField("code", BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, encoder = TaskContext.get().partitionId(), _encoder(source.value)
        block = before = held = 0
        keys, sizes, codes = [], [], []

        def closed():
            arrays = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                      pa.ListArray.from_arrays([0, len(keys)], pa.concat_arrays([k for k in keys])), pa.array([sizes], pa.list_(pa.int64())),
                      pa.array([pack(np.frombuffer(b"".join(codes), "<u4"))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            column, texts = batch.column("key"), batch.column("text")
            # texts pass in groups of about a megabyte
            group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) >> 20
            for low, high in itertools.pairwise([*np.unique(group, return_index=True)[1].tolist(), len(group)]):
                for i, ids in enumerate(encoder.encode(texts.slice(low, high - low).to_pylist()), low):
                    keys.append(column.slice(i, 1))
                    sizes.append(len(ids) // 4 + 1)
                    codes += [ids, end]
                    held += sizes[-1]
                    if held >= block_ids:
                        yield closed()
                        block, before, held = block + 1, before + held, 0
                        keys, sizes, codes = [], [], []
        if keys:
            yield closed()

    ordered.select("key", "text").mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks below ``path`` with ``start``, the number of ids of all documents before each."""
    blocks = spark.read.parquet(path)
    files = blocks.groupBy("file").agg(F.sum("n").alias("ids"))
    starts = running(files, [], ["file"], [F.shiftright("file", 10)], "sum", {"first": F.col("ids")}, inclusive=False).select("file", "first")
    starts = F.broadcast(starts) if (blocks.agg(F.max("file")).first()[0] or 0) < BROADCAST_FILES else starts
    return blocks.join(starts, "file").withColumn("start", (F.col("first") + F.col("before")).cast("bigint")).drop("first")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """key, start, n_tokens and ids (binary, little-endian uint32) of every written document."""
    blocks = read_blocks(spark, path)
    kind = blocks.schema["keys"].dataType.elementType
    schema = StructType([StructField("key", kind), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys").slice(i, 1).flatten()
                sizes = batch.column("sizes").slice(i, 1).flatten().to_numpy()
                raw = Code(batch.column("code")[i].as_py()).all().astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                for low in range(0, len(keys), 4096):
                    high = min(len(keys), low + 4096)
                    ids = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes[low:high], ends[low:high], strict=True)]
                    starts = batch.column("start")[i].as_py() + ends[low:high] - sizes[low:high]
                    yield pa.RecordBatch.from_arrays([keys.slice(low, high - low), pa.array(starts, pa.int64()), pa.array(sizes[low:high], pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return blocks.select("keys", "sizes", "code", "start").mapInArrow(run, schema)


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place and id of each distinct ``place`` (counted over all written ids) of ``places``.

    Places meet their block by equal stretches of ``BLOCK_IDS`` ids; inside it each id is
    read by random access. Null places and those outside the written ids give no row. A
    block's places are at most its ids.
    """
    blocks = read_blocks(spark, path)
    cells = blocks.select("file", "block", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_IDS), F.floor((F.col("start") + F.col("n") - 1) / BLOCK_IDS))).alias("cell"))
    wanted = places.select(F.col("place").cast("bigint").alias("place")).where("place IS NOT NULL").distinct().withColumn("cell", F.floor(F.col("place") / BLOCK_IDS))
    met = wanted.join(cells, "cell").where("place >= start AND place < start + n").select(
        F.col("file").alias("of_file"), F.col("block").alias("of_block"), (F.col("place") - F.col("start")).alias("offset"))

    def read(block, asked):
        import pandas as pd

        if block.empty or asked.empty:
            return pd.DataFrame({"place": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})
        ids = Code(block["code"][0]).at(asked["offset"].to_numpy())
        return pd.DataFrame({"place": asked["offset"] + block["start"][0], "id": ids.astype(np.int64)})

    pair = blocks.select("file", "block", "start", "code").groupBy("file", "block").cogroup(met.groupBy("of_file", "of_block"))
    return pair.applyInPandas(read, "place bigint, id bigint")

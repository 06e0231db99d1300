"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word its encoding ends in one token only. A suffix automaton over
the vocabulary lists the tokens that end at each position; a match is the last token of
that prefix iff it and the last token of the prefix before it are compatible: merging the
two side by side, no merge crosses their border. The last tokens are stored per prefix and
the ids follow by going back from the word's end.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: words a task keeps the encodings of
KNOWN_WORDS = 200_000
_END = "\n"
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_NEVER = 1 << 30
_loaded: dict[bytes, Encoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Encodes words with a byte-level vocabulary whose words end in a suffix mark."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in special) + ")") if special else None
        vocabulary = model["vocab"]
        self.name = {i: t for t, i in vocabulary.items()} | {i: t for t, i in special.items()}
        self.bytes = byte_alphabet()
        # rank and parts of each token's merge; single symbols are there from the start
        self.rank, self.parts, self.pairs = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocabulary[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocabulary[pair[0] + pair[1] if isinstance(pair, list) else pair.replace(" ", "")]
            self.pairs.setdefault((a, b), rank)
            if made not in self.rank:
                self.rank[made], self.parts[made] = rank, (a, b)
        self.spines: dict[tuple, list] = {}
        self.fits: dict[tuple, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocabulary.items():
            inner = t[: -len(mark)] + _END if t.endswith(mark) and len(t) > len(mark) else t
            # tokens that the merges never leave standing alone end no prefix
            if not self.compatible(*self.parts[i]) if i in self.parts else len(inner.rstrip(_END)) == 1:
                self.automaton.add_word(inner, (len(inner), i))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[bytes, str]] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is merged, with the rank that ends each."""
        got = self.spines.get((token, side))
        if got is None:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            chain.reverse()
            got = self.spines[token, side] = list(zip(chain, [self.rank[t] for t in chain[1:]] + [_NEVER], strict=True))
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both side by side leaves them as they are."""
        got = self.fits.get((left, right))
        if got is None:
            a, b = self._spine(left, 1), self._spine(right, 0)
            i = j = 0
            while True:
                # a merge across the border goes first if it is due before either side moves on;
                # of equal merges the leftmost goes first
                across = self.pairs.get((a[i][0], b[j][0]), _NEVER)
                if across < a[i][1] and across <= b[j][1] and across < _NEVER:
                    got = False
                    break
                if a[i][1] == b[j][1] == _NEVER:
                    got = True
                    break
                if a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 4 * KNOWN_WORDS:
                self.fits.clear()
            self.fits[left, right] = got
        return got

    def last_tokens(self, text: str) -> list[tuple[int, int]]:
        """(length, token) that ends each prefix of a word; (0, -1) where none does."""
        last = [(0, -1)] * (len(text) + 1)
        skip, fits = len(text) - 1, self.fits  # the symbol before the mark is one with it
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end][0] or end == skip:
                continue
            if end == size:
                last[end] = (size, token)
                continue
            before = last[end - size][1]
            if before >= 0:
                fit = fits.get((before, token))
                if fit is None:
                    fit = self.compatible(before, token)
                if fit:
                    last[end] = (size, token)
        return last

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids (int32 bytes) and names of one word."""
        got = self.words.get(word)
        if got is None:
            text = (word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode("utf-8")])) + _END
            last, at, ids = self.last_tokens(text), len(text), []
            while at > 0:
                size, token = last[at]
                if not size:
                    raise ValueError(f"no token ends the prefix {text[:at]!r}")
                ids.append(token)
                at -= size
            ids.reverse()
            name = self.name
            got = array("i", ids).tobytes(), " ".join([name[i] for i in ids])
            if len(self.words) > KNOWN_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def chunk(self, raw: str) -> tuple[bytes, str]:
        """Ids and names of a stretch of text without white space."""
        found = []
        for part in self.split.split(raw) if self.split and any(x in raw for x in self.special) else [raw]:
            if part in self.special:
                found.append((array("i", [self.special[part]]).tobytes(), part))
            else:
                # lower case character by character, without rules for a word's end
                plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += [self.word(w) for w in ([plain] if plain.isascii() and plain.isalpha() else self.pattern.findall(plain))]
        return found[0] if len(found) == 1 else (b"".join([x for x, _ in found]), " ".join([x for _, x in found]))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (int32 bytes) and the decoded text, which is the tokens' names apart by spaces."""
        raw = regex.split(r"(?:(?![\x1c-\x1f])\s)+", text) if _ODD_SPACE.search(text) else text.split()
        young, old = self.young, self.old
        for x in {*raw}.difference(young):
            young[x] = old.get(x) or self.chunk(x)
        found = [young[x] for x in raw]
        if len(young) > KNOWN_WORDS:
            # words of the last round are still at hand in the next one
            self.young, self.old = {}, young
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found if x])


def loaded(source: bytes) -> Encoder:
    """The encoder of a vocabulary file's content, built once per Python worker."""
    if source not in _loaded:
        _loaded.clear()
        _loaded[source] = Encoder(source)
    return _loaded[source]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Columns of ``docs`` without the text, and ids (array<int>) and decoded (string).

    ``vocabulary`` is the path of a tokenizer file on the driver; its content (a few MB) is
    broadcast. Null and empty texts, and texts of white space only, have no ids and decode
    to the empty string. Columns called ids or decoded are replaced. Rows keep their
    number and order within a partition.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rest = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    rows = docs.select(*rest, F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches):
        encoder = loaded(source.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                both = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x, _ in both]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([x for x, _ in both]), "<i4")))
                columns = [part.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array([x for _, x in both], pa.string())], [*rest, "ids", "decoded"])

    return rows.mapInArrow(run, schema)

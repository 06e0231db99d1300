"""Cheapest repair of conversations by the auction shortest-path algorithm.

A repair is a path through a lattice: layer i stands before row i, and the state says what
the roles kept so far allow next (nothing yet, after a system turn, a user turn, an
assistant turn). Keep, Rerole and Delete lead to the next layer, Insert stays on it; costs
are integers. The auction raises node prices: a path grows along an arc whose price is
met (``price(i) = cost + price(j)``), else its last node's price goes up to the cheapest
arc and the path shrinks by it. Converged prices are exact distances, so the arcs that
meet them are the ones on shortest paths; they are traced in the order of their letters.
A tight arc counts once an auction from its head has settled the head's price.

Rows are damaged, compared and counted by Spark. What a conversation's task sees is one
code a row (equal rows collapsed to a count), the audit of one letter a row, which the
result has to hold in one value anyway, and the texts as a stream, one at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: rows of one auction; longer conversations are solved block by block from their end
BLOCK = 32
KNOWN_BLOCKS = 50_000
BLANKS = r"\x20\x09-\x0D"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("a", _USER): _ASSISTANT, ("u", _ASSISTANT): _USER}
_LEGAL = {"su", "ua", "au"}
#: distance from each state to an accepted end by insertions alone, and their letters
_END_PRICES, _END_LETTERS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def due(state: int) -> str:
    """The role that must follow."""
    return "a" if state == _USER else "u"


@functools.lru_cache(4096)
def _arcs(item: int | tuple[str, bool]) -> list[list[tuple[str, int, int, int]]]:
    """Per state, in the order of letters: (letters, layers on, state, cost)."""
    out = []
    for state in range(4):
        after = _NEXT[due(state), state]
        if isinstance(item, int):
            out.append([("D" * item, 1, state, DELETE * item), ("I", 0, after, INSERT)])
            continue
        role, cut = item
        arcs = [("D", 1, state, DELETE), ("I", 0, after, INSERT)]
        if (role, state) in _NEXT:
            arcs.append(("K", 1, _NEXT[role, state], CUT_OFF * cut))
        arcs.append(("R", 1, after, REROLE + CUT_OFF * cut))
        out.append(arcs)
    return out


class Auction:
    """Prices of one block's nodes; ``ends`` are the exact prices of the layer behind it."""

    def __init__(self, items: tuple, ends: tuple[int, ...]):
        self.size = len(items)
        self.arcs = [_arcs(x) for x in items]
        self.price = [[min(ends)] * 4 for _ in items] + [list(ends)]
        self.exact: set[tuple[int, int]] = {(self.size, q) for q in range(4)}

    def settle(self, layer: int, state: int) -> int:
        """Run the auction from a node until its path meets a settled node; its price is then exact."""
        price, path = self.price, [(layer, state)]
        while path[-1] not in self.exact:
            i, q = path[-1]
            best, way = min((cost + price[i + on][to], (i + on, to)) for _, on, to, cost in self.arcs[i][q])
            if price[i][q] < best:
                price[i][q] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(way)
        self.exact.update(path)
        return price[layer][state]

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of a shortest path from a settled state of the first layer, and its last state."""
        layer, letters = 0, []
        while layer < self.size:
            for word, on, to, cost in self.arcs[layer][state]:
                here = self.price[layer][state]
                if here == cost + self.price[layer + on][to] and here == cost + self.settle(layer + on, to):
                    letters.append(word)
                    layer, state = layer + on, to
                    break
        return "".join(letters), state


_known: dict[tuple, dict[int, tuple[int, str, int]]] = {}


def _solved(items: tuple, ends: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """Price of entering a block in a state, the letters through it and the state behind it."""
    low = min(ends)
    key = (items, tuple(e - low for e in ends))
    if len(_known) > KNOWN_BLOCKS:
        _known.clear()
    got = _known.setdefault(key, {})
    if entry not in got:
        auction = Auction(items, key[1])
        got[entry] = (auction.settle(0, entry), *auction.trace(entry))
    price, letters, state = got[entry]
    return price + low, letters, state


def cheapest(items: list) -> tuple[int, str]:
    """Cost and audit of a conversation.

    An item is a row's (role initial, cut off) or a number of rows that must go.
    """
    blocks = [tuple(items[i : i + BLOCK]) for i in range(0, len(items), BLOCK)]
    ends = [_END_PRICES]
    for block in reversed(blocks[1:]):
        ends.append(tuple(_solved(block, ends[-1], q)[0] for q in range(4)))
    cost, letters, state = 0, [], _START
    for k, block in enumerate(blocks):
        price, word, state = _solved(block, ends[-1 - k], state)
        cost = cost if k else price
        letters.append(word)
    return cost, "".join([*letters, _END_LETTERS[state]])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage that crc32(``conv_id:turn``) % 20 deals."""
    fate = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), fate.alias("fate"))
    return hurt.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, without their text: conv_id, turn, role, mark, blank, cut, later, copies."""
    text = F.col("text")
    seen = rows.select(
        "conv_id", F.when(F.col("copies") > 0, F.col("turn")).alias("turn"), F.when(F.col("copies") > 0, F.col("role")).alias("role"),
        F.when(F.col("copies") > 0, F.col("mark")).alias("mark"), (~text.rlike(f"[^{BLANKS}]")).alias("blank"),
        (~F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z")).alias("cut"), "copies")
    runs = seen.groupBy("conv_id", "turn", "role", "mark").agg(F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.sum("copies").alias("copies"))
    firsts = runs.where("mark IS NOT NULL").groupBy("conv_id", "mark").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    firsts = firsts.where("turns > 1").select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first")
    met = runs.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("conv_id", "turn", "role", "mark", "blank", "cut", later.alias("later"), "copies")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, one at a time; equal keys stand together."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


class _Diagnosis:
    def __init__(self):
        self.items, self.blank, self.duplicate, self.cut, self.illegal = [], 0, 0, 0, 0
        self.turns, self.first, self.last, self.before = 0, None, None, None

    def must_go(self, copies: int) -> None:
        if copies and self.items and isinstance(self.items[-1], int):
            self.items[-1] += copies
        elif copies:
            self.items.append(copies)

    def add(self, turn, role, blank, cut, later, copies) -> None:
        if not copies:
            return
        if turn is not None and (not self.turns or turn != self.last):
            self.turns += 1
            self.first, self.last = turn if self.turns == 1 else self.first, turn
        initial = role[:1]
        # no role may follow itself
        self.illegal += copies - 1 + (self.before is not None and self.before + initial not in _LEGAL)
        self.before = initial
        if blank:
            self.blank += copies
            self.must_go(copies)
        elif later:
            self.duplicate += copies
            self.must_go(copies)
        else:
            self.duplicate += copies - 1
            self.cut += cut
            self.items.append((initial, cut))
            self.must_go(copies - 1)

    def row(self, key) -> tuple:
        cost, audit = cheapest(self.items)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return key, min(gaps, 2**63 - 1), self.blank, self.duplicate, self.cut, self.illegal, cost, audit


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands; 0: not at
    all). Rows are taken by turn, nulls first, within a turn by role and a digest of
    (role, text), equal ones side by side. Blank rows, repeats of an earlier (role, text)
    and rows whose last character is not one of ``.!?`` are counted by their first fault. An
    empty role fits nowhere. Conversations without rows have zeros and an empty audit; a
    null conv_id is one conversation; gaps past a long are the largest long.
    """
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *[StructField(n, LongType()) for n in COUNTS], StructField("audit", StringType())])
    dealt = _runs(_marked(rows)).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark")

    def run(batches):
        key, found, out = None, None, []
        for conv, turn, role, blank, cut, later, copies in _grouped(batches):
            if found is None or conv != key:
                if found is not None:
                    out.append(found.row(key))
                key, found = conv, _Diagnosis()
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
            found.add(turn, role, blank, cut, later, copies)
        if found is not None:
            yield _batch([*out, found.row(key)], schema)

    return dealt.select("conv_id", "turn", "role", "blank", "cut", "later", "copies").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _marked(rows: DataFrame) -> DataFrame:
    plain = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "text", "copies", F.unhex(F.sha2(plain, 256)).alias("mark"))


class _Writer:
    """Follows an audit over the rows of its conversation and gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _made(self) -> str:
        role = due(self.state)
        self.state = _NEXT[role, self.state]
        return "assistant" if role == "a" else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _NEXT[role[:1], self.state]
            yield role, text
        elif letter == "R":
            yield self._made(), text


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its rows in order, in one partition."""
    nothing = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), nothing.cast("bigint").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("binary").alias("mark"),
                          nothing.cast("string").alias("text"), F.lit(1).alias("copies"), *COUNTS, "audit")
    texts = _marked(rows).where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "text", F.col("copies").cast("int").alias("copies"),
                                                     *[nothing.cast("bigint").alias(c) for c in COUNTS], nothing.cast("string").alias("audit"))
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")
    return dealt.select("conv_id", "kind", "role", "text", "copies", *COUNTS, "audit")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of every turn of the repaired conversations."""
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())])

    def run(batches):
        out, key, writer, place, held = [], None, _Writer(""), 0, 0
        for conv, kind, role, text, copies, *_, audit in _grouped(batches):
            if kind == 0:
                made = writer.inserted()
                out += [(key, place + i, *t) for i, t in enumerate(made)]
                key, writer, place = conv, _Writer(audit), 0
                continue
            for _ in range(copies):
                for turn in writer.turns(role, text):
                    out.append((key, place, *turn))
                    place, held = place + 1, held + len(turn[1])
            if held > 1 << 22 or len(out) > 4096:
                yield _batch(out, schema)
                out, held = [], 0
        out += [(key, place + i, *t) for i, t in enumerate(writer.inserted())]
        if out:
            yield _batch(out, schema)

    return _with_audits(rows, audits).mapInArrow(run, schema)


def repair_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: of ``role:text`` of the repaired turns, joined by newlines.

    The texts of a conversation pass through its digest one at a time.
    """
    schema = StructType([*audits.schema.fields, StructField("repaired_sha256", StringType())])

    def run(batches):
        out, head, writer, digest, started = [], None, None, None, False

        def take(turns):
            nonlocal started
            for role, text in turns:
                digest.update((("\n" if started else "") + role + ":" + text).encode("utf-8"))
                started = True

        for conv, kind, role, text, copies, *rest in _grouped(batches):
            if kind == 0:
                if head is not None:
                    take(writer.inserted())
                    out.append((*head, digest.hexdigest()))
                    if len(out) >= 1000:
                        yield _batch(out, schema)
                        out = []
                head, writer, digest, started = (conv, *rest), _Writer(rest[-1]), hashlib.sha256(), False
                continue
            for _ in range(copies):
                take(writer.turns(role, text))
        if head is not None:
            take(writer.inserted())
            yield _batch([*out, (*head, digest.hexdigest())], schema)

    return _with_audits(rows, audits).mapInArrow(run, schema)

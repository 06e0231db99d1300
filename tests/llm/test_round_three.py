"""Collocations, conversation repair and the token store against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialflow.llm import collocations, conversation_repair, token_store
from trialflow.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, a bigint, n int, phrase string, w1 string, key string, start string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "p", "q", "k", "z") for i, t, lang in rows], SCHEMA)


# --- collocations


def phrases(rows, support, longest=4, covered=80, best=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    whole = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = defaultdict(list)
    for (lang, p), a in whole.items():
        if any(100 * b >= covered * a for (other, q), b in whole.items()
               if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, left, right, n[lang], score))
    return {(lang, i + 1, r[2].decode(), *r[3:]) for lang, found in out.items() for i, r in enumerate(sorted(found)[:best])}


ODD_TEXTS = [
    (1, None, None), (2, "", "en"), (3, " \t \n", "en"), (4, "Red fox, red fox; RED FOX\tred fox", "en"), (5, "red fox\nred  fox. red", None), (5, "red fox\nred  fox. red", None),
    (None, "red fox red fox red fox", "und"), (6, "é É ß\x0b\x1c a a a a a a", "de"), (7, " ".join(["la", "de", "la", "x"] * 5000), "fr"), (8, "y" * 9000 + " z " * 3, "fr"), (9, "end", None),
]


@pytest.mark.parametrize("support", [1, 2, 3])
def test_collocations_equal_brute_force(spark, support):
    rng = random.Random(support)
    rows = [*ODD_TEXTS, *[(20 + i, "".join(rng.choice(["ab ", "c ", "d ", "E ", "f, ", "g\t", ". "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for i in range(60)]]
    got = collocations.collocations(docs(spark, rows), support)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == phrases(rows, support)
    best = collocations.collocations(docs(spark, rows), support, best=3)
    assert {tuple(r) for r in best.collect()} == phrases(rows, support, best=3)


def test_collocations_of_two_words_only_and_without_broadcast(spark, monkeypatch):
    assert {tuple(r) for r in collocations.collocations(docs(spark, ODD_TEXTS), 2, longest=2).collect()} == phrases(ODD_TEXTS, 2, longest=2)
    monkeypatch.setattr(collocations, "BROADCAST_PAIRS", -1)
    assert {tuple(r) for r in collocations.collocations(docs(spark, ODD_TEXTS), 2).collect()} == phrases(ODD_TEXTS, 2)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(docs(spark, []), 30).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, " . ", "en")]), 1).count() == 0


# --- conversation repair


def repaired(rows):
    """Brute force: cheapest (cost, audit) over the lattice, by Dijkstra over whole audits."""
    states = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    seen, n = set(), len(rows)
    faults = []
    for role, text in rows:
        last = re.search(r"([^\x20\x09-\x0d])[\x20\x09-\x0d]*\Z", text)
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[1] not in ".!?" else "")
        seen.add((role, text))
    best, turn = {(n, 0): (0, ""), (n, 1): (10, "II"), (n, 2): (5, "I"), (n, 3): (0, "")}, {}
    for i in reversed(range(n)):
        here = {}
        for q in range(4):
            need = "a" if q == 2 else "u"
            ways = [(2, "D", q)]
            if faults[i] not in ("b", "d"):
                extra = 5 * (faults[i] == "t")
                ways.append((1 + extra, "R", states[need, q]))
                if (rows[i][0][:1], q) in states:
                    ways.append((extra, "K", states[rows[i][0][:1], q]))
            here[q] = min((c + best[i + 1, to][0], e + best[i + 1, to][1]) for c, e, to in ways)
        for q in range(4):
            again, options, cost, word = q, [here[q]], 0, ""
            for _ in range(4):
                again, cost, word = states["a" if again == 2 else "u", again], cost + 5, word + "I"
                options.append((cost + here[again][0], word + here[again][1]))
            best[i, q] = min(options)
    cost, audit = best[0, 0]
    lines, i, q = [], 0, 0
    for e in audit:
        need = "a" if q == 2 else "u"
        name = "assistant" if need == "a" else "user"
        if e == "I":
            lines.append((name, ""))
            q = states[need, q]
        else:
            if e == "R":
                lines.append((name, rows[i][1]))
                q = states[need, q]
            elif e == "K":
                lines.append(rows[i])
                q = states[rows[i][0][:1], q]
            i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)), lines
    return cost, audit, faults, lines


def diagnosis(table):
    out = {}
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, rows in convs.items():
        mark = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r)))
        cost, audit, faults, lines = repaired([r[1:] for r in rows])
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), lines
    return out


def random_conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Umbra", "usher"])
            text = rng.choice(["Hello.", "What now?", "cut off", "cut", "", " \t\x0b", "Yes! ", "No.\n", "é\x1c", "\x85.", None, f"t{rng.randint(0, 9)}.", "a.\nb"])
            rows.append((None if conv == 3 else conv, rng.choice([turn, turn, turn, turn * 3, None, 0]), role, text))
    return rows + rows[::7]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, copies int, mark string, kind int")


def digests(spark, rows):
    hurt = conversation_repair.damaged(table(spark, rows))
    return {r[0]: tuple(r)[1:] for r in conversation_repair.repair_digests(hurt, conversation_repair.audited(hurt)).collect()}


@pytest.mark.parametrize("seed, convs, longest", [(1, 200, 9), (2, 8, 90)])
def test_repair_equals_brute_force(spark, seed, convs, longest):
    rows = random_conversations(seed, convs, longest)
    want = diagnosis(rows)
    assert digests(spark, rows) == {k: v[0] for k, v in want.items()}
    hurt = conversation_repair.damaged(table(spark, rows))
    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(hurt, conversation_repair.audited(hurt)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(turns[r["conv_id"]])
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(turns) == {k: v[1] for k, v in want.items() if v[1]}


def test_blocks_do_not_change_the_repair(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", "", "d!", "e"]) + str(rng.randint(0, 30)) * rng.randint(0, 1)) for _ in range(rng.randint(0, 25))]
        cost, audit, faults, _ = repaired(rows)
        items = [1 if f in ("b", "d") else (r[0][:1], f == "t") for r, f in zip(rows, faults)]
        for block in (1, 3, 8, 32):
            monkeypatch.setattr(conversation_repair, "BLOCK", block)
            assert conversation_repair.cheapest(items) == (cost, audit)


def test_repair_of_odd_tables(spark):
    assert digests(spark, []) == {}
    # crc32("5:1") % 20 decides: find turns that are dropped and repeated
    dropped = next(t for t in range(500) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert digests(spark, [(5, dropped, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", empty)}
    nulls = [(None, None, None, None), (7, None, None, None), (7, 2**62, "user", "Hi."), (7, -(2**62), "assistant", "Yo."), (8, 1, "user", "x" * 200_000 + ".")]
    assert digests(spark, nulls) == {k: v[0] for k, v in diagnosis(nulls).items()}
    # a conversation with many equal rows, and one with many different ones
    hot = [(1, 0, "user", "again.")] * 3000 + [(2, t, ("assistant", "user")[t % 2], f"turn {t}.") for t in range(3000)]
    assert digests(spark, hot) == {k: v[0] for k, v in diagnosis(hot).items()}


# --- token store


def library():
    got = Tokenizer.from_file(VOCABULARY)
    got.no_truncation()
    got.no_padding()
    return got


def test_codes_give_back_every_id_and_any_id():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 513, 70_000):
        for high in (1, 2, 300, 50_257, 2**32):
            ids = rng.integers(0, high, n).astype(np.uint32)
            for widths in (None, [8, 8], [3, 5, 2]):
                code = token_store.Code(token_store.pack(ids, widths))
                assert (code.all() == ids).all()
                places = rng.integers(0, n, min(n, 500)) if n else np.zeros(0, int)
                assert (code.at(places) == ids[places]).all()
    with pytest.raises(ValueError):
        token_store.Code(b"RIFF" + bytes(20))


def test_chunk_widths_are_the_cheapest():
    def cost(bits, widths):
        low = total = 0
        for width in widths:
            n = int(bits[low + 1 :].sum()) if low else int(bits.sum())
            total += n * (width + (1 + 64 / 512) * (low + width < top))
            low += width
        return total

    def splits(n):
        return [[n]] + [[k, *rest] for k in range(1, n) for rest in splits(n - k)]

    rng = np.random.default_rng(2)
    for _ in range(20):
        top = int(rng.integers(1, 9))
        bits = np.append(rng.integers(0, 50, top), rng.integers(1, 50))
        bits[0] = 0
        assert cost(bits, token_store.widths_for(bits)) == pytest.approx(min(cost(bits, s) for s in splits(top)))


def test_encoder_equals_the_library():
    encoder, plain = token_store.Encoder(open(VOCABULARY, encoding="utf-8").read()), library()
    rng = random.Random(2)
    alphabet = [*" \t\n\r\x1c\x85  　​ ab'sé日1.,!", "<|endoftext|>", "don't", "  ", "á"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + ["x <|endoftext|> y \n<|endoftext|>", "word " * 3000 + "x" * 5000]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def expected(rows):
    plain, at, out = library(), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_store_equals_the_library_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in registered.table(spark, FOLDER, "documents").collect()]
    got = registered.op13_token_store(spark, FOLDER)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(expected(rows))


def test_token_store_of_odd_rows(spark, tmp_path):
    rows = [(4, "long " * 20_000), (1, None), (None, "no id"), (2, ""), (3, "é ß 日本 <|endoftext|>\n\n x"), (3, "same id"), (3, "same id"), (9, "y" * 4000), *[(5, f"hot {i}") for i in range(300)]]
    for n, limit in ((1, 64), (2, 1 << 20)):
        path = str(tmp_path / f"t{n}")
        token_store.write_tokens(docs(spark, [(i, t, "en") for i, t in rows]).coalesce(1), path, VOCABULARY, block_ids=limit)
        got = token_store.read_tokens(spark, path).select("key", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
        plain = library()
        every = [i for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*plain.encode(t or "", add_special_tokens=False).ids, 0]]
        places = [0, 1, 5, 100, 100, len(every) - 1, len(every), -1, None, *range(200, 400)]
        asked = token_store.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "place bigint"))
        assert dict(map(tuple, asked.collect())) == {p: every[p] for p in places if p is not None and 0 <= p < len(every)}


def test_token_store_of_an_empty_table(spark, tmp_path):
    token_store.write_tokens(docs(spark, []), str(tmp_path / "none"), VOCABULARY)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0

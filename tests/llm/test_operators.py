"""The training-data operators against brute force, on odd rows, and on held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trialflow.llm import ann, bpe, lattice, licenses, mixing, near_dups, quality, shards, topk, toxicity
from trialflow.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, label string, slot int"
WORDS = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", "y", 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing column names."""
    base = "the quick brown fox jumps over the lazy dog while nobody looks at it today or tomorrow"
    rows = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, LONG, "b"), (5, base, "b"), (6, base.upper(), "b"), (7, base + " end", None),
            (None, base, "a"), (8, "one two", "a"), (9, "one two", "a"), (9, "one two", "a"), (10, "x" * 5000, "c"), (11, "é ß Σ 日本 \x1c <|endoftext|>", "c")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    return {n: registered.table(spark, FOLDER, n) for n in ("documents", "labels", "embeddings")}


def lowered(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def components(docs, num, den):
    sets = {}
    for i, t in docs:
        w = lowered(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and den * both >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(tables):
    docs = tables["documents"].select("doc_id", "text")
    want, sizes = components([(r[0], r[1]) for r in docs.collect()], 85, 100)
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_a_large_loose_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in rng.integers(0, 60, 1 + i % 3):
            words[k] = f"n{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    want, _ = components(rows, 85, 100)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk, most in ((512, 32), (16, 32), (16, 2)):
        monkeypatch.setattr(near_dups, "CHUNK", chunk)
        monkeypatch.setattr(near_dups, "MOST_PARTS", most)
        assert {r[0]: r[2] for r in near_dups.near_duplicates(docs).collect()} == want


def test_near_duplicates_of_odd_rows(odd, empty):
    got = [tuple(r) for r in near_dups.near_duplicates(odd).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == odd.count() and by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True)
    assert by[6][2:] == (5, False) and by[7][2:] == (5, False) and by[9][2:] == (8, False) and by[None][2:] == (None, True)
    assert near_dups.near_duplicates(empty).count() == 0
    assert sorted(near_dups.without_near_duplicates(odd).columns) == sorted(odd.columns)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u bigint, v bigint")
    assert {r["id"]: r["root"] for r in near_dups.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [float("nan")] * 8), (None, x[0].tolist()), (302, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 300, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 300, 50))
    few = frame.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0"), 5).count() == 2
    assert topk.top_k(frame.limit(0), frame.limit(0), 5).count() == 0


def test_neighbours_reach_the_recall(spark, tables):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in tables["embeddings"].collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for r in ann.nearest(tables["embeddings"], tables["embeddings"].where("vec_id % 20 = 0"), 10).groupBy("query_id").agg(
            F.collect_list("vec_id").alias("near"), F.max("rank").alias("last")).collect():
        d = np.sqrt(((x - x[ids == r["query_id"]]) ** 2).sum(axis=1))
        order = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != r["query_id"]][:10]
        hits, total = hits + len(set(order) & set(r["near"])), total + 10
        assert r["last"] == 10
    assert hits >= 0.9 * total
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(odd, odd, 10).orderBy("query_id").collect()] == [(3, 1, 4, 0.0), (4, 1, 3, 0.0)]
    assert ann.nearest(odd.limit(0), odd, 10).count() == 0


def test_bpe_equals_the_library(odd, empty, tables):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs in (tables["documents"], odd):
        texts = [r[0] or "" for r in docs.select("text").collect()]
        want = Counter((tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)) for e in library.encode_batch(texts, add_special_tokens=False))
        out = bpe.encoded(docs, path)
        assert Counter((tuple(r["ids"]), r["decoded"]) for r in out.collect()) == want
        assert "text" not in out.columns and "doc_id" in out.columns
    assert bpe.encoded(empty, path).count() == 0


def test_toxicity_on_held_out_labels(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = (registered.table(spark, folder, n) for n in ("documents", "labels"))
    out = registered.op1_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = [r["predicted"] for r in out if r["toxic"]]
    wrong = [r["predicted"] for r in out if not r["toxic"]]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.01
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    texts = ["you id-iot", "you idxiot there", "an i d i o t he is", "the tion of heat", "", None, "A" * 100_000]
    reader = toxicity.Reader(model)
    scores = reader.scores([t or "" for t in texts])
    assert (scores[:3] > 0.7).all() and (scores[3:] < 0.3).all()
    assert toxicity.toxicity_scores(odd, model).count() == odd.count() and toxicity.toxicity_scores(empty, model).count() == 0
    blank = toxicity.fit(empty, labels.select("doc_id", F.col("toxic").alias("label")))
    assert {r["score"] for r in toxicity.toxicity_scores(odd, blank).collect()} == {pytest.approx(1e-3, rel=0.1)}


def test_kernel_equals_brute_force():
    from itertools import combinations

    def slow(a, b):
        d, n = toxicity.DECAY, toxicity.LENGTH
        by = Counter()
        for w, side in ((a, 0), (b, 1)):
            for at in combinations(range(len(w)), n):
                by["".join(w[i] for i in at), side] += d ** (at[-1] - at[0] + 1)
        return sum(v * by[u, 1] for (u, side), v in by.items() if side == 0)

    pairs = [("idiot", "idxiot"), ("loweisch", "loweient"), ("abc", "abcd"), ("aaaaaa", "aaaa"), ("clown", "crown")]
    assert toxicity.kernel([a for a, _ in pairs], [b for _, b in pairs]) == pytest.approx([slow(a, b) for a, b in pairs], rel=1e-5)


def test_quality_on_held_out_labels(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    labels = registered.table(spark, folder, "labels")
    out = registered.op7_quality(spark, folder).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
    model = quality.fit(registered.table(spark, folder, "documents"), labels.select("doc_id", F.col("quality").alias("label")))
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(odd, model).collect()}
    assert got[1] == got[2] == pytest.approx(model.prior) and all(0 <= s <= 1 for s in got.values())
    assert quality.quality_scores(empty, model).count() == 0
    none = quality.fit(empty, labels.select("doc_id", F.col("quality").alias("label")).limit(0))
    assert {r["score"] for r in quality.quality_scores(odd, none).collect()} == {0.5}


def test_lattice_sums_all_segmentations():
    names, logp = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = lattice.Pieces(names, logp)

    def slow(word):
        if not word:
            return 1.0
        total = sum(math.exp(logp[pieces.at[word[:k]]]) * slow(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces.at)
        if word[0] not in pieces.at:
            total += math.exp(sum(logp[i] for i in pieces.fallback(word[0]))) * slow(word[1:])
        return total

    words = ["the", "running", "ﬁ", "日本x", "a", "onthe"]
    assert lattice.log10_of(words, pieces) == pytest.approx([math.log10(slow("▁" + w)) for w in words], rel=1e-9)
    long = "ab" * 40
    assert lattice.log10_of([long], pieces)[0] == pytest.approx(lattice._one_forward("▁" + long, pieces) / math.log(10))


def test_lattice_learns_from_long_words(spark):
    names, logp = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = lattice.Pieces(names, logp)
    word = "thequickbrownﬁsh" + "日本語の文章" * 8
    got = lattice.expected([word], np.array([3.0]), pieces)

    def total(i, step):
        moved = logp.copy()
        moved[i] += step
        return lattice._one_forward("▁" + word, lattice.Pieces(names, moved))

    # the expected uses are the gradient of the log probability
    used = np.argsort(-got)[:12]
    assert [got[i] for i in used] == pytest.approx([3 * (total(i, 1e-4) - total(i, -1e-4)) / 2e-4 for i in used], rel=1e-4)
    assert sum(got[pieces.at[n]] * len(n) for n in names if not n.startswith("<")) + sum(got[b] for b in pieces.byte) / 3 == pytest.approx(3 * (len(word) + 1))
    # both sides of the length where tables end agree
    short = "x" * 10 + "日本" * 14
    by_table, one = lattice.expected([short], np.array([2.0]), pieces), np.zeros(len(names))
    lattice._one_expected("▁" + short, 2.0, pieces, one)
    assert by_table == pytest.approx(one)
    # a table of one long word teaches its pieces: held-out copies score above the first weights
    docs = table(spark, [(1, word, "s"), (2, word, "s")])
    path = public_tokenizers.path("piece_bpe_32k.model")
    taught, first = (lattice.lattice_scores(docs, F.col("doc_id") == 1, path, rounds=r).where("doc_id = 2").first()["score"] for r in (2, 0))
    assert taught > first / 2


def test_lattice_base_score_equals_brute_force(spark, tables, odd, empty):
    rows = registered.op8_lattice_likelihood(spark, FOLDER).collect()
    texts = {r["doc_id"]: lowered(r["text"]) for r in tables["documents"].collect()}
    learns = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in learns for w in texts[i])
    n, v = sum(counts.values()) + len(learns), len(counts) + 1

    def share(c):
        return math.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    for r in rows:
        w = texts[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(share(counts[x]) for x in w) + share(len(learns)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(x in counts for x in w) + 1, n, r["doc_id"] not in learns)
        assert r["score"] < 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.lattice_scores(odd, F.lit(False), path).collect()
    assert len(got) == odd.count() and all(r["n_known"] == 0 for r in got)
    assert lattice.lattice_scores(empty, F.lit(True), path).count() == 0


def test_mix_keeps_every_row_and_its_targets(tables, odd, empty):
    weights = {f"src{i}": 1.0 + i % 3 for i in range(20)}
    docs = tables["documents"]
    rows = mixing.mixed(docs, weights, block_rows=1, period=200).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in rows] == list(range(docs.count()))
    slots = mixing.shares(weights, 200)
    for source, block, slot in mixing.schedule(slots):
        # never a whole block ahead of the target, nor behind it
        assert abs(block + 1 - (slot + 1) * slots[source] / 200) < 1
    assert sum(slots.values()) == 200
    got = mixing.mixed(odd).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(odd.count())) and mixing.mixed(empty).count() == 0
    assert mixing.in_mix_order(odd).columns == odd.columns
    part = mixing.mixed(odd, {"a": 1.0}, block_rows=1).orderBy("mix_position").collect()
    assert {r["source"] for r in part[:5]} == {"a"} and len(part) == odd.count()


def test_shards_keep_their_law(spark, tables, odd, empty):
    rows = registered.op10_shards(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)
    order = [r["doc_id"] for r in sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["slot"])]
    assert order != sorted(order)
    grown = {r["doc_id"]: r["shard_id"] for r in shards.sharded(tables["documents"], 9).collect()}
    assert grown == {r["doc_id"]: r["grown_shard"] for r in rows}
    out = shards.sharded(odd, 2, bucket_bytes=1000)
    assert out.count() == odd.count() and out.columns[:8] == odd.columns[:8] and shards.sharded(empty).count() == 0


def test_license_scan(spark, odd, empty, tables):
    model = licenses.fit(tables["documents"])
    lines = ["Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0", "the driver has a license plate", "words of no kind\nLicensed under CC BY-NC 4.0.", None, ""]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(lines)])
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.license_paragraphs(docs, model).collect()}
    assert got == {(0, 0): "mit", (1, 0): "gpl-3.0", (3, 1): "cc-by-nc"}
    seen = {(r["doc_id"], r["paragraph"]) for r in licenses.license_paragraphs(tables["documents"], model).collect()}
    known = licenses.paragraphs(tables["documents"]).where("line rlike 'icense'").collect()
    assert {(r["doc_id"], r["paragraph"]) for r in known} <= seen
    assert licenses.license_paragraphs(odd, model).count() == 0 and licenses.license_paragraphs(empty, model).count() == 0


def test_license_pattern_finds_what_the_terms_hold(spark, tables):
    model = licenses.fit(tables["documents"])
    lines = ["permission  IS granted", "permissions is", "xmit mit", "xmit", "CC-BY 4.0", "cc by\t-4", "thislicense", "", "the rights, reserved", "écharge", "copy; modify", "gnu", "GNU... general", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, line string")
    docs = docs.unionByName(licenses.paragraphs(tables["documents"]).select(F.col("doc_id").cast("int"), "line"))
    own = F.arrays_overlap(licenses.terms(F.col("line")), F.array(*[F.lit(t) for t in model.used()]))
    got = docs.select(own.alias("own"), F.lower("line").rlike(model.pattern()).alias("found"))
    assert got.where("NOT own <=> found").count() == 0 and got.where("found").count() > 5


def test_licenses_planted_among_ordinary_paragraphs(spark, tables):
    model = licenses.fit(tables["documents"])
    planted = [(k, t) for k, texts in licenses.FAMILIES.items() for t in texts if k not in ("gpl-2.0", "lgpl")]
    docs = table(spark, [(i, f"first words\n\nAvailable under {t}.\n\nlast words", "s") for i, (_, t) in enumerate(planted)] + [(900 + i, x, "s") for i, x in enumerate(licenses.OTHER)])
    # copies are reported each, and a third of all rows may be one text
    docs = docs.unionByName(table(spark, [(2000 + i, "Released under the MIT License.", "s") for i in range(30)]))
    rows = licenses.license_paragraphs(docs, model).collect()
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in rows}
    found = [got.get((i, 2)) == k for i, (k, _) in enumerate(planted)]
    assert np.mean(found) >= 0.9
    # a look-alike may be reported, as "version 3 of the report" is, but the templates never confirm it
    assert not any(r["confirmed"] for r in rows if 900 <= r["doc_id"] < 2000)
    assert sum(900 <= d < 2000 for d, _ in got) <= 1
    assert all(got[2000 + i, 0] == "mit" for i in range(30))


def test_license_of_wrapped_lines(spark, tables):
    model = licenses.fit(tables["documents"])
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    gpl = "# This file comes under the GNU General Public\n# License, version 3\n#\n# Another paragraph of the head"
    docs = table(spark, [(1, "first words\n\n" + bsd + "\n\nlast words", "s"), (2, gpl, "s"), (3, "a line\nand one more\n\nand a last one", "s")])
    got = {(r["doc_id"], r["paragraph"], r["lines"]): (r["family"], r["confirmed"]) for r in licenses.license_paragraphs(docs, model).collect()}
    assert got[1, 2, 3] == ("bsd", True) and got[2, 0, 2] == ("gpl-3.0", True)
    assert not any(k[0] == 3 for k in got)
    runs = licenses.passages(docs.select("doc_id", "text")).collect()
    assert {(r["doc_id"], r["paragraph"], r["lines"]) for r in runs} == {(1, 2, 3), (2, 0, 2), (3, 0, 2)}
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a "), (1 << 20) + 5), F.lit("mit license")).alias("t"))
    assert long.select(F.array_contains(licenses.terms(F.col("t")), "mit license")).first()[0]


def test_neighbours_of_every_length_and_past_small_leaves(spark):
    rng = np.random.default_rng(8)
    # one group of copies, outliers that stand alone, and vectors of two lengths
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, (rng.normal(size=3) * 1e4).tolist()) for i in range(60)]
    rows += [(1000 + i, rng.normal(size=2).tolist()) for i in range(30)] + [(2000, [float("nan"), 1.0]), (2100, [0.0, 0.0]), (2200, None), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, id int, leaf string, own double")
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 100 = 0"), k=10, sample=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 400, 1000}
    for q, found in got.items():
        v = dict(rows)[q]
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i is not None and w is not None and len(w) == len(v) and i not in (q, 2000, 2100))
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert q == 400 or [i for _, i, _ in sorted(found)] == [i for _, i in near[:10]]


@pytest.mark.parametrize("large", [1e6, 2e7, 1e12, 1e20, 1e300])
def test_top_k_is_exact_for_large_components(spark, large):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3)) * 40
    x[:, 0] = large + rng.integers(0, 3, 60)
    x[7, 0] = -large
    rows = [(i, v.tolist(), 5, "z") for i, v in enumerate(x)] + [(5, x[5].tolist(), 5, "z"), (90, [float("inf")] * 3, 5, "z")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cb int, g string")
    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows[:-1]]
    most = 2**63 - 1
    for q in (0, 20, 40):
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, dict(whole)[q])))), i) for i, v in whole if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:4])]

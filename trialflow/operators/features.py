"""Structural features of text inputs: bit strings, Hamming graphs, integral files."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.memory import integral_scalars
from trialflow.functions.scaled import keyed_join, previous
from trialflow.functions.stats import finite
from trialflow.operators.rules import needs, reasons, rule

WORD_BITS = 60

# -- bit strings ---------------------------------------------------------------


def bitstring_violations(
    strings: DataFrame, expected_length: int | None = None
) -> DataFrame:
    """``file, rule``: non-binary text, unequal or unexpected length, duplicates."""
    bad_text = strings.where(~F.col("bits").rlike("^[01]+$")).select(
        "file", F.lit("not_binary").alias("rule"))
    per_file = strings.groupBy("file").agg(
        F.min(F.length("bits")).alias("_lo"), F.max(F.length("bits")).alias("_hi"))
    lengths = per_file.where("_lo <> _hi").select("file", F.lit("unequal_length").alias("rule"))
    repeated = (
        strings.groupBy("file", "bits").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("file", F.lit("duplicate").alias("rule"))
    )
    out = bad_text.unionByName(lengths).unionByName(repeated)
    if expected_length is not None:
        wrong = per_file.where((F.col("_lo") != expected_length) | (F.col("_hi") != expected_length))
        out = out.unionByName(wrong.select("file", F.lit("unexpected_length").alias("rule")))
    return out.distinct()


def occupancy(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("bigint")


def bitstring_stats(strings: DataFrame, by: str = "file") -> DataFrame:
    """Count, distinct, length and occupancy statistics per file.

    Equal strings collapse first, so a hot file or a hot copy combines map-side.
    """
    distinct = strings.groupBy(by, "bits").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_o", occupancy(F.col("bits")))
    n, o = F.col("_n"), F.col("_o")
    total = F.sum(n)
    sums = distinct.groupBy(by).agg(
        total.alias("count"), F.count(F.lit(1)).alias("unique_count"),
        F.max(F.length("bits")).cast("bigint").alias("bit_length"),
        F.min(o).alias("occupancy_min"), F.max(o).alias("occupancy_max"),
        F.sum(n * o).alias("_s"), F.sum(n * o * o).alias("_q"),
    )
    # integer sums: count * squares - sum * sum is exact before the one division
    count, s, q = F.col("count"), F.col("_s"), F.col("_q")
    return sums.select(
        by, "count", "unique_count", "bit_length", "occupancy_min", "occupancy_max",
        (s / count).alias("occupancy_mean"),
        ((count * q - s * s) / (count * count)).alias("occupancy_variance"),
    )


def unsorted_files(strings: DataFrame, block: int = 65_536) -> DataFrame:
    """Files whose strings are not in ascending order, with the number of inversions."""
    out = previous(strings, ["file"], ("pos",), [F.floor(F.col("pos") / block)], ("bits",))
    return out.where(F.col("prev_bits") > F.col("bits")).groupBy("file").agg(
        F.count(F.lit(1)).alias("inversions"))


def prefix_variants(elements: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Each element once per registered prefix size above its position (from 0)."""
    wanted = F.array(*[F.lit(int(s)) for s in sizes])
    pos = F.col("pos")
    return elements.withColumn("size", F.explode(F.filter(wanted, lambda s: s > pos)))


def variant_manifest(variants: DataFrame) -> DataFrame:
    """Per variant: line count, configurations, byte count, SHA-256 of its lines.

    A variant holds at most its registered size, which bounds the list.
    """
    grouped = variants.groupBy("file", "size").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.array_sort(F.collect_list(F.struct("pos", "bits"))).alias("_l"),
    )
    text = F.concat_ws("", F.transform("_l", lambda x: F.concat(x["bits"], F.lit("\n"))))
    return grouped.select(
        "file", "size", "line_count",
        (F.col("line_count") * F.col("line_count")).alias("n_configurations"),
        F.octet_length(text).cast("bigint").alias("size_bytes"), F.sha2(text, 256).alias("sha256"),
        (F.col("line_count") == F.col("size")).alias("complete"),
    )


def inventory_rules(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file, rule`` where per-file statistics differ from the declared manifest."""
    declared = manifest.select("file", *[F.col(c).alias(f"_d_{c}") for c in manifest.columns if c != "file"])
    joined = declared.join(observed, "file", "left")
    checks = [
        rule("file_missing", F.col("count").isNull()),
        *[
            rule(f"{c}_differs", F.col("count").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_d_{c}")))
            for c in manifest.columns if c != "file"
        ],
        rule("duplicates", F.coalesce(F.col("unique_count") < F.col("count"), F.lit(False))),
        rule("occupancy_not_constant",
             F.coalesce(F.col("occupancy_min") != F.col("occupancy_max"), F.lit(False))),
    ]
    return joined.select("file", F.explode(reasons(checks)).alias("rule"))


# -- Hamming graph -------------------------------------------------------------


def bit_words(bits: Column, width: int) -> Column:
    """Bit string of ``width`` characters as an array of bigint words."""
    starts = range(0, width, WORD_BITS)
    return F.array(*[
        F.conv(F.substring(bits, s + 1, min(WORD_BITS, width - s)), 2, 10).cast("bigint")
        for s in starts
    ])


def _distance(left: str, right: str, words: int) -> Column:
    total = None
    for i in range(words):
        term = F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i]))
        total = term if total is None else total + term
    return total


def pair_counts(strings: DataFrame, budget: int | None = None) -> DataFrame:
    """Strings and unordered pairs of every file, and whether the pairs fit a budget (if any)."""
    counts = strings.groupBy("file").agg(F.count(F.lit(1)).alias("determinants"))
    n = F.col("determinants")
    pairs = F.call_function("div", n * (n - 1), F.lit(2).cast("bigint"))
    fits = F.lit(True) if budget is None else pairs <= budget
    return counts.withColumn("unordered_pair_comparisons", pairs).withColumn("within_budget", fits)


#: possible neighbours up to which each is looked up; strings up to which the lookup is broadcast
MOST_FLIPS, MOST_BROADCAST = 4_096, 4_000_000


def _flipped(strings: DataFrame, width: int, distances: Sequence[int], budget: int | None = None, unequal: bool = False) -> DataFrame:
    """Directed pairs at the given distances: every string with so many bits flipped, joined by value.

    For widths of one word. The strings are broadcast up to a checked number, so the
    flipped ones, many per string, are not shuffled; beyond it they are.
    """
    chosen = strings
    if budget is not None:
        small = pair_counts(strings, budget).where("within_budget").select("file")
        chosen = keyed_join(strings, small, ["file"], "left_semi", null_keys=False)
    nodes = chosen.select("file", F.col("pos").alias("node"), bit_words(F.col("bits"), width)[0].alias("word"))
    tasks = nodes.sparkSession.sparkContext.defaultParallelism * 4
    # one literal text: thousands of literals would take the planner longer than the join
    masks = F.split(F.lit(",".join(str(sum(1 << i for i in bits)) for k in distances for bits in combinations(range(width), k))), ",").cast("array<bigint>")
    flips = nodes.repartition(tasks, "file", "node").select("file", F.col("node").alias("a"), "word", F.explode(masks).alias("mask"))
    if unequal:
        # half of an even number of flips among the set bits keeps their number
        flips = flips.where(F.bit_count(F.col("word").bitwiseAND(F.col("mask"))) * 2 != F.bit_count("mask"))
    flips = flips.select("file", "a", F.col("word").bitwiseXOR(F.col("mask")).alias("word"), F.bit_count("mask").cast("bigint").alias("dist"))
    found = nodes.withColumnRenamed("node", "b")
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    return keyed_join(flips, found, ["file", "word"], null_keys=False).select("file", "a", "b", "dist")


def hamming_neighbours(
    strings: DataFrame, width: int, radius: int = 4, budget: int | None = None, unequal: bool = False
) -> DataFrame:
    """Directed pairs ``(file, a, b, dist)`` of a file with ``1 <= dist <= radius``.

    Strings within ``radius`` agree on at least one of ``radius + 1`` bands, so equal
    bands are joined and a pair is kept at its first equal band only. A caller may set a
    budget of unordered pairs per file; files beyond it then take no part. ``unequal``
    keeps only pairs whose strings have different numbers of set bits.

    Narrow strings have few possible neighbours (2,516 at 16 bits), so every one is looked
    up by its value instead (:func:`_flipped`): a band of few bits is equal far too often.
    """
    if sum(comb(width, k) for k in range(1, radius + 1)) <= MOST_FLIPS:
        return _flipped(strings, width, range(1, radius + 1), budget, unequal)
    bands = radius + 1
    edges = [width * i // bands for i in range(bands + 1)]
    slices = [F.substring("bits", edges[i] + 1, edges[i + 1] - edges[i]) for i in range(bands)]
    chosen = strings
    if budget is not None:
        small = pair_counts(strings, budget).where("within_budget").select("file")
        chosen = keyed_join(strings, small, ["file"], "left_semi", null_keys=False)
    nodes = chosen.select(
        "file", F.col("pos").alias("node"), bit_words(F.col("bits"), width).alias("words"),
        F.array(*slices).alias("bands"), occupancy(F.col("bits")).alias("set"),
    )
    keyed = nodes.select("*", F.posexplode("bands").alias("band", "value"))
    l = keyed.select(*[F.col(c).alias(f"l_{c}") for c in keyed.columns])
    r = keyed.select(*[F.col(c).alias(f"r_{c}") for c in keyed.columns])
    first = None
    for i in range(bands):
        same = F.col("l_bands")[i] == F.col("r_bands")[i]
        first = F.when(same, i) if first is None else first.when(same, i)
    words = (width + WORD_BITS - 1) // WORD_BITS
    distance = _distance("l_words", "r_words", words)
    joined = l.join(
        r,
        (F.col("l_file") == F.col("r_file")) & (F.col("l_band") == F.col("r_band"))
        & (F.col("l_value") == F.col("r_value")) & (F.col("l_node") != F.col("r_node"))
        & (first == F.col("l_band")) & (distance <= radius)
        & ((F.col("l_set") != F.col("r_set")) if unequal else F.lit(True)),
    )
    return joined.select(
        F.col("l_file").alias("file"), F.col("l_node").alias("a"), F.col("r_node").alias("b"),
        distance.cast("bigint").alias("dist"),
    )


def string_degrees(strings: DataFrame, width: int) -> DataFrame:
    """``file, node, s, d``: how many strings of the file stand at distance 2 and 4 of each.

    Two strings with equally many set bits have distance 2 iff they are equal less one set
    bit each, and distance 4 iff they are equal less two and not less one. So the sizes of
    the groups of equal keys give both degrees without a pair: a neighbour at distance 2
    shares one key of the first kind and, with n set bits, n - 1 of the second. A group
    holds at most width squared strings. Only pairs with unequal numbers of set bits, in
    files that have such, are found by :func:`hamming_neighbours`.

    Narrow strings are looked up with two and with four bits flipped instead.
    """
    if 0 < sum(comb(width, k) for k in (2, 4)) <= MOST_FLIPS:
        near = _flipped(strings, width, (2, 4))
        counted = near.groupBy("file", F.col("a").alias("node")).agg(F.count_if(F.col("dist") == 2).alias("s"), F.count_if(F.col("dist") == 4).alias("d"))
        zero = F.lit(0).cast("bigint")
        none = strings.select("file", F.col("pos").alias("node"), zero.alias("s"), zero.alias("d"))
        return none.unionByName(counted).groupBy("file", "node").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    masks = [[(1 << (min(WORD_BITS, width - w) - 1 - (i - w))) if w <= i < w + WORD_BITS else 0 for w in range(0, width, WORD_BITS)] for i in range(width)]
    every = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in m]) for m in masks])
    at = F.filter(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring("bits", i, F.lit(1)) == "1")
    nodes = strings.select("file", F.col("pos").alias("node"), bit_words(F.col("bits"), width).alias("words"), F.transform(at, lambda i: F.element_at(every, i)).alias("masks"))
    less = lambda words, mask: F.zip_with(words, mask, lambda a, b: a.bitwiseXOR(b))
    one = F.transform("masks", lambda m: less(F.col("words"), m))
    # two set bits, the earlier one first
    two = F.flatten(F.transform("masks", lambda m, i: F.transform(
        F.slice("masks", i + 2, F.size("masks")), lambda k: less(less(F.col("words"), m), k))))
    keys = nodes.select("file", "node", F.size("masks").alias("n"), F.explode(F.array(
        F.struct(F.lit(1).alias("level"), one.alias("keys")), F.struct(F.lit(2).alias("level"), two.alias("keys")))).alias("k"))
    keys = keys.select("file", "node", "n", "k.level", F.explode("k.keys").alias("key"))
    others = F.count(F.lit(1)).over(Window.partitionBy("file", "level", "key")) - 1
    shared = keys.withColumn("others", others).groupBy("file", "node", "n").agg(
        F.sum(F.when(F.col("level") == 1, F.col("others")).otherwise(0)).alias("s"), F.sum(F.when(F.col("level") == 2, F.col("others")).otherwise(0)).alias("t"))
    equal = shared.select("file", "node", "s", (F.col("t") - (F.col("n") - 1) * F.col("s")).alias("d"))
    mixed = strings.groupBy("file").agg(F.min(occupancy(F.col("bits"))).alias("lo"), F.max(occupancy(F.col("bits"))).alias("hi")).where("lo <> hi").select("file")
    near = hamming_neighbours(keyed_join(strings, mixed, ["file"], "left_semi", null_keys=False), width, unequal=True)
    unequal = near.groupBy("file", F.col("a").alias("node")).agg(F.count_if(F.col("dist") == 2).alias("s"), F.count_if(F.col("dist") == 4).alias("d"))
    zero = F.lit(0).cast("bigint")
    none = strings.select("file", F.col("pos").alias("node"), zero.alias("s"), zero.alias("d"))
    return none.unionByName(equal).unionByName(unequal).groupBy("file", "node").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))


def degree_stats(
    strings: DataFrame, neighbours: DataFrame | None, budget: int | None = None, degrees: DataFrame | None = None
) -> DataFrame:
    """Single (distance 2) and double (distance 4) degrees per file.

    Isolated strings count with degree 0. Files beyond a budget keep their row, with
    ``within_budget`` false and every degree NULL; that column is there only with a budget.
    ``degrees`` are those of :func:`string_degrees`, in place of neighbours.
    """
    per_node = degrees if degrees is not None else neighbours.groupBy("file", F.col("a").alias("node")).agg(
        F.count_if(F.col("dist") == 2).alias("s"), F.count_if(F.col("dist") == 4).alias("d"))
    degrees = per_node.groupBy("file").agg(
        F.count(F.lit(1)).alias("_touched"),
        F.sum("s").alias("directed_single_edges"), F.sum("d").alias("directed_double_edges"),
        F.min("s").alias("_s_lo"), F.max("s").alias("_s_hi"),
        F.min("d").alias("_d_lo"), F.max("d").alias("_d_hi"),
    )
    zero = F.lit(0).cast("bigint")
    out = pair_counts(strings, budget).join(degrees, "file", "left")
    n = F.col("determinants")
    possible = n * (n - 1)
    untouched = F.coalesce(F.col("_touched"), zero) < n
    s, d = (F.coalesce(F.col(f"directed_{k}_edges"), zero) for k in ("single", "double"))
    stats = [
        s.alias("directed_single_edges"), d.alias("directed_double_edges"),
        F.when(untouched, zero).otherwise(F.col("_s_lo")).alias("single_degree_min"),
        F.coalesce("_s_hi", zero).alias("single_degree_max"), (s / n).alias("single_degree_mean"),
        F.when(untouched, zero).otherwise(F.col("_d_lo")).alias("double_degree_min"),
        F.coalesce("_d_hi", zero).alias("double_degree_max"), (d / n).alias("double_degree_mean"),
        F.when(possible > 0, s / possible).otherwise(0.0).alias("single_edge_density"),
        F.when(possible > 0, d / possible).otherwise(0.0).alias("double_edge_density"),
    ]
    head = ["file", "determinants", "unordered_pair_comparisons"]
    if budget is None:
        return out.select(*head, *stats)
    flagged = out.select(*head, "within_budget", *stats)
    degree_names = flagged.columns[len(head) + 1 :]
    return flagged.select(*head, "within_budget", *[F.when(F.col("within_budget"), F.col(c)).alias(c) for c in degree_names])


# -- integral files ------------------------------------------------------------

HEADER_FIELDS = ("NORB", "NELEC", "MS2", "ORBSYM", "ISYM")


def integral_shape(i: Column, j: Column, k: Column, l: Column) -> Column:
    """Kind of one integral record by which indices are zero."""
    head, tail = (i > 0) & (j > 0), (k > 0) & (l > 0)
    none_tail = (k == 0) & (l == 0)
    return (
        F.when((i == 0) & (j == 0) & none_tail, "core").when(head & none_tail, "one_electron")
        .when(head & tail, "two_electron").otherwise("invalid")
    )


def _terminator(line: Column) -> Column:
    """Position (from 1) of ``&END`` or ``/``, whichever comes first; 0 without one."""
    end, slash = F.instr(F.upper(line), "&END"), F.instr(line, "/")
    return F.when((end > 0) & (slash > 0), F.least(end, slash)).otherwise(F.greatest(end, slash))


def split_integral_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers(file, text), body(file, pos, line), violations(file, rule))``.

    The first line that is not blank must begin the namelist, which ends at the first
    terminator. Body lines stay rows, however long a file is; only the header lines of a
    file are put together.
    """
    marked = lines.withColumn("_cut", _terminator(F.col("line")))
    ends = marked.groupBy("file").agg(
        F.min(F.when(F.col("_cut") > 0, F.col("pos"))).alias("_end"),
        F.min(F.when(F.upper("line").rlike(r"^\s*&FCI"), F.col("pos"))).alias("_start"),
        F.min(F.when(F.col("line").rlike(r"\S"), F.col("pos"))).alias("_first"),
    )
    sound = F.coalesce((F.col("_start") <= F.col("_end")) & (F.col("_start") == F.col("_first")), F.lit(False))
    bad = ends.where(~sound).select(
        "file",
        F.when(F.col("_start").isNull(), "namelist_missing").when(F.col("_first") < F.col("_start"), "namelist_not_first")
        .otherwise("namelist_unterminated").alias("rule"),
    )
    placed = keyed_join(marked, ends.where(sound), ["file"], "inner", null_keys=False)
    head = placed.where((F.col("pos") >= F.col("_start")) & (F.col("pos") <= F.col("_end"))).select(
        "file", "pos",
        F.when(F.col("_cut") > 0, F.expr("substring(line, 1, _cut - 1)")).otherwise(F.col("line")).alias("line"),
    )
    headers = head.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l")
    ).select("file", F.concat_ws("\n", F.transform("_l", lambda x: x["line"])).alias("text"))
    body = placed.where((F.col("pos") > F.col("_end")) & (F.trim("line") != "")).select("file", "pos", "line")
    return headers, body, bad


def parse_headers(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header integers and symmetry list, with contract violations per file."""
    upper = F.upper("text")

    def field(name: str) -> Column:
        found = F.regexp_extract(upper, rf"(?s)\b{name}\s*=([^=]*?)(?=\b[A-Z][A-Z0-9]*\s*=|$)", 1)
        return F.filter(F.split(F.trim(found), r"[\s,]+"), lambda t: t != "")

    parsed = headers.select("file", "text", *[field(n).alias(f"_{n}") for n in HEADER_FIELDS])
    for name in HEADER_FIELDS:
        parsed = parsed.withColumn(
            f"_i_{name}", F.transform(f"_{name}", lambda t: t.try_cast("bigint")))
    out = parsed.select(
        "file", "text",
        *[F.get(F.col(f"_i_{n}"), F.lit(0)).alias(n.lower()) for n in HEADER_FIELDS if n != "ORBSYM"],
        F.col("_i_ORBSYM").alias("orbsym"),
        *[F.size(f"_{n}").alias(f"_n_{n}") for n in HEADER_FIELDS],
        *[F.exists(f"_i_{n}", lambda x: x.isNull()).alias(f"_x_{n}") for n in HEADER_FIELDS],
    )
    c = F.col
    structure = []
    for n in HEADER_FIELDS:
        structure += [
            rule(f"{n}_missing", c(f"_n_{n}") == 0), rule(f"{n}_not_integer", c(f"_x_{n}")),
            rule(f"{n}_repeated", F.size(F.regexp_extract_all(upper, F.lit(rf"\b{n}\s*="), 0)) > 1),
        ]
        if n != "ORBSYM":
            structure.append(rule(f"{n}_not_scalar", c(f"_n_{n}") > 1))
    values = [
        needs("norb_not_positive", c("norb") > 0),
        needs("nelec_out_of_range", (c("nelec") >= 0) & (c("nelec") <= c("norb") * 2)),
        needs("nelec_ms2_inconsistent", (F.abs("ms2") <= c("nelec")) & ((c("nelec") + c("ms2")) % 2 == 0)),
        needs("orbsym_length", F.size("orbsym") == c("norb")),
    ]
    marked = out.withColumn("_bad", reasons([*structure, *values]))
    good = marked.where(F.size("_bad") == 0).select("file", "norb", "nelec", "ms2", "isym", "orbsym")
    return good, marked.select("file", F.explode("_bad").alias("rule"))


def parse_integrals(body: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integral rows of sound lines, and ``file, pos, rule`` for the others."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = body.select("file", "pos", fields.alias("f")).select(
        "file", "pos", F.size("f").alias("_n"),
        F.translate(F.get("f", F.lit(0)), "Dd", "Ee").try_cast("double").alias("value"),
        *[F.get("f", F.lit(k + 1)).try_cast("bigint").alias(x) for k, x in enumerate("ijkl")],
    )
    joined = keyed_join(rows, headers.select("file", "norb"), ["file"], "inner", null_keys=False)
    c = F.col
    indices = [c(x) for x in "ijkl"]
    in_range = F.lit(True)
    for x in indices:
        in_range = in_range & x.between(F.lit(0), c("norb"))
    checks = [
        rule("field_count", c("_n") != 5),
        rule("value_not_finite", (c("_n") == 5) & ~finite(c("value"))),
        rule("index_out_of_range", (c("_n") == 5) & ~F.coalesce(in_range, F.lit(False))),
        rule("index_shape", F.coalesce(in_range & (c("_n") == 5), F.lit(False))
             & (integral_shape(*indices) == "invalid")),
    ]
    marked = joined.withColumn("_bad", reasons(checks))
    good = marked.where(F.size("_bad") == 0).select(
        "file", "pos", "value", *"ijkl", integral_shape(*indices).alias("shape"))
    return good, marked.select("file", "pos", F.explode("_bad").alias("rule"))


def integral_stats(integrals: DataFrame, headers: DataFrame) -> DataFrame:
    """Counts per shape, zeros, absolute sum and maximum, and size-derived scalars."""
    kinds = ("core", "one_electron", "two_electron")
    sums = integrals.groupBy("file").agg(
        F.count(F.lit(1)).alias("integral_records"),
        *[F.count_if(F.col("shape") == k).alias(f"{k}_integrals") for k in kinds],
        F.count_if(F.col("value") == 0).alias("exact_zero_integrals"),
        F.sum(F.abs("value")).alias("sum_abs_integrals"),
        F.max(F.abs("value")).alias("max_abs_integral"),
    )
    scalars = integral_scalars(F.col("norb"))
    out = headers.join(sums, "file").select("*", *[v.alias(k) for k, v in scalars.items()])
    return out.withColumn(
        "two_electron_fill_density", F.col("two_electron_integrals") / F.col("compact_two_electron_slots"))

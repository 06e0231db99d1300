"""Phrase collocations by top-order marginalisation.

Lead columns hold each word with those that follow it in its piece, padded at the piece's
end. Only these longest windows are counted; ROLLUP sums them to every shorter prefix,
and since each occurrence of a phrase starts at one word, a prefix's sum is the phrase's
count. No n-gram length is exploded on its own.

Two rounds keep the shuffles small without losing a count. Windows of two words give word
and pair counts. The longest windows then start only at pairs with enough support and are
padded from the first pair on that lacks it: no phrase with support holds such a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialflow.session import materialized

#: pairs with support whose hashes (16 bytes each) are broadcast; beyond it the same
#: lookup is a shuffled join
BROADCAST_PAIRS = 4_000_000
LONGEST = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pieces(docs: DataFrame) -> DataFrame:
    """lang (null: ``und``) and the words w of each piece that has any; A-Z in lower case."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    parts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    # without blanks at the edges, only a piece of blanks has an empty word
    return parts.select("lang", F.split(F.trim(F.col("piece"), F.lit(" \t")), r"[\x20\x09]+").alias("w")).where(F.col("w")[0] != "")


def windows(found: DataFrame, width: int) -> DataFrame:
    """One row per word: w1 and the words that lead on from it, the empty string as padding."""
    names = [f"w{k}" for k in range(1, width + 1)]
    leads = [F.slice("w", k, F.size("w")).alias(n) for k, n in enumerate(names, 1)]
    rows = found.select("lang", *leads).select("lang", F.inline(F.arrays_zip(*names)))
    return rows.select("lang", *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def _rolled(rows: DataFrame, fixed: str, rolled: str, width: int, support: int) -> DataFrame:
    """Counts of all prefixes with support, and the totals per language where they are rolled up."""
    names = [f"w{k}" for k in range(1, width + 1)]
    counts = rows.sparkSession.sql(f"SELECT lang, {', '.join(names)}, count(*) AS a FROM {{rows}} GROUP BY {fixed}, ROLLUP({rolled})", rows=rows)
    # a rolled-up word is null, a padded one empty; prefixes that end in padding are no phrases
    whole = ~F.array_contains(F.array_compact(F.array(*names)), "")
    return counts.where(F.col("w1").isNull() | (whole & (F.col("a") >= support))).select(
        "lang", F.size(F.array_compact(F.array(*names))).alias("words"), F.concat_ws(" ", *names).alias("phrase"), "a")


def phrase_counts(docs: DataFrame, support: int, longest: int = LONGEST) -> DataFrame:
    """lang, words, phrase (space-joined), a: every phrase of 1 to ``longest`` (2 or more)
    words that occurs at least ``support`` times, and each language's total as words = 0."""
    found = pieces(docs)
    short = materialized(_rolled(windows(found, 2), "lang", "w1, w2", 2, support))
    if longest < 3:
        return short
    word = F.split("phrase", " ")
    pairs = short.where("words = 2").select(F.xxhash64("lang", word[0], word[1]).alias("h")).distinct()
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    rows = windows(found, longest)
    # a hash met by chance costs a counted window, never a wrong count
    rows = rows.withColumn("h", F.xxhash64("lang", "w1", "w2")).join(pairs, "h", "left_semi").drop("h").where("w2 <> ''")
    for k in range(3, longest + 1):
        known = pairs.select(F.col("h").alias("g"), F.lit(True).alias("ok"))
        rows = rows.withColumn("g", F.when((F.col(f"w{k - 1}") != "") & (F.col(f"w{k}") != ""), F.xxhash64("lang", f"w{k - 1}", f"w{k}")))
        rows = rows.join(known, "g", "left").withColumn(f"w{k}", F.when(F.col("ok"), F.col(f"w{k}")).otherwise("")).drop("g", "ok")
    long = _rolled(rows, "lang, w1, w2", ", ".join(f"w{k}" for k in range(3, longest + 1)), longest, support)
    return short.unionByName(long.where("words > 2"))


def collocations(docs: DataFrame, support: int = 30, longest: int = LONGEST, scale: int = 2_000_000, covered: int = 80, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``best`` phrases.

    A candidate has 2 to ``longest`` words and occurs a >= ``support`` times. Its score is
    the lowest over its cuts of floor(``scale`` * a / (l + r)), with l and r the counts of
    both parts (ties: the shortest first part). Candidates inside a longer one that occurs
    at least ``covered`` per cent as often are dropped. Ties in score go by a, then by the
    phrase in byte order. Sums and products are decimals of 38 digits.

    A null text is empty, a null language is ``und``; repeated rows count each time;
    texts without words, and empty tables, give nothing. Other columns are not read.
    """
    counts = materialized(phrase_counts(docs, support, longest))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    known = counts.where("words > 0").select("lang", "phrase", "a")
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads, rests = (known.select("lang", F.col("phrase").alias(n), F.col("a").alias(c)) for n, c in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = F.floor(F.expr(f"(cast({scale} AS decimal(10,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where("words > 2").select("lang", "words", "w", F.col("a").alias("b"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = longer.select("lang", "w", "b", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "b").groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * exact("b") < covered * exact("a")))

    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= best).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").cast("bigint").alias("score"))

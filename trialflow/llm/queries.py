"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.llm import ann, bpe, collocations, conversation_repair, lattice, licenses, mixing, near_dups, quality, shards, token_store, topk, toxicity
from trialflow.llm.text import remainder
from trialflow.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: batches that pass through Python hold so many texts
TEXTS_PER_BATCH = 1000


def _register(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, fold: int):
    return F.coalesce(remainder(F.col("doc_id"), modulus) == fold, F.lit(False))


def _labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, fold: int) -> DataFrame:
    """The labels that a fit may see."""
    rows = table(spark, sf_dir, "labels").where(~_held_out(modulus, fold))
    return rows.select("doc_id", F.col(column).alias("label"))


def _judged(scores: DataFrame, modulus: int, fold: int, limit: float) -> DataFrame:
    return scores.select("doc_id", _held_out(modulus, fold).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


@_register()
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    return _judged(toxicity.toxicity_scores(docs, model), 3, 1, 0.7)


@_register("""
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), p -> p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5
""")
def op2_exact_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


@_register()
def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_register()
def op4_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


@_register()
def op5_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.license_paragraphs(docs, licenses.fit(docs))


@_register()
def op6_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


@_register()
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, _labels(spark, sf_dir, "quality", 5, 0))
    return _judged(quality.quality_scores(docs, model), 5, 0, 0.3)


@_register()
def op8_lattice_likelihood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = lattice.lattice_scores(docs, ~_held_out(5, 1), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_register()
def op9_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


@_register()
def op10_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("text").cast("string")
    return shards.sharded(docs, 8).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard_id").alias("shard"), "slot", F.col("grown_shard_id").alias("grown_shard"))


@_register(r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
          FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS b
             FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c)) GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank
           FROM scored s LEFT JOIN inner_of i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.b IS NULL OR 100::HUGEINT * i.b < 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@_register(r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
keyed AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM conversations),
fated AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fate FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy,
                CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), sha256(strlen(role) || ':' || role || text)) AS i FROM hurt),
judged AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS init, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$', 's') THEN 't' ELSE '' END AS fault FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
                   count_if(fault = 't') AS truncated, count_if(prev IS NOT NULL AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
-- cheapest rest and its letters from each state before row i; a state's own insertion leads to the state after it
walk AS (
  SELECT conv_id, n AS i, [{'c': 0, 'l': ''}, {'c': 10, 'l': 'II'}, {'c': 5, 'l': 'I'}, {'c': 0, 'l': ''}] AS s FROM counted
  UNION ALL
  SELECT conv_id, i, [least(x[1], {'c': x[3].c + 5, 'l': 'I' || x[3].l}, {'c': x[4].c + 10, 'l': 'II' || x[4].l}),
                      least(x[2], {'c': x[3].c + 5, 'l': 'I' || x[3].l}, {'c': x[4].c + 10, 'l': 'II' || x[4].l}),
                      least(x[3], {'c': x[4].c + 5, 'l': 'I' || x[4].l}), least(x[4], {'c': x[3].c + 5, 'l': 'I' || x[3].l})] AS s
  FROM (SELECT w.conv_id, w.i - 1 AS i, list_transform([1, 2, 3, 4], lambda q: least(
          {'c': s[q].c + 2, 'l': 'D' || s[q].l},
          CASE WHEN fault IN ('b', 'd') THEN NULL WHEN init = 's' AND q = 1 THEN {'c': s[2].c + 5 * (fault = 't')::INT, 'l': 'K' || s[2].l}
               WHEN init = 'u' AND q <> 3 THEN {'c': s[3].c + 5 * (fault = 't')::INT, 'l': 'K' || s[3].l} WHEN init = 'a' AND q = 3 THEN {'c': s[4].c + 5 * (fault = 't')::INT, 'l': 'K' || s[4].l} END,
          CASE WHEN fault IN ('b', 'd') THEN NULL WHEN q = 3 THEN {'c': s[4].c + 1 + 5 * (fault = 't')::INT, 'l': 'R' || s[4].l} ELSE {'c': s[3].c + 1 + 5 * (fault = 't')::INT, 'l': 'R' || s[3].l} END)) AS x
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i)
),
best AS (SELECT conv_id, s[1].c AS cost, s[1].l AS audit FROM walk WHERE i = 0),
letters AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS pos FROM best),
steps AS (SELECT conv_id, pos, audit[pos : pos] AS e, pos - len(regexp_replace(audit[1 : pos], '[^I]', '', 'g')) AS i, len(regexp_replace(audit[1 : pos], '[D]', '', 'g')) AS made FROM letters),
heads AS (SELECT s.conv_id, max(e = 'K' AND init = 's') AS sys FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i AND e = 'K' GROUP BY s.conv_id),
turns AS (SELECT s.conv_id, pos, CASE WHEN e = 'K' THEN role WHEN (made - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
          FROM steps s LEFT JOIN heads h ON h.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i AND e <> 'I' WHERE e <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
""")
def op12_conversation_repair(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_digests(rows, conversation_repair.audited(rows))


@_register()
def op13_token_store(spark, sf_dir):
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_store.read_tokens(spark, path)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""The pipeline's stages, one by one, against what each decides by itself."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from trialflow.llm import mixing, near_dups, quality, toxicity
from trialflow.llm.queries import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before and out.count() == len(after)
        if name == "toxicity":
            model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
            assert after == {r[0] for r in toxicity.toxicity_scores(docs, model).where("score < 0.7").collect()}
        elif name == "quality":
            model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
            assert after == {r[0] for r in quality.quality_scores(docs, model).where("score >= 0.3").collect()}
        elif name == "near_duplicates":
            assert after == {r[0] for r in near_dups.near_duplicates(docs, 4, 5).where("kept").collect()}
        else:
            assert after == before
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in docs.collect())


def test_result_carries_the_mix(spark, tmp_path):
    # the last two stages on rows of very unlike sources, in the order of no mix
    count = {"a": 1600, "b": 400, None: 100}
    rows = [(i, f"text number {i}", s) for i, s in enumerate(s for s, n in count.items() for _ in range(n))]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path / "mix")
    corpus_pipeline.mix_sources(spark, docs, FOLDER).write.parquet(path)
    laid = spark.read.parquet(path)
    out = sorted(corpus_pipeline.encode(spark, laid, FOLDER).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in out] == list(range(len(rows)))
    # equal to what the mixing stage laid out, file after file
    files = sorted({r[0] for r in laid.select(F.input_file_name()).collect()})
    assert [r["doc_id"] for r in out] == [r["doc_id"] for f in files for r in spark.read.parquet(f).collect()]
    # until the first source ends, none is a block and its share away from its target
    total = sum(n**0.5 for n in count.values())
    seen, met = dict.fromkeys(count, 0), 0
    for r in out:
        seen[r["source"]] += 1
        if any(seen[s] == n for s, n in count.items()):
            break
        met += 1
        assert all(abs(seen[s] - met * n**0.5 / total) < 2 * mixing.BLOCK_ROWS for s, n in count.items())
    assert met > 500


def test_run_returns_the_mix(spark):
    out = corpus_pipeline.run(spark, FOLDER).select("doc_id", "source", "mix_position").collect()
    assert sorted(r["mix_position"] for r in out) == list(range(len(out)))
    count = Counter(r["source"] for r in out)
    total, seen = sum(n**0.5 for n in count.values()), Counter()
    for met, r in enumerate(sorted(out, key=lambda r: r["mix_position"]), 1):
        seen[r["source"]] += 1
        if seen[r["source"]] == count[r["source"]]:
            break
        assert all(abs(seen[s] - met * n**0.5 / total) < 2 * mixing.BLOCK_ROWS for s, n in count.items())

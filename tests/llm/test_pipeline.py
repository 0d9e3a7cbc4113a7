"""Every stage against what its operator says of the stage's own input."""

import re

import corpus_pipeline as P
from veilspark.llm import quality, toxicity

from .test_texts import brute_base, brute_jaccard


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "Score")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        kept[name] = len(after)
        if name == "quality_classifier":
            s = quality.score(docs, quality.fit(docs, labels), "s_").collect()
            assert after == {r["doc_id"] for r in s if r["s_"] >= 0.7}
        elif name == "toxicity":
            s = toxicity.score(docs, toxicity.fit(docs, labels), "s_").collect()
            assert after == {r["doc_id"] for r in s if r["s_"] < 0.5}
        elif name == "ngram_jaccard":
            want = brute_jaccard([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert after == {i for i, _, c in want if i == c}
        elif name == "pii":
            assert after == set(before)
            for r in out.collect():
                assert brute_base(r["text"]) == ""
                if brute_base(before[r["doc_id"]]["text"]):
                    assert r["text"] != before[r["doc_id"]]["text"]
                if r["text"] != before[r["doc_id"]]["text"]:
                    assert re.search(r"\[(EMAIL|IP|CARD|PHONE|ID)\]", r["text"])
        else:
            assert after == set(before)
        docs = out
    assert kept["packing"] > 0 and kept["quality_classifier"] >= kept["toxicity"] >= kept["ngram_jaccard"]


def test_stages_take_odd_rows(spark, odd, sf):
    for name, stage in P.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == odd.columns


def test_jaccard_stage_keeps_one_of_repeated_rows(spark, odd, sf):
    got = [r["doc_id"] for r in P.ngram_jaccard(spark, odd, sf).collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 4, 5, 8, 9] and None in got


def test_stages_take_empty_tables(spark, none, sf):
    for name, stage in P.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == none.columns


def test_stages_treat_texts_without_words_alike(spark, odd, sf):
    for name, stage in P.STAGES[:2]:
        got = [r["doc_id"] for r in stage(spark, odd, sf).collect()]
        assert len({i in got for i in (2, 3, 4)}) == 1 and got.count(1) in (0, 2)

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from peakloom.llm.decontaminate import covered, match_benchmark

from .test_jaccard import brute


def test_stages_and_their_effects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialise(stage(spark, frames[-1], sf), name))
    kept = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert len(kept[1]) > 0.97 * len(kept[0])
    rows = [(r.doc_id, r.text) for r in frames[1].collect()]
    assert kept[2] == sorted(d for d, _, c in brute(rows) if d == c)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    before = {r.doc_id: r for r in match_benchmark(frames[2], bench).collect()}
    after = {r.doc_id: r for r in match_benchmark(frames[3], bench).collect()}
    assert any(r.spans for r in before.values()) and set(after) <= set(before)
    for d, r in before.items():
        if not r.spans:
            assert after[d].text == r.text
    assert not any(r.spans and covered(r.spans, len(r.text.split())).sum() > 20 for r in after.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(kept[3]) - set(kept[4])
    assert all(labels.get(d, 1) for d in gone)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    got = frames[5].collect()
    assert sorted(r.doc_id for r in got) == kept[4]
    assert all(r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in got)
    bare = lambda rows: sorted(tuple(r)[:-1] for r in rows)  # noqa: E731  # each run has a folder of its own
    assert bare(corpus_pipeline.run(spark, sf).collect()) == bare(got)


def test_odd_rows(spark, sf):
    odd = [(1, None, "en"), (None, "the a of and to", "en"), (2, "", None), (3, "thing the of and " * 40, "en"), (3, "thing the of and " * 40, "en"), (3, "an other text of the thing", "en"), (4, "thing the of and " * 40, "en")]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS source", "doc_id AS n_chars", "1 AS n")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.materialise(stage(spark, frame, sf), name)
    from peakloom.llm.jaccard_join import keep_first

    assert sorted((str(r.doc_id), r.text) for r in keep_first(docs).collect()) == sorted([("1", None), ("None", odd[1][1]), ("2", ""), ("3", odd[3][1]), ("3", odd[5][1])])


def test_keep_first_with_clashing_names_and_maps(spark):
    from peakloom.llm.jaccard_join import keep_first

    text = "one text of some words that many rows have"
    rows = [(1, text, {"a": 1}), (1, text, {"a": 2}), (2, text, None), (None, "alone here", {"b": 1}), (None, "alone here", None), (7, "", None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id map<string, int>").selectExpr("*", "1 AS first_id", "2 AS class_id", "3 AS cid", "4 AS row_digest", "5 AS of_class")
    got = keep_first(docs)
    assert got.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", text), ("7", ""), ("7", "None"), ("None", "alone here")]


def test_every_stage_with_odd_rows(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows and other columns, stage by stage."""
    from pyspark.sql import functions as F

    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    long = " ".join(f"{w}{i}" for i in range(15_000) for w in ("the", "of", "and"))
    odd = [(1000, None, "en", None), (None, real[0][1], "en", "s"), (None, None, None, None), (1001, "", "en", "s"), (1002, long, "en", "s"), (1003, long, None, "s"), (1003, "a quite different text of its own here", "en", "s"), (1004, item + " and more", "en", "s"), (1005, "12 ½ _", "en", "s"), real[3], real[3]]
    docs = spark.createDataFrame(real + odd, "doc_id bigint, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS bigint) AS n_chars", "'x' AS spans", "2 AS cid", "'y' AS __row")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialise(stage(spark, frames[-1], sf), name))
    assert all(f.columns == docs.columns and {r.spans for r in f.collect()} == {"x"} for f in frames[:-1])
    ids = [[r.doc_id for r in f.select("doc_id").collect()] for f in frames]
    assert 1000 not in ids[1] and 1001 not in ids[1] and 1005 not in ids[1] and 1002 in ids[1] and ids[1].count(real[3][0]) == 3
    assert ids[2].count(real[3][0]) == 1 and (1002 in ids[2]) != (1003 in ids[2] and any(r.text == long and r.doc_id == 1003 for r in frames[2].collect()))
    assert any(r.doc_id == 1003 and r.text.startswith("a quite") for r in frames[2].collect())
    assert 1004 in ids[2] and 1004 not in ids[3] and 1002 in ids[3]
    assert sorted(map(str, ids[5])) == sorted(map(str, ids[4])) and frames[5].agg(F.sum("n_tokens")).first()[0] > 15_000
    empty = corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf)
    assert empty.count() == 0

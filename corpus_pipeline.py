"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and binary output, over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever else those are named; missing ones aren't invented.
Null ids and repeated rows are rows like others unless a stage says so; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3. Documents without words (null, empty, signs only) go, and those whose words are told with a mean confidence under a half;
    mixed languages stay. Without a labelled row there is no model and all stay. Repeated rows all stay or all go."""
    from peakloom.llm.crf_langid import fit_on, keep_identified

    return keep_identified(docs, fit_on(docs), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9. Of the documents that similar shingle sets connect, the one with the least id stays (nulls last; of rows with one id the
    first by text). Texts without words are alone and all stay."""
    from peakloom.llm.jaccard_join import keep_first

    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2. Words of benchmark windows are cut out of the texts; a document with more than half of its words in them goes, one with just
    half stays. Null and empty texts stay as they are; n_chars follows a text that was cut."""
    from peakloom.llm.decontaminate import keep_clean

    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_share=0.5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7. Toxic text's target is 0, the other domains' what they have: each document stays as often as its rounded rate says,
    halves up. Documents without words stay once; equal texts have equal rates; labels without document are ignored."""
    from peakloom.llm.mixing import keep_mixed

    return keep_mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4. Wavelet shards in the shared folder, and each document's place in them, as read back. Null and empty texts hold the end id
    only; null ids come first, rows of one id by the hash of their text."""
    import public_tokenizers

    from peakloom.llm.wavelet import wavelet_round_trip

    return wavelet_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mixing), ("token_output", tokens)]

#: A fitted model labels the languages and rates the documents: SQL can't express those stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

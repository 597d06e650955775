import itertools
import zlib

import numpy as np

from peakloom.llm import crf_langid
from peakloom.llm.crf_langid import fit_on, keep_identified, label_words, language_id, marginals, predict


def test_marginals_are_exact(monkeypatch):
    rng, k = np.random.default_rng(1), 3
    moves = rng.normal(size=(k, k))
    monkeypatch.setattr(crf_langid, "CHUNK", 3)
    lens = np.array([0, 1, 2, 3, 7, 0, 8, 4])
    scores = rng.normal(size=(lens.sum(), k))
    got, at = marginals(scores, lens, moves), 0
    for n in lens:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.exp(sum(scores[at + i, c] for i, c in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, c in enumerate(path):
                want[i, c] += p
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    mine = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang_pred == r.lang for r in mine) > 0.97 * len(mine)
    model = fit_on(docs)
    by_lang = {r.lang: r.text for r in docs.filter("n_chars > 600").collect()}
    mixed = by_lang["de"][:400] + " " + by_lang["fr"][:400]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ½ _"), (4, mixed), (None, by_lang["en"]), (5, by_lang["es"] * 40)], "doc_id bigint, text string").selectExpr("*", "'x' AS lang", "1 AS score")
    got = {r.doc_id: r for r in predict(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en" and got[5].lang_pred == "es"
    labels = {r.doc_id: r for r in label_words(odd, model).collect()}[4].langs
    assert np.mean([x == "de" for x in labels[:40]]) > 0.9 and np.mean([x == "fr" for x in labels[-40:]]) > 0.9
    assert language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(odd.withColumn("lang", odd.lang.substr(9, 1)).withColumn("lang", odd.text.substr(0, 0)).filter("doc_id in (1, 2)")).collect()} == {"und"}


def test_mixed_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_lang = {r.lang: r.text.split() for r in docs.filter("n_chars > 2500").collect()}
    cut = lambda lang, n: " ".join(by_lang[lang][:n])
    three = cut("de", 80) + " " + cut("fr", 60) + " " + cut("es", 60)
    four = " ".join(cut(lang, 50) for lang in ("de", "en", "es", "fr"))
    rows = [(1, None), (2, "12 ½ _"), (3, three), (4, four), (None, cut("de", 90) + " " + cut("en", 90)), (5, cut("en", 50))]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    model = fit_on(docs)
    assert [r.score < 0.5 for r in predict(odd.filter("doc_id in (3, 4)"), model).collect()] == [True, True]
    kept = keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "None"]
    assert fit_on(odd) is None and keep_identified(odd, fit_on(odd)).count() == len(rows)


def plain_posteriors(model, words):
    """Forward-backward word by word, without chunks, scaled at each word."""
    pot, move = np.exp(model.emissions(words)), np.exp(model.moves)
    ahead, back = [pot[0] / pot[0].sum()], [np.ones(len(move))]
    for p in pot[1:]:
        x = ahead[-1] @ move * p
        ahead.append(x / x.sum())
    for p in pot[:0:-1]:
        x = move @ (p * back[-1])
        back.append(x / x.sum())
    post = np.array(ahead) * np.array(back[::-1])
    return post / post.sum(1, keepdims=True)


def test_query_against_plain_forward_backward(spark, sf):
    from peakloom.llm.crf_langid import words_of
    from peakloom.llm.queries import op3_crf_language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, got = fit_on(docs), {r.doc_id: r for r in op3_crf_language_id(spark, sf).collect()}
    for r in docs.collect():
        words = words_of(r.text)
        share = plain_posteriors(model, words).mean(0)
        assert got[r.doc_id].lang_pred == model.labels[int(share.argmax())] and abs(got[r.doc_id].score - share.max()) < 1e-6
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_fit_reads_whole_texts_and_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 600")
    by_lang = {r.lang: r.text for r in docs.collect()}
    late = "zzqx " * 5000 + by_lang["de"]  # its language shows at the end only
    rows = [(2 * i, x, y) for i, (x, y) in enumerate([(late, "de"), (by_lang["fr"], "fr"), (by_lang["en"], "en")] * 12)]
    odd = spark.createDataFrame(rows + rows[:7] + [(None, by_lang["fr"], "fr")], "doc_id bigint, text string, lang string").selectExpr("*", "1 AS h", "2 AS score")
    got = language_id(odd).collect()
    assert len(got) == len(rows) + 8 and {r.lang_pred for r in got} <= {"de", "fr", "en"}
    model = fit_on(odd)
    assert model and predict(spark.createDataFrame([(1, by_lang["de"])], "doc_id bigint, text string"), model).first().lang_pred == "de"


def test_every_word_of_a_chosen_text_is_fitted(spark):
    """One word between 40,000 others, wherever it stands, is in the lexicon."""
    from peakloom.llm.crf_langid import word_features

    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, "the of and " * 7000 + "hapaxone " + "to in is " * 7000, "en"), (b, "der die das " * 7000 + "hapaxdrei", "de")]
    model = fit_on(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert np.isin(word_features(["hapaxone", "hapaxdrei", "the"])[2], model.lexicon).all()

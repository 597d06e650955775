import random

import pandas as pd
import pytest

from peakloom.llm.decontaminate import decontamination_report, match_benchmark, remove_spans
from peakloom.llm.queries import OP2_SQL, op2_benchmark_decontamination

from .helpers import of, oracle


def test_against_sql(spark, sf):
    assert of(op2_benchmark_decontamination(spark, sf)) == oracle(OP2_SQL, sf)


def test_small_and_odd(spark, sf):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "B", "c", "é", "x1"])
    text = lambda n: " ,".join(word() for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (3, text(1)), (4, None), (5, "  !"), (6, text(25)), (7, text(10)), (12, text(3)), (2, text(4))]
    docs = [(k, text(rnd.randrange(60))) for k in range(40)] + [(7, None), (8, ""), (None, items[0][1]), (9, items[5][1] + " q " + items[0][1])] + [(60, items[5][1])] * 3
    d, b = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), pd.DataFrame(items, columns=["item_id", "text"])
    ds, bs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS items", "'' AS spans"), spark.createDataFrame(items, "item_id bigint, text string")
    got = of(decontamination_report(ds, bs))
    want = oracle(OP2_SQL, sf, documents=d.assign(doc_id=d.doc_id), benchmark=b)
    fix = lambda x: [tuple("None" if v in ("None", "nan", "<NA>") else v.removesuffix(".0") for v in r) for r in x[1]]
    assert sorted(fix(got)) == sorted(fix(want))
    split = match_benchmark(ds, bs, max_words=20)
    assert sorted((str(r.doc_id), r["items"]) for r in split.collect()) == sorted((str(r.doc_id), r["items"]) for r in match_benchmark(ds, bs).collect())
    assert decontamination_report(ds, bs.limit(0)).filter("contaminated").count() == 0
    assert decontamination_report(ds.limit(0), bs).count() == 0
    r = remove_spans(spark.createDataFrame([(1, f"Clean start, {items[5][1]}! and more clean words follow here so that it is kept " * 1 + "w " * 30)], "doc_id bigint, text string"), bs.filter("item_id = 6")).first()
    assert not r.removed and r.n_hit == 25 and r.text.startswith("Clean start, ! and more")


def test_items_without_id_and_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    from peakloom.llm.decontaminate import keep_clean

    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Some words, then {item}. " + "x " * 40), (2, "clean"), (3, None)], "doc_id bigint, text string").selectExpr("*", "'mine' AS spans", "text AS __spans")
    bench = spark.createDataFrame([(None, item), (None, "w1 w2"), (4, "w3")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination_report(docs, bench).collect()}
    assert got[1].n_hit == 12 and got[1].n_items == 2 and not got[2].contaminated
    want = oracle(OP2_SQL, sf, documents=docs.select("doc_id", "text").toPandas(), benchmark=bench.toPandas().astype({"item_id": "Int64"}))
    assert of(decontamination_report(docs, bench)) == want
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id: (r.spans, r.text) for r in kept.collect()} == {1: ("mine", f"Some words, then . {'x ' * 40}"), 2: ("mine", "clean"), 3: ("mine", None)}
    with pytest.MonkeyPatch.context() as m:  # several groups of items: passes over written rows
        m.setattr("peakloom.llm.decontaminate.MAX_WORDS", 10)
        assert sorted(map(str, keep_clean(docs, bench).collect())) == sorted(map(str, kept.collect()))
    long = spark.createDataFrame([(1, "a " * 200_000 + item)], "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    r = keep_clean(long, bench).first()
    assert r.n_chars == len(r.text) == 400_000


def test_long_and_repeated_items(spark, sf):
    """One item of many words, and one repeated in thousands of rows, make automata of bounded size, and every window is met."""
    from pyspark.sql import functions as F

    from peakloom.llm.decontaminate import item_pieces

    rnd = random.Random(8)
    item = [f"v{rnd.randrange(10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(item)), (2, "p q r"), (3, " ".join(item[:11]))] + [(5, " ".join(item[100:130]))] * 300 + [(None, "z z")] * 300
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = [(k, "x " + " ".join(item[k : k + 10]) + " y") for k in range(2985, 2991)] + [(k, "x " + " ".join(item[k : k + 10]) + " y") for k in range(0, 2900, 7)]
    docs += [(9000, " ".join(item)), (9001, "p q r z z"), (9002, None)]
    docs = [(k, t) for k, t in dict(docs).items()]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole, cut = match_benchmark(d, bench), match_benchmark(d, bench, max_words=3000)
    from peakloom.llm.decontaminate import covered

    told = lambda df: sorted((r.doc_id, r["items"], covered(r.spans or b"", len((r.text or "").split())).sum()) for r in df.collect())
    assert told(cut) == told(whole)
    want = oracle(OP2_SQL, sf, documents=pd.DataFrame(docs, columns=["doc_id", "text"]), benchmark=pd.DataFrame(rows, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert of(decontamination_report(d, bench)) == want
    p = item_pieces(bench, 10, 3000)
    assert p.count() == 3000 // 178 + 5 and p.agg(F.max(F.octet_length("piece"))).first()[0] < 187 * 8


def test_one_item_of_two_million_words(spark):
    """No automaton holds more than about max_words of it; a passage from anywhere in it is found."""
    from peakloom.llm.decontaminate import item_pieces

    bench = spark.range(1).selectExpr("id AS item_id", "array_join(transform(sequence(1, 2000000), i -> concat('w', i)), ' ') AS text")
    p = item_pieces(bench, 10, 400_000).selectExpr("pmod(xxhash64(item_id, piece), 40) AS g", "size(split(decode(piece, 'utf-8'), ' ')) AS n").groupBy("g").agg({"n": "sum"}).toDF("g", "n").collect()
    assert max(r.n for r in p) <= 400_000 and sum(r.n for r in p) >= 2_000_000

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from peakloom.llm import phrases

from .helpers import of, oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain(rows, least=10, longest=3, top=2000):
    f, n, out = counted(rows, longest), Counter(), {}
    for key, c in f.items():
        n[key[0]] += c if len(key) == 2 else 0
    big = {k: c for k, c in f.items() if len(k) > 2 and c >= least}
    for (lang, *w), a in big.items():
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        if any(q[0] == lang and len(q) - 1 > len(w) and 100 * c >= 50 * a and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w))) for q, c in big.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def texts(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "ÉA", "x|y", "a", "b", "c", "dd", "本"]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; ", "!?", "\x1f"]
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(40)))) for _ in range(n)]


def result(df, **how):
    return sorted(map(tuple, phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string").withColumn("f", F.lit("clash")).withColumn("k1", F.lit(3)).repartition(4)


@pytest.mark.parametrize("size, longest, top", [(phrases.SHARD, 3, 2000), (40, 3, 7), (25, 4, 2000)])
def test_against_plain_counts(spark, size, longest, top):
    """Also in shards of a few words, so that most phrases cross one's end."""
    rows = [*texts(size), (None, None), ("en", ""), ("en", " .\n"), ("en", "one"), *[("en", "same text of the a")] * 30]
    got = result(frame(spark, rows), size=size, longest=longest, top=top)
    assert got == plain(rows, longest=longest, top=top) and got


def test_one_very_long_text(spark):
    """A text of many shards, with words longer than a shard, counts like a short one."""
    rng = random.Random(9)
    text = " ".join(rng.choice(["a", "b", "cc", "d. e", "x" * 300]) for _ in range(6000))
    rows = [("en", text), ("en", "x" * 1000), ("en", " " * 1000)]
    got = result(frame(spark, rows), size=128)
    assert got == plain(rows) and len(got) > 20


def test_empty_table(spark):
    assert result(frame(spark, [("en", "a b")]).limit(0)) == []
    assert result(frame(spark, [(None, None), ("en", "a b c")])) == []


def test_ties_and_repeats(spark):
    rows = [("en", f"{w} z{w}") for w in "edcba" for _ in range(12)]  # all alike but for their bytes
    got = result(frame(spark, rows), top=3)
    assert [r[2] for r in got] == ["a za", "b zb", "c zc"] and got == plain(rows, top=3)


def test_colliding_hashes_are_replaced(spark, monkeypatch):
    rows = texts(3, 60)
    seeds, own = [], phrases._count_words

    def poor(seed):
        seeds.append(seed)
        count = own(seed)

        def run(batches):
            for b in count(batches):
                yield b.set_column(2, "k1", pc.bit_wise_and(b.column(2), pa.scalar(3))) if seed == 0 else b

        return run

    monkeypatch.setattr(phrases, "_count_words", poor)
    assert result(frame(spark, rows)) == plain(rows) and seeds == [0, 1]


def test_marks_agree(spark):
    rng = np.random.default_rng(0)
    keys = [rng.integers(-(2**63), 2**63 - 1, 50) for _ in range(4)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(*keys)], "a bigint, b bigint, c bigint, d bigint")
    assert [r[0] for r in df.select(phrases.phrase_mark([F.col(c) for c in "abcd"])).collect()] == phrases.phrase_mark(keys).tolist()


def test_merge_join_of_lists():
    postings = (np.array([0, 1, 2, 4, 5]), np.array([7, 8, 7, 7, 8]))  # a gap after position 2
    new, (codes, starts), sizes = phrases.extend((np.array([7, 7, 7, 8, 8]), np.array([0, 2, 4, 1, 5])), 1, postings, 10)
    assert new.tolist() == [[7, 8], [8, 7]] and codes.tolist() == [0, 0, 1] and starts.tolist() == [0, 4, 1] and sizes.tolist() == [2, 1]


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000_000
    got = spark.sql(f"SELECT CAST(CAST({n}L AS DECIMAL(19,0)) * CAST({n}L AS DECIMAL(19,0)) * 1000000 DIV (CAST({n + 7}L AS DECIMAL(19,0)) * CAST({3 * n}L AS DECIMAL(19,0))) AS BIGINT)").first()[0]
    assert got == 1_000_000 * n * n // ((n + 7) * 3 * n)


def test_query_equals_its_sql(spark, sf):
    from peakloom.llm.queries import ORACLES, QUERIES

    got = of(QUERIES["op11_phrase_mining"](spark, sf))
    assert got == oracle(ORACLES["op11_phrase_mining"], sf) and got[1]


def test_row_groups_of_the_index_are_bounded(spark, monkeypatch):
    """A reader decodes a group of so few rows at once: a task's whole share of shards in one group doesn't fit its memory."""
    import os
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    class Done(Exception):
        pass

    def only_index(df, label, **options):
        raise Done(written(df, label, **options))

    written = phrases.materialise
    monkeypatch.setattr(phrases, "materialise", only_index)
    docs = spark.createDataFrame([(" ".join(os.urandom(4).hex() for _ in range(100_000)), "en") for _ in range(40)], "text string, lang string").coalesce(1)
    with pytest.raises(Done) as got:
        phrases.frequencies(docs, size=1 << 20)
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in got.value.args[0].inputFiles()]
    assert sum(m.num_rows for m in files) == 40
    assert max(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)) < 48 << 20

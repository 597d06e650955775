import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from peakloom.llm import repeats
from peakloom.llm.debruijn import dedup_words


def brute(docs, units, join, window):
    counts = Counter()
    for _, text in docs:
        u = units(text)
        counts.update(u[i : i + window] for i in range(len(u) - window + 1))
    out = []
    for d, text in docs:
        u = units(text)
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if counts[u[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((d, len(u), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


words = lambda t: tuple((t or "").encode().split())
octets = lambda t: (t or "").encode()


def corpus(seed, n=60, alphabet=400):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) + str(rnd.randrange(alphabet)) for _ in range(n))
    passages = [text(rnd.randrange(20, 150)) for _ in range(6)]
    docs = []
    for k in range(n):
        docs.append((k, "  ".join(rnd.choice(passages) if rnd.random() < 0.4 else text(rnd.randrange(1, 60)) for _ in range(rnd.randrange(5)))))
    near = docs[3][1] + text(200)
    docs += [(100 + i, near[: 50 * i] + "é " + near[50 * i :]) for i in range(8)]
    docs += [(200, "x " * 300), (201, None), (202, ""), (203, " \n"), (204, "ab " * 90 + "cd"), (None, near), (5, docs[5][1]), (205, "y" * 1000), (206, text(30) + " " + "z" * 900)]
    return docs


def spark_rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [10**6, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS block", "'q' AS v").repartition(3)
    assert spark_rows(dedup_words(df, hot=hot)) == brute(docs, words, b" ".join, 35)
    assert spark_rows(dedup_words(df, window=6, k=2, hot=hot)) == brute(docs, words, b" ".join, 6)


def paths_of(docs, window):
    """Edges of each nonbranching path of repeated edges, cycles left out, by following the graph; and how many edges lie on cycles."""
    counts = Counter()
    for _, text in docs:
        u = words(text)
        counts.update(u[i : i + window] for i in range(len(u) - window + 1))
    edges = [e for e, n in counts.items() if n > 1]
    ins, outs = Counter(e[1:] for e in edges), {}
    for e in edges:
        outs.setdefault(e[:-1], []).append(e)
    through = lambda node: ins[node] == 1 and len(outs.get(node, ())) == 1
    sizes, done = [], 0
    for e in edges:
        if through(e[:-1]):
            continue
        n, now = 1, e
        while through(now[1:]):
            now, n = outs[now[1:]][0], n + 1
        sizes.append(n)
        done += n
    return sorted(sizes), len(edges) - done


def branching(seed):
    """Texts that share a trunk, leave it for common branches and come back to it, and a ring."""
    rnd = random.Random(seed)
    run = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    trunk, branches, ring = run(120), [run(15) for _ in range(3)], run(9)
    docs = []
    for k in range(25):
        a, b = sorted((rnd.randrange(120), rnd.randrange(120)))
        docs.append((k, " ".join([*run(3), *trunk[:a], *rnd.choice(branches), *trunk[b:], *run(2)])))
    return docs + [(100 + i, " ".join(ring * 5)) for i in range(2)] + [(200 + i, " ".join(trunk)) for i in range(3)]


@pytest.mark.parametrize("hot", [10**6, 4])
def test_paths_are_compacted(spark, hot):
    from peakloom.llm.debruijn import compacted_paths

    for docs, window in ((branching(3), 6), (corpus(5), 12), (branching(4), 35)):
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
        want, ring = paths_of(docs, window)
        got = sorted(r.edges for r in compacted_paths(df, window, hot=hot).collect())
        left = Counter(got) - Counter(want)
        assert not Counter(want) - Counter(got) and sum(k * n for k, n in left.items()) == ring
        assert spark_rows(dedup_words(df, window, hot=hot)) == brute(docs, words, b" ".join, window)


def test_empty_and_long(spark, monkeypatch):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert dedup_words(df.limit(0)).count() == 0
    assert spark_rows(dedup_words(df)) == brute([(1, None)], words, b" ".join, 35)
    rnd = random.Random(1)
    units = np.array([rnd.randrange(50) for _ in range(9000)], np.uint64)
    monkeypatch.setattr(repeats, "CHUNK_BITS", 10)
    by, text = repeats.Words(), " ".join("%d" % x for x in units)
    covered, sizes = np.zeros(len(units), int), np.zeros(4, np.int64)
    for hashes, ends, numbers, offsets in repeats.pieces(by, pa.array(["a b", text, "", text[:3000]]), 35, sizes):
        v, first, end, _ = repeats.segments(hashes, ends, 35, 18)
        begins = ends - np.diff(ends, prepend=0)
        for a, z in zip(first, end):
            d = int(np.searchsorted(ends, a, "right"))
            if numbers[d] == 1:
                covered[offsets[d] + a - begins[d] : offsets[d] + z - begins[d]] += 1
    assert (covered[: len(units) - 34] == 1).all() and not covered[len(units) - 34 :].any()
    assert sizes.tolist() == [2, 9000, 0, len(text[:3000].split())]


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = " ".join(str(rnd.randrange(10**9)) for _ in range(120_000))
    docs = [(1, long), (2, long[300_000:700_000]), (3, "short " * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert spark_rows(dedup_words(df)) == brute(docs, words, b" ".join, 35)


def test_collection_bwt():
    from peakloom.llm.bwt_dedup import collection_bwt

    rnd = random.Random(9)
    strings = [[rnd.randrange(1, 4) for _ in range(rnd.randrange(12))] for _ in range(30)] + [[2] * 9, [2] * 9]
    lens = np.array([len(s) for s in strings])
    flat = np.array([c for s in strings for c in s], np.int64)
    starts = np.cumsum(lens) - lens
    place, common = collection_bwt(flat, starts, lens)
    tail = {int(starts[k]) + i: s[i:] for k, s in enumerate(strings) for i in range(len(s))}
    got = [tail[p] for p in place.tolist() if p >= 0]
    assert len(got) == len(flat) and got == sorted(got)

    def prefix(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    told = [tail.get(p, []) for p in place.tolist()]
    assert common.tolist()[1:] == [prefix(a, b) for a, b in zip(told, told[1:])]


@pytest.mark.parametrize("hot", [10**6, 3])
@pytest.mark.parametrize("window", [400, 90, 13])
def test_bytes(spark, window, hot):
    from peakloom.llm.bwt_dedup import dedup_bytes

    docs = corpus(window)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert spark_rows(dedup_bytes(df, window, hot=hot)) == brute(docs, octets, bytes, window)


def test_bytes_against_sql(spark, sf):
    from peakloom.llm.queries import OP8_SQL, op8_bwt_dedup

    from .helpers import of, oracle

    assert of(op8_bwt_dedup(spark, sf)) == oracle(OP8_SQL, sf)


def test_words_against_sql(spark, sf):
    from peakloom.llm.queries import OP5_SQL, op5_debruijn_dedup

    from .helpers import of, oracle

    assert of(op5_debruijn_dedup(spark, sf)) == oracle(OP5_SQL, sf)

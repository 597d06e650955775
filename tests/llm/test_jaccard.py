import random

import pytest

from peakloom.llm.components import components
from peakloom.llm.jaccard_join import jaccard_components, jaccard_links, keep_first


def brute(docs, n=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = (text or "").translate(low).encode().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(60 if seed == 3 else 3000)
    docs, k = [], 0
    common = " ".join(word() for _ in range(30))
    for _ in range(40):
        base = [word() for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.randrange(1, 9)):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice([word(), "W1", ""])
            if rnd.random() < 0.3:
                own += [word() for _ in range(rnd.randrange(20))]
            docs.append((k, " ".join(own) + (" " + common if rnd.random() < 0.3 else "")))
            k += rnd.randrange(1, 3)
    docs += [(5000, None), (5001, ""), (5002, " "), (None, docs[3][1]), (docs[4][0], docs[4][1]), (5003, "a b"), (5004, "A  b"), (5005, "a b a b a b a b"), (5006, "a b a b a b a b a b c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS cid").repartition(4)
    assert sorted(map(tuple, jaccard_components(df, block=1000 if seed == 1 else 4).collect()), key=str) == brute(docs)


def test_word_hashes():
    import pyarrow as pa

    from peakloom.llm.common import word_hashes

    texts = ["a b", "", " b\t\nab é ", "a"]
    for arr in (pa.array(texts), pa.array(["zz q", *texts]).slice(1)):
        h, at = word_hashes(arr)
        assert at.tolist() == [0, 2, 2, 5, 6] and h[0] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 4


def test_empty(spark):
    df = spark.createDataFrame([(3, None)], "doc_id bigint, text string")
    assert jaccard_components(df.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_components(df).collect()] == [(3, 0, 3)]


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)] + [(7, 7)]
    import collections

    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, least(x)) for x in near if near[x])


def test_against_sql(spark, sf):
    from peakloom.llm.queries import OP9_SQL, op9_ngram_jaccard_join

    from .helpers import of, oracle

    assert of(op9_ngram_jaccard_join(spark, sf)) == oracle(OP9_SQL, sf)


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (None, None), (None, ""), (None, None)]  # equal null ids
    rows += [(7, text(10)), (7, text(11)), (7, text(11)), (8, text(11)), (9, text(12)), (9, "a " + text(12)), (6, text(13)), (None, text(13))]
    rows += [(20, text(14)), (21, text(14)), (22, text(15)), (23, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'s' AS source").repartition(3)
    got = keep_first(docs)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    nines = [r for r in got if r[0] == 9]
    assert len(nines) == 1 and nines[0][1] in (text(12), "a " + text(12))
    want = [(None, text(k)) for k in range(6)] + [(None, None), (None, ""), (None, None)]
    want += [(7, text(10)), (7, text(11)), (6, text(13)), (20, text(14)), (22, text(15)), (23, None)]
    assert sorted((r for r in got if r[0] != 9), key=str) == sorted(want, key=str)
    assert keep_first(docs.limit(0)).count() == 0


def test_all_links(spark):
    rnd, docs = random.Random(5), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(rnd.randrange(1, 12)):
            own = list(base)
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), docs[0][1]), (len(docs) + 1, None), (len(docs) + 2, "a b")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in docs]
    like = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= 75 * len(a | b)}
    for block in (1024, 3):
        members, links = jaccard_links(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block=block)
        members, pairs = members.collect(), [tuple(r) for r in links.collect()]
        known, of = set(pairs), {r.doc_id: r.class_id for r in members}
        assert len(pairs) == len(known) and all(a < b for a, b in pairs)
        got = {(i, j) for i in of for j in of if i != j and of[i] is not None and of[j] is not None and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in known)}
        assert got == like and len(members) == len(docs)
        assert {r.doc_id: r.n_links for r in members} == {d: sum(i == d for i, _ in like) for d, _ in docs}
    assert [f.count() for f in jaccard_links(spark.createDataFrame([], "doc_id bigint, text string"))] == [0, 0]

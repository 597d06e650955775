import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from peakloom.llm import wavelet
from peakloom.llm.token_counts import token_counts
from peakloom.llm.wavelet import pack, unpack, wavelet_round_trip

ODD = [(1, "it's  a\n b\t\tc<|endoftext|> d  "), (2, None), (3, ""), (4, " "), (5, "a  b  \n c\x1c d é́ ß’s I'LL'll"), (6, "x" * 5000), (6, "x" * 5000), (None, "null id"), (7, "\n\n  lead"), (8, "<|startoftext|>Hi<|endoftext|>"), (9, "é é ́x 数字 123,456 ½")]


def frame(spark, sf):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "'x' AS block", "1 AS shard")
    return odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").selectExpr("doc_id + 100 AS doc_id", "text", "'y' AS block", "2 AS shard"))


def test_token_counts(spark, sf):
    tokenizer = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, sf)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, path).collect()) == want
    assert token_counts(docs.limit(0), path).count() == 0


def test_wavelet_round_trip(spark, sf):
    tokenizer = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    docs = frame(spark, sf)
    rows = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for d, ids in rows:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = wavelet_round_trip(docs, path, shard_bytes=100_000).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want
    assert len({r.shard for r in got}) > 2 and len({r.folder for r in got}) == 1
    assert wavelet_round_trip(docs.limit(0), path).count() == 0


def test_wavelet_matrix(monkeypatch):
    rnd = random.Random(3)
    for n, top in ((0, 3), (1, 1), (700, 5), (2000, 70_000), (1500, 1), (1024, 9)):
        monkeypatch.setattr(wavelet, "BLOCK", rnd.choice([16, 64, 1 << 14]))
        ids = np.array([rnd.randrange(top) for _ in range(n)], np.uint32)
        m = unpack(pack([1, None], [n, 0], ids))
        docs, ends = m.documents(0)
        assert docs == [1, None] and list(ends) == [n, n] and (m.decode() == ids).all()
        assert all(m.access(i) == ids[i] for i in range(0, n, 7))
        for t in {*map(int, ids[:5]), 2, 99_999}:
            assert m.locate(t) == list(np.flatnonzero(ids == t))
            assert m.count(t, n // 3, n // 2) == (ids[n // 3 : n // 2] == t).sum() and m.rank(t, n // 2) == (ids[: n // 2] == t).sum()


def test_questions_read_a_part_of_the_file(spark, tmp_path):
    ids = np.random.default_rng(1).zipf(1.3, 3_000_000).clip(0, 48_000).astype(np.uint16)
    data = pack(list(range(20_000)), np.full(20_000, 150), ids)
    (tmp_path / "x.wvm").write_bytes(data)
    for ask, want in ((lambda m: m.access(1_234_567), int(ids[1_234_567])), (lambda m: m.count(7, 10, 2_000_000), int((ids[10:2_000_000] == 7).sum())), (lambda m: m.select(11, 500), int(np.flatnonzero(ids == 11)[500])), (lambda m: m.documents(2)[1][0], 150 * 8193)):
        m = wavelet.open_wavelet(spark, f"file://{tmp_path}/x.wvm")
        assert ask(m) == want and m.read < 0.15 * len(data), m.read / len(data)


def test_shards_are_cut_by_bytes(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    rows = [(rnd.choice([None, 7, 7, 7, k]), text(rnd.choice([1, 20, 60]))) for k in range(3000)] + [(5000 + k, text(9000)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tie", "2 AS part", "3 AS size").repartition(6)
    got = wavelet_round_trip(docs, path := public_tokenizers.path("word_bpe_49k.json"), shard_bytes=40_000).collect()
    tokenizer, at = Tokenizer.from_file(path), 0
    tokens = lambda t: tokenizer.encode(t, add_special_tokens=False).ids + [1]
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in rows)
    crc = lambda t: zlib.crc32(np.array(tokens(t), "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(d), crc(t)) for d, t in rows)
    sizes, most = {}, max(len(tokens(t)) for _, t in rows)
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_tokens
    assert len(sizes) > 12 and max(sizes.values()) <= 10_000 + most
    assert len({r.shard for r in got if r.doc_id == 7}) > 1 and len({r.shard for r in got if r.doc_id is None}) > 1
    m = wavelet.open_wavelet(spark, f"{got[0].folder}/{got[0].shard}")
    assert m.documents(0)[0][0] is None and m.access(got[0].n_tokens - 1) == 1


def test_query_against_the_library(spark, sf):
    from peakloom.llm.queries import op4_wavelet_tokens, op10_token_counts

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r)[:4] for r in op4_wavelet_tokens(spark, sf).collect()) == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    got = op10_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == n and all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_simple_pattern_is_the_library_s():
    from peakloom.llm.token_counts import PreTokens

    by, rnd = PreTokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    split = lambda t: [t[a:b] for _, (a, b) in by.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    texts = [x for c in range(0x250) for x in (f"a{chr(c)}b", f" {chr(c)}1{chr(c)}", f"!{chr(c)} ", f"{chr(c)}{chr(c)} {chr(c)}'s")]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(64), 32, 39, 115])) for _ in range(30)) for _ in range(3000)]
    for t in texts:
        assert by.split(t) == split(t), repr(t)


def test_chunks_are_the_library_s():
    from peakloom.llm.wavelet import ChunkEncoder

    by, rnd = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    texts = ["".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(32, 127), 32, 39, 0x301, 0x130, 0x3a3, 0x2003, 0xa0])) for _ in range(40)) for _ in range(4000)]
    texts += ["<|ENDOFTEXT|> A<|endoftext|>'S <|StartOfText|>", "A\x1cB", "ΑΣ ΑΣ. İi", "é́ É"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(97, 123), rnd.randrange(0xc0, 0x240), 46, 44, 32])) for _ in range(60)) for _ in range(3000)]
    ids, lens = by.encode(pa.array([None, *texts, ""]).slice(0), 1)
    assert lens[0] == lens[-1] == 1
    for t, x in zip(texts, np.split(ids, np.cumsum(lens))[1:]):
        assert x.tolist() == by.tokenizer.encode(t, add_special_tokens=False).ids + [1], repr(t)

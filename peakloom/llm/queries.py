"""Queries of the training-data operators, with production parameters, over whole tables; their oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive_ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontamination_report

    return decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import wavelet_round_trip

    return wavelet_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import dedup_words

    return dedup_words(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


#: The one tool of the conversations: a question, at most 600 characters long.
ASK = {"ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 600}, "turn": {"type": "integer", "minimum": 0}}}}


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn of `conversations` is a call named ask, which waits for the last call before it; an assistant's turn answers the turn before."""
    from .tool_link import link_calls

    said = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    users = said.filter("role = 'user'")
    before = users.select("conv_id", (turn + 2).alias("turn"), F.array(name(turn)).alias("after")).distinct()
    calls = users.join(before, ["conv_id", "turn"], "left")
    calls = calls.select("conv_id", "turn", name(turn).alias("call_id"), F.lit("ask").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"), "after")
    results = said.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return link_calls(calls, results, ASK)


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the expected tokens of good, poor and toxic text to 85, 15 and 0 of a hundred."""
    from .mixing import DOMAINS, mix_rates

    rated = mix_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), {"high": 0.85, "low": 0.15})
    shares = [F.col("posteriors")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS)]
    return rated.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import dedup_bytes

    return dedup_bytes(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    vectors = _table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 20 = 0"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels move on by one, so that some near rows are of another label."""
    from .hard_negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"), label)


OP2_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
doc_windows AS (SELECT k, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes)),
hits AS (SELECT DISTINCT k, d.size, i, item_id FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.s = t.s),
hit_words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM hits) GROUP BY k),
hit_items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
"""

OP5_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT k, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM words)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN twice USING (s)),
gone AS (SELECT k, list(p) AS ps FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (k)
"""

OP6_SQL = r"""
WITH RECURSIVE users AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role = 'user'),
levels AS (
  SELECT conv_id, turn, 0 AS level FROM users u WHERE NOT EXISTS (SELECT 1 FROM users p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, level + 1 FROM levels l JOIN users u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2)
SELECT u.conv_id, u.turn, u.call_id, CAST(level AS INTEGER) AS level,
  CASE WHEN length(u.text) < 1 THEN 'invalid $.text: minLength' WHEN length(u.text) > 600 THEN 'invalid $.text: maxLength' WHEN a.turn IS NULL THEN 'no result' ELSE 'ok' END AS status,
  '{"arguments":{"text":' || to_json(u.text) || ',"turn":' || u.turn || '},"id":' || to_json(u.call_id) || ',"name":"ask","result":' ||
  CASE WHEN a.turn IS NULL THEN 'null' ELSE '{"content":' || to_json(a.text) || ',"turn":' || a.turn || '}' END || '}' AS json
FROM users u JOIN levels l USING (conv_id, turn) LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
"""

OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT k, i, md5_number(substr(x, 2 * i + 1, 800)) AS s FROM (SELECT k, x, unnest(range(0, strlen(x) // 2 - 399)) AS i FROM docs)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM windows SEMI JOIN twice USING (s)),
runs AS (SELECT k, min(i) AS a, max(i) + 400 AS z FROM (SELECT k, i, sum(opens) OVER (PARTITION BY k ORDER BY i) AS run FROM hits) GROUP BY k, run),
gaps AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS g, a, z FROM runs),
cuts AS (SELECT k, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * g + 1, 2 * (a - g)), '' ORDER BY a) AS head FROM gaps JOIN docs USING (k) GROUP BY k)
SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cuts USING (k)
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP11_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS p, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM pieces),
c AS (SELECT lang, x, k, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, x, k, f, string_split(x, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
cuts AS (SELECT q.lang, q.x, q.k, q.f AS a, j, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * q.f * q.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM q) q JOIN c l ON l.lang = q.lang AND l.x = array_to_string(q.w[1:j], ' ') JOIN c r ON r.lang = q.lang AND r.x = array_to_string(q.w[j + 1:], ' ')),
best AS (SELECT lang, x, k, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
longer AS (SELECT lang, y, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS y FROM q WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.y = b.x AND b.k = 2 WHERE g.f IS NULL OR 100 * g.f < 50 * b.a)
SELECT lang, rank, x AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {f.__name__: f for f in (op1_additive_ann, op2_benchmark_decontamination, op3_crf_language_id, op4_wavelet_tokens, op5_debruijn_dedup, op6_tool_call_linking, op7_soft_mixing, op8_bwt_dedup, op9_ngram_jaccard_join, op10_token_counts, op11_phrase_mining, op12_exact_topk, op13_hard_negatives)}
ORACLES = {"op2_benchmark_decontamination": OP2_SQL, "op5_debruijn_dedup": OP5_SQL, "op6_tool_call_linking": OP6_SQL, "op8_bwt_dedup": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_phrase_mining": OP11_SQL, "op12_exact_topk": OP12_SQL, "op13_hard_negatives": OP13_SQL}

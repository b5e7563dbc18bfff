"""Queries of the training-data operators, over whole tables, and their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.runtime import table

#: File of the public vocabulary; a parameter, as the package holds none.
VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import latent

    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import templates

    return templates.deduplicated(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_dropped")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import kneser_ney

    return kneser_ney.learned_and_scored(table(spark, sf_dir, "documents"), fold=7, held=2)


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import wrappers

    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"), fold=4, held=2)


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import superminhash

    return superminhash.grouped(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm import token_ids

    return token_ids.encoded(table(spark, sf_dir, "documents"), str(public_tokenizers.path(VOCABULARY)))


def op11_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import vafile

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return vafile.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0), positives=5, negatives=10, low=30, high=90, scale=256)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import repair

    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import suffixes

    return suffixes.deduplicated(table(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1's rows: ids, folds, ranges, and that predictions follow scores."""
    got = op1_toxicity(spark, sf_dir)
    return got.select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), (F.col("predicted") == (F.col("score") >= 0.5).cast("int")).alias("follows"))


def packing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's invariants by document: all tokens packed in as many pieces as needed, in bins that fit and hold a source once."""
    from corpusloom.llm import packing

    rows = runtime.written(op4_best_fit(spark, sf_dir), "packed")
    ends = F.max(F.col("bin_start") + F.col("n_tokens"))
    bins = rows.groupBy("bin_id").agg(((F.sum("n_tokens") == ends) & (ends <= packing.CAPACITY)).alias("fits"), (F.count("source") == F.count_distinct("source")).alias("apart"))
    both = rows.join(bins, "bin_id").groupBy("doc_id")
    return both.agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.bool_and("fits").alias("fits"), F.bool_and("apart").alias("apart"))


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that do not hang on the model's order; the base score to three digits, as sums of logarithms differ in the last ones."""
    got = op6_kneser_ney(spark, sf_dir)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def langid_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8's rows: ids, folds, ranges, texts without letters, and that languages are learned ones."""
    from corpusloom.llm import langid

    known = table(spark, sf_dir, "documents").select("lang").where("lang is not null").distinct()
    got = op8_langid(spark, sf_dir).join(F.broadcast(known.limit(langid.MOST_LANGUAGES + 1).select(F.col("lang").alias("lang_pred"), F.lit(True).alias("known"))), "lang_pred", "left")
    return got.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"), F.coalesce("known", F.lit(False)).alias("known"), F.col("score").between(0, 1).alias("in_range"))


_NOT_QUERIES = {"queries", "oracle_sql", "table"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if getattr(v, "__module__", "") == __name__ and k[0].islower() and k not in _NOT_QUERIES}


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(v) AS a, generate_subscripts(v, 1) AS i, len(v) AS d FROM v WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, unnest(v) AS b, generate_subscripts(v, 1) AS i, len(v) AS d FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score FROM q JOIN c USING (i, d) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS d FROM v),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS vec, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor, vec, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec) <= 5)
SELECT p.anchor AS anchor_id, p.vec AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.vec ORDER BY s.score DESC, s.vec) AS INT) AS rank,
  s.vec AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def _step(state: str, cost: str, letter: str, line: str | None) -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', o := " + (f"list_append({state}.o, {line})" if line else f"{state}.o") + ")"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _moves(to: int, keep: str, need: str, *sources: str) -> str:
    """The cheapest way to a state over one turn: delete in it, keep or rerole from the sources."""
    ways = [_step(f"s{to}", "3", "D", None)]
    ways += [_step(s, f"(CASE WHEN f IN (1, 2) OR role[1] <> '{keep}' THEN 1000000 WHEN f = 3 THEN 1 ELSE 0 END)", "K", "role || ':' || text") for s in sources]
    ways += [_step(s, "(CASE WHEN f IN (1, 2) THEN 1000000 WHEN f = 3 THEN 3 ELSE 2 END)", "R", f"'{need}:' || text") for s in sources if need]
    return _least(*ways)


_OP12_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
#: The programme forwards: each state keeps its least (cost, audit), and the lines it has put out.
OP12_SQL = f"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({_OP12_KEY}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, steps),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen FROM n),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f,
  coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
d AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s0, {{'c': 1000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s1,
    {{'c': 2::BIGINT, 'a': 'I', 'o': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']}} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, p, n0, n1, m2, {_least('n3', _step('m2', '2', 'I', "'assistant:'"))} FROM (
    SELECT *, {_least('n2', *(_step(x, '2', 'I', "'user:'") for x in ('n0', 'n1', 'n3')))} AS m2 FROM (
      SELECT d.conv_id, f.p, {_moves(0, '', '')} AS n0, {_moves(1, 's', '', 's0')} AS n1, {_moves(2, 'u', 'user', 's0', 's1', 's3')} AS n2, {_moves(3, 'a', 'assistant', 's2')} AS n3
      FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.p = d.p + 1))),
e AS (SELECT conv_id, {_least('s0', 's3')} AS best FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5_number(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS h FROM (SELECT r, x, unnest(range(CAST(length(x) / 2 AS BIGINT) - 199)) AS i FROM d WHERE length(x) >= 400)),
h AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200 AS fresh FROM w SEMI JOIN h USING (h)),
g AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS n FROM s) GROUP BY r, n),
k AS (SELECT g.r, a, b, coalesce(lag(b) OVER (PARTITION BY g.r ORDER BY a), 0) AS last FROM g),
j AS (SELECT k.r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(substr(x, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) AS kept, max(b) AS tail FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN j USING (r)
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_WORDS_CTE = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents)"
#: Remainders of a byte, and the checksum of each id as text.
_CRC = """steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, steps)"""

OP9_SQL = f"""
WITH RECURSIVE {_WORDS_CTE},
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept FROM m LEFT JOIN n USING (doc_id)
"""

NGRAM_SQL = f"""
WITH {_WORDS_CTE}, {_CRC},
t AS (SELECT doc_id, crc % 7 = 2 AS held_out, unnest(list_append(w, ' ')) AS x FROM w JOIN crc USING (doc_id)),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x), s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 3) AS base_score
FROM t LEFT JOIN c USING (x), s GROUP BY doc_id, held_out, n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_topk": OP5_SQL,
        "op11_vafile": OP11_SQL,
        "op12_repair": OP12_SQL,
        "op13_suffixes": OP13_SQL,
        "op9_superminhash": OP9_SQL,
        "ngram_counts": NGRAM_SQL,
        "toxicity_folds": f"WITH {_CRC} SELECT doc_id, crc % 5 = 0 AS held_out, true AS in_range, true AS follows FROM crc",
        "langid_folds": f"WITH {_CRC} SELECT doc_id, crc % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS und, regexp_matches(coalesce(text, ''), '\\p{{L}}') AS known, true AS in_range FROM crc JOIN documents USING (doc_id)",
        "packing_bins": f"WITH {_WORDS_CTE}, n AS (SELECT doc_id, len(w) + 1 AS n FROM w) SELECT doc_id, n::BIGINT AS n_tokens, CAST((n + 2047) // 2048 AS BIGINT) AS n_pieces, true AS fits, true AS apart FROM n",
    }

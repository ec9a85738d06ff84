"""One query per operator of this folder over the driver's tables, and SQL twins where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop.llm import codes, collocations, containment, dualtree, jaccard, language, lexicon, pieces, quality, repeats, secrets, suffixes, toxicity

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = pieces.encode(docs, path, decoded="decoded")
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language.train(docs.filter(F.coalesce(~held_out, F.lit(True))))
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op10_containment(spark: SparkSession, sf: str) -> DataFrame:
    found = containment.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


@query
def op8_dualtree(spark: SparkSession, sf: str) -> DataFrame:
    return dualtree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op8_dualtree"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(d.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM scored QUALIFY "rank" <= 5
"""


@query
def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.by_document(table(spark, sf, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_bare", "n_live", "n_example", "n_weak")


@query
def op9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffixes.remove_strings(table(spark, sf, "documents"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


@query
def op6_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "lang", "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round("score", 6).alias("score"),
        F.round("threshold", 6).alias("threshold"), "keep",
    )


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents"))


# Words are numbered within their piece; a phrase is found by its neighbours there. Products are of 128 bits.
ORACLE["op11_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
cut AS (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
words AS (SELECT lang, piece_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM cut),
following AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)
),
runs AS (
  SELECT lang, w1 AS phrase FROM following
  UNION ALL SELECT lang, w1 || ' ' || w2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL
),
f AS (SELECT lang, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE NOT contains(phrase, ' ') GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 10 AND contains(phrase, ' ')),
cuts AS (
  SELECT lang, phrase, a, w, 1 AS k, w[1] AS one, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, a, w, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE len(w) = 3
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, x.f AS l, y.f AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM candidates WHERE len(w) = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE len(w) = 3
  ) GROUP BY ALL
),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase
  WHERE g.most IS NULL OR 100 * g.most < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY "rank" <= 2000
"""


@query
def op12_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = codes.compress(table(spark, sf, "embeddings"), vector="embedding")
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and floored means, written out one after the other."""
    steps = [f"""
whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM whole, range({parts}) t(p)
),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT {entries})
)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min_by(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT vec_id, label, parts.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN book{i} b ON b.p = parts.p
  ) GROUP BY ALL
)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS MATERIALIZED (
  SELECT p, e, list(CAST(m AS BIGINT) ORDER BY k) AS c FROM (
    SELECT p, e, k, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT p, e, k, sum(x[k]) AS s, count(*) AS n FROM near{i}, range(1, (SELECT max(len(x)) + 1 FROM parts)) t(k) GROUP BY ALL
    )
  ) GROUP BY p, e
),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {",".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


ORACLE["op12_codes"] = codes_sql()


@query
def op13_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = lexicon.encode(docs, lexicon.build(docs, public_tokenizers.path("byte_bpe_50k.json")), decoded="decoded")
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.bin_completion import pack
from palisade.llm.collocations import collocations
from palisade.llm.common import fold, read
from palisade.llm.decontamination import contamination
from palisade.llm.imatch import fingerprints
from palisade.llm.jaccard_join import similarity_classes
from palisade.llm.language_id import predict_language
from palisade.llm.lm_score import lm_scores
from palisade.llm.repeats import deduplicated
from palisade.llm.secret_scan import secret_spans
from palisade.llm.token_counts import token_counts
from palisade.llm.token_output import packed_ids
from palisade.llm.toxicity import fit_toxicity, score_toxicity
from palisade.llm.vector_codes import vector_codes


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine; every machine of the cluster has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int) -> Column:
    """True for the fold that is kept out of training; rows without an id train."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict_language(docs, ~held_out(4, 2))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def byte_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(read(spark, sf_dir, "documents"), byte_tokenizer())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(read(spark, sf_dir, "documents"), ~held_out(5, 1))
    return found.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out(3, 1))
    score = F.col("score")
    return score_toxicity(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), score, (score >= 0.7).cast("int").alias("predicted"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), byte_tokenizer())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packed_ids": op2_packed_ids,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_imatch": op6_imatch,
    "op7_bin_completion": op7_bin_completion,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_collocations": op12_collocations,
    "op13_ball_codes": op13_ball_codes,
}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_NEAREST = """
  SELECT vec_id, part, x, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT p.vec_id, p.part, p.x, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts AS p JOIN {books} AS c ON p.part = c.part)
  GROUP BY vec_id, part, x"""
_BOOKS = """
  SELECT part, e, coalesce(n.x, {books}.x) AS x FROM {books} LEFT JOIN (
    SELECT part, e, list(m ORDER BY i) AS x FROM (
      SELECT part, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM {codes}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY part, e, i) GROUP BY part, e) AS n USING (part, e)"""

ORACLE_SQL: dict[str, str] = {
    "op11_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b * 500 AS base, substr(h, b * 1000 + 1, 1098) AS s FROM docs, unnest(range(0, len(h) // 1000 + 1)) AS t(b)),
windows AS (SELECT doc_id, base + i AS p, substr(s, 2 * i + 1, 100) AS g FROM blocks, unnest(range(0, least(500, len(s) // 2 - 49))) AS t(i)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (g) WHERE first < doc_id),
marked AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS new FROM gone),
numbered AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, k),
edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last
  FROM edges JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)""",
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]'),
    lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS w FROM documents),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM pieces, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
halves AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 :], ' ') AS tail FROM candidates, unnest(range(1, k)) AS t(j)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, h.f AS l, r.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (h.f + r.f) AS BIGINT) AS score
  FROM halves AS c JOIN f AS h ON h.lang = c.lang AND h.phrase = c.head JOIN f AS r ON r.lang = c.lang AND r.phrase = c.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM candidates, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best AS b LEFT JOIN inner_parts AS p ON p.lang = b.lang AND p.phrase = b.phrase WHERE p.most IS NULL OR 100 * p.most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_ball_codes": f"""
WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM vectors, unnest(range(16)) AS t(part)),
books0 AS (SELECT part, e, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
codes0 AS ({_NEAREST.format(books='books0')}),
books1 AS ({_BOOKS.format(books='books0', codes='codes0')}),
codes1 AS ({_NEAREST.format(books='books1')}),
books2 AS ({_BOOKS.format(books='books1', codes='codes1')}),
codes2 AS ({_NEAREST.format(books='books2')}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM codes2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM books2) AS codebooks_sha256
FROM coded JOIN vectors USING (vec_id)""",
    "op10_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
docs AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
grams AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT k FROM windows) AS s, unnest(range(1, len(w) - k + 2)) AS t(p)),
hits AS (SELECT doc_id, p, grams.k, item_id FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hits, unnest(range(p, p + k)) AS t(x) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)""",
}

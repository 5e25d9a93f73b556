"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    decontamination,
    embeddings,
    extraction,
    language,
    mixing,
    negatives,
    phrases,
    quality,
    secrets,
    simhash,
    substrings,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").filter("quality = 1")
    return quality.classify_quality(_read(spark, sf_dir, "documents"), trusted)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = language.fold(F.col("doc_id"), 3) == 1
    found = language.identify(docs.filter(~F.coalesce(held_out, F.lit(False))), docs)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = toxicity.score_toxicity(docs, labels.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(_read(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_strings(docs))
    found = secrets.scan_secrets(docs, model)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random",
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.col("found")).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scans": op13_secret_scans,
}

#: Hashes, walks, models and random rounding have no SQL; these results have.
ORACLES: dict[str, str] = {
    "op7_embedding_near_dedup": """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS low FROM v UNION SELECT link.a, reach.low FROM reach JOIN link ON link.b = reach.vec_id)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(low) AS component_id, vec_id = min(low) AS kept
FROM reach GROUP BY vec_id""",
    "op10_substring_dedup": r"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT r, unnest(range(1, len(words) - 33)) AS s, words FROM d WHERE len(words) >= 35),
windows AS (SELECT r, s, array_to_string(words[s:s + 34], ' ') AS passage FROM places),
often AS (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, s + unnest(range(35)) AS p FROM windows WHERE passage IN (SELECT passage FROM often)),
word AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(gone.p) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept
                  FROM word LEFT JOIN gone USING (r, p) GROUP BY r) USING (r)""",
    "op11_phrase_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, size, unnest([w[s:s + size - 1] for s in range(1, len(w) - size + 2)]) AS g
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size)),
f AS (SELECT lang, g, len(g) AS size, count(*) AS a FROM gram GROUP BY lang, g),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE a >= 30),
wider AS (SELECT lang, sub, max(a) AS most FROM (
  SELECT lang, a, unnest([g[s:s + k - 1] for s in range(1, size - k + 2)]) AS sub
  FROM (SELECT *, unnest(range(2, size)) AS k FROM often)) GROUP BY lang, sub),
cut AS (SELECT c.lang, c.g, c.a, k, lf.a AS l, rf.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (lf.a + rf.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) c
  JOIN f lf ON lf.lang = c.lang AND lf.g = c.g[1:k] JOIN f rf ON rf.lang = c.lang AND rf.g = c.g[k + 1:c.size]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1)
SELECT cut.lang AS lang, row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM cut JOIN n ON n.lang = cut.lang LEFT JOIN wider ON wider.lang = cut.lang AND wider.sub = cut.g
WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000""",
    "op12_hard_negatives": """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.q) = len(v.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}

"""Queries over whole tables, one for each operator, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, brown, crf, fim, knnvote, maxmatch, mixing, recipes, secrets, simhash, spelling, vptree, winnow
from touchline.llm.common import table

#: Ranks of the byte-level tokenizer that queries encode by.
RANKS = "byte_bpe_50k.tiktoken"


def op1_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), query_every=20, k=20, factor=1.0)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow.as_text("fingerprint").alias("fingerprint"),
        winnow.as_text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crf.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return out.select("doc_id", "held_out", "score", "predicted", spans.alias("spans"))


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knnvote.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_brown_class_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op7_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxmatch.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumn("target", F.round("target", 6))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")
    number = lambda f: F.size(F.filter("spans", f)).cast("long")
    of_kind = lambda k: number(lambda s: s["kind"] == k)
    kinds = [of_kind(k).alias(f"n_{secrets.KINDS[k]}") for k in range(secrets.BASE)]
    return found.select("doc_id", *kinds, "base_sha256", text.alias("spans"), number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_example"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored()).alias("restored_sha256"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vptree_neighbours, op2_winnowing, op3_simhash_near_duplicates, op4_toxicity_crf, op5_quality_neighbours, op6_brown_class_bigram,
        op7_longest_match_counts, op8_byte_bpe, op9_mixing, op10_secret_ownership, op11_spelling_variants, op12_fill_in_middle, op13_chunk_recipes, pipeline,
    )
}

NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x, v.x) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), weighed AS (
  SELECT doc_id, source, size,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / nullif(size, 0)::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE), 1.0::DOUBLE) AS w,
    ('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT AS drawn
  FROM sized
), keyed AS (
  SELECT doc_id, source, size, -ln((drawn::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / w AS key FROM weighed
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT source, source_size, source_size * 3 AS most, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM sources
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(w) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ranked
), goals AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, max(CASE WHEN most / w > level THEN level END) OVER () * w), most::DOUBLE) AS target FROM levels
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS epochs FROM goals
), running AS (
  SELECT k.doc_id, k.size, k.key, r.*, r.target - r.epochs * r.source_size AS rest,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) AS DOUBLE) AS upto, CAST(sum(k.size) OVER (PARTITION BY k.source, k.key) AS DOUBLE) AS own
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""

MIDDLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM t
), v AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), w AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM w
"""

RECIPE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id NULLS LAST) AS i, count(*) OVER (PARTITION BY sha) AS size,
  first_value(doc_id) OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep FROM t)
SELECT doc_id, keep AS keep_id, size AS group_size, i = 1 AS kept, sha AS text_sha256 FROM r
"""

ORACLE_SQL = {"op12_fill_in_middle": MIDDLE_SQL, "op13_chunk_recipes": RECIPE_SQL, "op1_vptree_neighbours": NEAREST_SQL, "op9_mixing": MIX_SQL}

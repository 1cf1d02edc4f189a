"""The queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gridtally.llm import (
    ann,
    bpe,
    clusters,
    line_dedup,
    lm_score,
    media,
    mixing,
    near_dedup,
    phrases,
    pii,
    token_counts,
    toxicity,
    url_filter,
)
from gridtally.llm.common import table


def op1_url_filter(spark, sf_dir):
    weights, bias = url_filter.fit(url_filter.labelled_table(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, weights, bias).select(
        "page_id", "host", "path", "rule", "verdict", "block_probability"
    )


def op2_ann(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    """documents with personal data replaced, and n_found, the number of replaced values."""
    found = F.aggregate(F.map_values("pii_found"), F.lit(0), lambda n, k: n + k)
    docs = pii.pseudonymise(table(spark, sf_dir, "documents"))
    return docs.withColumn("n_found", found.cast("long")).drop("pii_found")


def op5_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")))


def op6_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_counts.length_report(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


#: The same classes by comparing every pair of texts that share a shingle.
NEAR_SQL = f"""
WITH RECURSIVE same AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS node, count(*) AS copies
  FROM documents GROUP BY 1),
worded AS (
  SELECT node, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM same),
placed AS (
  SELECT node, w, unnest(range(1, greatest(len(w) - {near_dedup.SHINGLE - 1}, 1) + 1)) AS i
  FROM worded WHERE len(w) > 0),
shingles AS (
  SELECT node, array_to_string(w[i:i + {near_dedup.SHINGLE - 1}], ' ') AS s, count(*) AS n
  FROM placed GROUP BY 1, 2),
sizes AS (SELECT node, sum(n) AS n FROM shingles GROUP BY node),
shared AS (
  SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.node > y.node GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b
  WHERE shared.n >= {near_dedup.THRESHOLD} * (p.n + q.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT node, node AS other FROM same
  UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON r.other = e.a)
SELECT d.doc_id, c.class_id, same.copies
FROM documents d JOIN same ON coalesce(d.text, '') = same.text
JOIN (SELECT node, min(other) AS class_id FROM reached GROUP BY node) c USING (node)"""


def fold(n: int):
    """crc32 of the doc_id's digits, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").where(fold(3) != 1)
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, learned), "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm_score.scores(docs, fold(7) == 2, fold(7) == 3)


def op10_media(spark, sf_dir):
    """image_id, vec_id, edit, class_id, n_corners of a picture of every vector and of edited copies.

    No table holds media, so vectors are drawn as pictures.  A second picture of
    each vector whose vec_id is divisible by 10 is an edited copy for the search
    to find.  Pictures have even numbers, copies odd ones; class_id is the least
    image_id of the class.
    """
    vectors = table(spark, sf_dir, "embeddings")
    images = media.vector_images(vectors, "vec_id", "embedding", F.col("vec_id") % 10 == 0)
    number = F.col("id") * 2 + (F.col("edit") != "none").cast("long")
    classes = media.image_classes(images.withColumn("id", number))
    vec_id = F.shiftright("id", 1)
    edit = F.element_at(F.array(*map(F.lit, media.EDITS)), F.expr("pmod(id div 20, 4) + 1").cast("int"))
    return classes.select(
        F.col("id").alias("image_id"),
        vec_id.alias("vec_id"),
        F.when(vec_id * 2 == F.col("id"), "none").otherwise(edit).alias("edit"),
        "class_id",
        "n_corners",
    )


def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op13_clusters(spark, sf_dir):
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def queries():
    return {
        "op1_url_filter": op1_url_filter,
        "op2_ann": op2_ann,
        "op3_mixing": op3_mixing,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_token_counts": op6_token_counts,
        "op7_near_dedup": op7_near_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_lm_score": op9_lm_score,
        "op10_media": op10_media,
        "op11_phrases": op11_phrases,
        "op12_line_dedup": op12_line_dedup,
        "op13_clusters": op13_clusters,
    }


def oracle_sql():
    return {
        "op3_mixing": mixing.report_sql(),
        "op7_near_dedup": NEAR_SQL,
        "op11_phrases": phrases.PHRASES_SQL,
        "op12_line_dedup": line_dedup.REPORT_SQL,
        "op13_clusters": clusters.CLUSTERS_SQL,
    }

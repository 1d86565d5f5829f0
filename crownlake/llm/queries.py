"""The queries of this package, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import encode_media, media_digest

    return media_digest(encode_media(table(spark, sf_dir, "documents")))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_graph import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op7_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of all whole texts of ``documents``, and what their ids decode to."""
    from .sampling import sampled_segmentations

    path = tokenizer_file("piece_bpe_32k.model")
    return sampled_segmentations(table(spark, sf_dir, "documents"), path, keys=["doc_id"], k=3, decoded="decoded")


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_templates import license_digest

    return license_digest(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import linked_groups

    return linked_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_progressive_jpeg, op2_multi_index_hashing, op3_url_graph, op4_best_fit_packing, op5_rule_ensemble, op6_token_counts, op7_gumbel_segmentations, op8_kneser_ney_toxicity, op9_license_scans, op10_jaccard_join)}


#: Sets and links by an inner join on shingles, components by following links.
_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    from .license_templates import digest_sql

    return {"op9_license_scans": digest_sql(), "op10_jaccard_join": _OP10}

"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, jaccard_join, license_scan, line_dedup, ogg_column, packing, suffix_dedup, toxicity, voronoi_knn, warc_index
from tidemark.llm.shared import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines that stay, and the numbers of those that go."""
    docs = documents(spark, sf_dir)
    gone = line_dedup.removed_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    text = F.coalesce("text", F.lit(""))
    n = docs.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    n_removed = F.coalesce(F.size("removed_lines"), F.lit(0))
    return n.join(gone, "doc_id", "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed_lines")
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def _op5_sql() -> str:
    k = license_scan.K
    rows = ", ".join(
        f"({t.number}, '{t.label}', {t.base}, {len(t.words) - k + 1}, {len(t.words)}, {i}, '{' '.join(t.words[i : i + k])}')"
        for t in license_scan.templates()
        for i in range(len(t.words) - k + 1)
    )
    return f"""
WITH t(template, label, base, grams, length, place, gram) AS (VALUES {rows}),
w AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, row, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, row, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM w)
), v AS (
  SELECT doc_id, row, template, label, base, grams, length, pos - place AS diagonal,
         count(*) AS votes, min(pos) AS first, max(pos) AS last
  FROM p JOIN t USING (gram) GROUP BY ALL
), a AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, row, template ORDER BY diagonal) > {license_scan.NEAR}, true) THEN 1 ELSE 0 END AS apart
  FROM v
), s AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, row, template ORDER BY diagonal) AS span FROM a
), m AS (
  SELECT doc_id, row, template, label, base, grams, length, span, sum(votes) AS votes,
         min(first) AS first, max(last) + {k} AS stop, min(diagonal) AS start
  FROM s GROUP BY ALL
), f AS (
  SELECT doc_id, label, base, start, least(1.0, CAST(votes AS DOUBLE) / grams) AS share FROM m
  WHERE CASE WHEN base THEN votes = grams
             ELSE least(1.0, CAST(votes AS DOUBLE) / grams) >= {license_scan.LEAST_SHARE} AND stop - first <= length + {2 * license_scan.NEAR} END
), g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f GROUP BY doc_id
)
SELECT w.doc_id, CAST(w.n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM (SELECT doc_id, sum(len(w)) AS n_words FROM w GROUP BY doc_id) w LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM w.doc_id
"""


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_column.media_features(ogg_column.write_media(documents(spark, sf_dir)))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digest_column(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi_knn.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return voronoi_knn.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum([q.v[i] * d.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_index.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM g
"""

def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.apply_cuts(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_ogg_media": op6_ogg_media,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_voronoi_knn": op8_voronoi_knn,
    "op9_warc_index": op9_warc_index,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {"op5_license_scan": _op5_sql(), "op8_voronoi_knn": OP8_SQL, "op9_warc_index": OP9_SQL}

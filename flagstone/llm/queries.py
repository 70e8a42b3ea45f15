"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flagstone.llm.alignment import alignments
from flagstone.llm.exact_dedup import exact_groups
from flagstone.llm.infilling import infill
from flagstone.llm.lm import held_out_by_key, score_documents
from flagstone.llm.minhash import near_duplicates
from flagstone.llm.mixing import mix
from flagstone.llm.packing import packed_digest
from flagstone.llm.pieces import piece_digests
from flagstone.llm.pivots import near_vectors
from flagstone.llm.quality import score_quality
from flagstone.llm.templates import extract_pages
from flagstone.llm.toxicity import score_toxicity
from flagstone.llm.warc import archive_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     g AS (SELECT norm, arg_min(doc_id, struct_pack(a := -length(t), b := doc_id)) AS keep_id, count(*) AS n FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)""")
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


@query("op9_warc_bundles", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, sha256(h) AS k FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS top FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m""")
def op9_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return archive_report(spark, table(spark, sf, "pages"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_digest(table(spark, sf, "documents"), tokenizer_file())


@query("op1_ppm_scoring")
def op1_ppm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"), held_out_by_key())


@query("op3_pivot_permutation")
def op3_pivot_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op8_template_extraction")
def op8_template_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(table(spark, sf, "pages"))


@query("op7_quality_co_training")
def op7_quality_co_training(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_toxicity_chain")
def op10_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    # The labelled categories that the tables have: poor text, then toxic text.
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    return score_toxicity(table(spark, sf, "documents"), labels, ["poor", "toxic"])


# Wanted shares of tokens by labelled domain.
MIXTURE = {"plain": 0.9, "poor": 0.08, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table as domains: toxic texts, poor texts, and plain ones."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "plain")
    return table(spark, sf, "labels").select("doc_id", domain.alias("domain"))


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), domain_labels(spark, sf), MIXTURE)


@query("op11_fill_in_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     e AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
     g AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m,
                  array_to_string(u[high + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g""")
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return infill(table(spark, sf, "documents"))


@query("op13_prefix_table_pieces")
def op13_prefix_table_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return piece_digests(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignments(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))

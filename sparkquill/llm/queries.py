"""The queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm import ball_kmeans, html_main, license_scan, line_crf, merkle, mixing, oracles, piece_codec, prefix_trie, quality, secret_scan, simhash_dedup, substring_dedup, token_rollup
from sparkquill.tables import settled, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = settled(lambda: quality.judge(_documents(spark, sf_dir)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: mixing.draws(_documents(spark, sf_dir), entropy=0.92, max_repeats=4.0, seed=0))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_documents(spark, sf_dir))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    takedowns = table(spark, sf_dir, "labels").filter("toxic = 1")
    return settled(lambda: token_rollup.maintained(_documents(spark, sf_dir), takedowns))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(spread(table(spark, sf_dir, "pages")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: substring_dedup.removed(_documents(spark, sf_dir), length=100))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprinted(_documents(spark, sf_dir))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(lambda: simhash_dedup.classes(_documents(spark, sf_dir), size=4, radius=4))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Chunks of half the usual length: texts of more than one are in tables of every size.
    return settled(lambda: piece_codec.encoded(_documents(spark, sf_dir), piece_codec.MODEL, piece_codec.CHUNK // 2))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(_documents(spark, sf_dir))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"), line_crf.SAMPLE)
    return line_crf.scored(docs, model)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: ball_kmeans.clustered(spread(table(spark, sf_dir, "embeddings")), k=8, rounds=10, width=64, seed=3))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: prefix_trie.nodes(spread(table(spark, sf_dir, "conversations")), block=100, heads=6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_source_mixing": op2_source_mixing,
        "op3_license_scan": op3_license_scan,
        "op4_token_rollup": op4_token_rollup,
        "op5_html_main_text": op5_html_main_text,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_fingerprints": op7_fingerprints,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_piece_codec": op9_piece_codec,
        "op10_secret_scan": op10_secret_scan,
        "op11_line_quality": op11_line_quality,
        "op12_ball_kmeans": op12_ball_kmeans,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op2_source_mixing": oracles.source_mixing(0.92, 4.0, 0),
        "op4_token_rollup": oracles.token_rollup(),
        "op7_fingerprints": oracles.fingerprints(),
        "op12_ball_kmeans": oracles.ball_kmeans(),
        "op13_prefix_trie": oracles.prefix_trie(),
    }

"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import blockrank, bpe, fim, jaccard, langid, mix, mtree, neardup, ordinal, secrets, simhash, sql, tokenfile, warc
from lexmill.llm.common import table


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.rate(docs, table(spark, sf_dir, "labels"), learn_from=~langid.held_out())


def op2_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.counted(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("bundle", "frame_offset")


def op8_re_pair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_mtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockrank.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_framed_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_metric_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "embeddings"), cosine=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = (
        op1_ordinal_quality, op2_jaccard_regions, op3_prefix_bpe, op4_secret_spans, op5_pareto_mix, op6_language_bits, op7_seekable_warc, op8_re_pair_shards, op9_simhash_edits,
        op10_mtree_top5, op11_geometric_blocks, op12_framed_middle, op13_metric_near_duplicates, op2_jaccard_links,
    )
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_regions": sql.JACCARD, "op2_jaccard_links": sql.JACCARD_LINKS, "op5_pareto_mix": sql.MIX, "op7_seekable_warc": sql.WARC, "op10_mtree_top5": sql.TOP_K,
            "op11_geometric_blocks": sql.RANKED, "op12_framed_middle": sql.MIDDLE, "op13_metric_near_duplicates": sql.NEAR_VECTORS}

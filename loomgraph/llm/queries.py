"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat_format, jaccard_join, quality_rules, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.substring_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("doc")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.sentencepiece_codec import pieces_digest

    return pieces_digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.chat_format import format_conversations, formatted_digest

    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return formatted_digest(format_conversations(rows.unionByName(extra)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomgraph.llm.line_dedup import repeated_chunks

    return repeated_chunks(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", F.hex("digest").alias("digest"), "keeper_id", "keeper_start")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end=0)


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.bin_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end=1, capacity=4096)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op10_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.media_ts import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_quality_rules, op3_substring_dedup, op4_sentencepiece, op5_chat_format,
        op6_line_dedup, op7_token_files, op8_bin_packing, op9_url_filter, op10_media_ts,
    )
}
ORACLES: dict[str, str] = {"op1_jaccard_join": jaccard_join.oracle(), "op5_chat_format": chat_format.oracle(), "op2_quality_rules": quality_rules.oracle(), "op9_url_filter": url_filter.oracle()}

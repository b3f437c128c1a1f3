"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe, chat, fim, htmltext, langid, mpeg, neardup, packing, pii, quality, secrets, tokencount, trie
from textmill.llm.shared import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg.write_mpeg(documents(spark, sf_dir))
    read = mpeg.read_mpeg(media, keep=("doc_id", "n_bytes", "media"))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("layer3 mono hz="), F.col("sample_rate")),
        *[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("n_frames", "n_samples", "duration_us", "crc_ok", "crc_bad", "skipped_bytes", "table_kind", "table_frames")],
        F.concat(F.lit("toc="), F.crc32(F.array_join("table_toc", ",").cast("binary"))),
        F.concat(F.lit("seek="), F.crc32(F.array_join("seek_offsets", ",").cast("binary"))),
        F.concat(F.lit("title="), F.col("tags")["TIT2"]),
    )
    return read.select(
        "doc_id", "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "n_frames", "n_samples", "duration_us", "duration_num", "duration_den", "crc_ok", "crc_bad", "skipped_bytes", "seek_offsets",
    )


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.without_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_lstm")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return htmltext.extract(pages, htmltext.fit(pages)).select("page_id", "url", "text", "n_chars", "n_blocks", "n_content", "n_turned")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), RANKS, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{n}_sha256") for n, c in (("output", F.col("output")), ("restored", back))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", tokencount.n_bytes().alias("n_bytes"))
    table = tokencount.frequent(docs, WORD_TOKENIZER)
    return tokencount.count_tokens(docs, WORD_TOKENIZER, table, keep=("doc_id", "n_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mpeg_audio, op2_quotation_linking, op3_language_id, op4_cost_balanced_packing, op5_pii, op6_minhash_near_dedup, op7_secret_scans,
        op8_html_main_text, op9_quality_rules, op10_byte_bpe, op11_prefix_trie, op12_fill_in_middle, op13_token_counts,
    )
}
SQL: dict[str, str] = {"op2_quotation_linking": chat.SQL, "op11_prefix_trie": trie.SQL, "op12_fill_in_middle": fim.SQL}

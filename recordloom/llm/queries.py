"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import ann, bpe_codec, conversation_repair, embed_dedup, mixing, near_dup, preference, quality, substring_dedup, token_count, toxicity, transport_stream, vector_codes
from recordloom.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

COUNT_TOKENIZER = "byte_bpe_50k.json"
CODEC_TOKENIZER = "word_bpe_49k.json"
#: Token limit of the count query.
LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_count.token_counts(docs, public_tokenizers.path(COUNT_TOKENIZER))
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )


def codec_digests(docs: DataFrame) -> DataFrame:
    """Ids and decoded text of each document as digests."""
    coded = bpe_codec.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(CODEC_TOKENIZER))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"))


#: Scores from which a document counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.5


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality.with_quality(docs, table(spark, sf_dir, "labels")), GOOD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.with_toxicity(docs, table(spark, sf_dir, "labels")), TOXIC)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, F.col("vec_id") % 20 == 0)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = transport_stream.load(transport_stream.store(docs))
    stream = F.col("stream")
    payload = stream["payload"]
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), stream["packets"]),
        F.concat(F.lit("pes="), F.size(stream["stamps"])),
        F.concat(F.lit("last_pts="), F.element_at(stream["stamps"], -1)),
        F.concat(F.lit("random_access="), F.size(stream["random_access"])),
        F.concat(F.lit("discontinuities="), stream["discontinuities"]),
        F.coalesce(stream["error"], F.lit("whole")),
    )
    return read.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.preference_pairs(*preference.with_other_endings(table(spark, sf_dir, "conversations")))
    spans = lambda mask: F.array_join(F.transform(mask, lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    return pairs.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


#: Shares of the tokens that the mixture should have, by domain.
TARGETS = {"good": 0.90, "junk": 0.06, "toxic": 0.04}
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'junk' END"


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.expr(DOMAIN).alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.fit(docs, labelled_domains(spark, sf_dir), TARGETS)[1]


def op11_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vector_codes.books_digest(books)))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ann": op2_ann,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_transport_stream": op7_transport_stream,
        "op8_preference": op8_preference,
        "op9_near_dup": op9_near_dup,
        "op10_mixing": op10_mixing,
        "op11_embed_dedup": op11_embed_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_preference": preference.ORACLE_SQL,
        "op11_embed_dedup": embed_dedup.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
        "op13_conversation_repair": conversation_repair.ORACLE_SQL,
    }

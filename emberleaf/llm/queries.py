"""The registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberleaf.llm import class_lm, embedding_dedup, language_id, minhash_dedup, nearest_neighbours, secret_scan, sentencepiece_codec, source_mix, substring_dedup, toxicity
from emberleaf.llm._spark import table


def remainder(n: int):
    """crc32 of the id as text modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix(docs, texts=False).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder(3) != 1), "text", "lang", "doc_id")
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(5) != 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = class_lm.fit(docs.where(remainder(5) != 1))
    return class_lm.score(docs, model, counts, keep=(F.col("doc_id"), (remainder(5) == 1).alias("held_out")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_language_id, op3_embedding_dedup, op4_toxicity, op5_secret_scans, op6_nearest_neighbours, op7_sentencepiece, op8_minhash_dedup, op9_class_lm, op10_substring_dedup)}
ORACLE: dict[str, str] = {"op1_source_mix": source_mix.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE, "op8_minhash_dedup": minhash_dedup.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE}

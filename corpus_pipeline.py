"""From raw documents to token ids: five stages over the table ``documents``.

Each stage takes all rows that its predecessor kept and returns the columns of ``documents``, with
its decisions carried out; the last one returns token ids. Nulls in any column are allowed: a null text is
empty, a null source is a source, and a document with a null id is told by its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberleaf.llm import language_id, minhash_dedup, secret_scan, sentencepiece_codec, source_mix
from emberleaf.llm._spark import numbered, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior probability of the predicted language.
CERTAIN = 0.5
MASK = "[SECRET]"
#: Bytes of encoded words that a worker keeps, fewer than for the digests alone since ids take memory too.
CACHED_BYTES = 32 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language, which becomes their ``lang``; texts without letters or a likely language go."""
    model = language_id.fit(docs, "text", "lang", "doc_id")
    kept = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates; of rows that repeat an id, one."""
    body = F.coalesce("text", F.lit(""))
    tagged = docs.select(*COLUMNS, numbered(F.col("doc_id"), body).alias("ord"), F.xxhash64(body).alias("th"))
    kept = minhash_dedup.groups(docs.select("doc_id", "text")).where("kept").groupBy("ord").agg(F.min("th").alias("th"))
    return tagged.join(kept, ["ord", "th"], "left_semi").dropDuplicates(["ord", "th"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret masked."""
    return secret_scan.find_secrets(docs.select(*COLUMNS), replacement=MASK).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, the last of a source's budget in part."""
    return source_mix.copies(source_mix.mix(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of ids and decoded text."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"), cached_bytes=CACHED_BYTES)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: Neither language ID nor tokenization can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered query of each operator: whole tables, production parameters, digest columns only."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import byte_bpe, chat_format, filter_audit, fingerprints, hnsw, mixing, ngram_join, oracles, packing, runs, surrogates, token_files, toxicity, warc
from seqloom.llm.common import table


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.self_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern=public_tokenizers.PATTERN)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(turns))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), ["doc_id"])
    return planned.select("row.doc_id", "size", "source_size", "target", "taken")


#: The key of the registered query; a deployment passes its own secret.
SURROGATE_KEY = "seqloom registered query"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    histories = warc.write_and_read(table(spark, sf_dir, "pages"))
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packing.pack(pieces, 2048)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.per_document(table(spark, sf_dir, "documents"), runs.planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_surrogates": op4_surrogates,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc": op7_warc,
    "op8_token_files": op8_token_files,
    "op9_hnsw": op9_hnsw,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_runs": op13_runs,
}
#: The others hash, learn, or encode by what SQL doesn't have; tests hold them against brute force or the libraries.
ORACLE: dict[str, str] = oracles.ORACLE

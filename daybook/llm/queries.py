"""Named queries of the operators, in the columns that they are compared by."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import collocations, export, language, merkle, mixing, packing, quality, scoring, sharding, simhash, substrings, suffixes, topk
from daybook.llm.words import n_words
from daybook.session import scratch

VOCABULARY = "word_bpe_49k.json"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    placed = sharding.shard(_documents(spark, folder), F.col("doc_id"), columns, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 100 == 0)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = language.learn(docs.filter(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text", "lang"))
    named = language.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), profiles)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(_documents(spark, folder).select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.POLICY).alias("kept"), "failures")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("doc_id"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return scoring.likelihoods(_documents(spark, folder), held_out)


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(_documents(spark, folder).select("doc_id", "text")).drop("text")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(_documents(spark, folder), tokenizer()))


def op10_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    export.write(_documents(spark, folder), path, tokenizer())
    return export.read(spark, path, with_ids=False)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_documents(spark, folder))


def op12_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text")
    found = suffixes.repeats(docs).select(
        F.col("doc_id").alias("_doc"), F.col("_sha").alias("_hash"), F.col("spans").alias("_spans"), F.sha2("kept", 256).alias("_kept"))
    rows = docs.select("doc_id", suffixes.text_hash().alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    joined = rows.join(found, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select("doc_id", *suffixes.counted(F.col("n")), F.coalesce("_kept", F.lower(F.hex("hash"))).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    def leaf(text):
        return merkle.digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)

    upper = string.ascii_uppercase
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", upper, upper.lower())))
    found = merkle.proofs(_documents(spark, folder), F.col("source"), F.col("doc_id"), leaf(F.col("text")), altered.alias("altered"))
    folded = found.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("altered", "leaf")))
    return folded.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_topk, op3_language, op4_quality, op5_simhash, op6_mixing, op7_likelihood, op8_substrings, op9_packing, op10_export,
        op11_collocations, op12_suffixes, op13_merkle)}

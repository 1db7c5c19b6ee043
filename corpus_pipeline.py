"""From raw documents to packed sequences: each stage works on all that the one before kept.

All stages take documents with any further columns, under any names, and an empty table gives an empty one of the same columns
(of pieces, from the last stage). Rows are handled one by one unless said otherwise, so repeated rows are kept or dropped alike.
Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import mixing, packing, quality, simhash, substrings
from daybook.llm.queries import tokenizer
from daybook.llm.staging import stage
from daybook.llm.words import n_words


def _whole(docs: DataFrame, *beside: str) -> DataFrame:
    """Each document in one column, out of the way of those that an operator adds, and the columns it reads."""
    return docs.select(F.struct("*").alias("doc"), *beside)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy. Null and empty texts have too few words and go."""
    return quality.ledger(_whole(docs, "text")).filter(quality.passes(quality.POLICY)).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Null, empty and wordless texts are one group;
    of rows repeated whole one stays; a null id is never the smallest unless all are null."""
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that begin in an earlier one, and their new length. Rows without an id keep
    all words; null texts stay null; a text that loses all words becomes empty and stays."""
    # Columns that the operator doesn't read go under names that it doesn't use.
    aside = {c: f"column {i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    cut = substrings.remove(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    back = {name: c for c, name in aside.items()}
    return cut.drop(*substrings.RESULTS).withColumnsRenamed(back).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is one of its own; empty texts weigh nothing."""
    mixed = mixing.mix(_whole(docs, "source"), F.col("doc.doc_id"), n_words(F.col("doc.text")))
    taken = mixed.filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences. A null or empty text is one piece, the end id; a null id stays null."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Mixing draws and packing places as no SQL does; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over documents, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns
of documents. Every stage's result is written to the shared folder and read
again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import decontam, jaccard, mixing, suffix_dedup, toxicity
from vicinity.llm.text import Scratch, by_table, repeat_table, row_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts, and such without tokens, have no evidence and stay. Texts of any length are scored whole. Equal rows stay
    or go together; their order and columns, whatever their names, are kept. Without labels, or with an empty table, nothing goes.
    """
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 that of the smallest id stays.

    A null id comes last; of rows with one id the text of the smallest hash stays, and of equal rows one. Null texts and texts without
    words link with nothing and all stay, repeated rows too. Texts of any length count whole. Columns, whatever their names, are kept;
    an empty table gives an empty table.
    """
    return jaccard.keep_one(docs, 5, 80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 200-byte strings that occur elsewhere too; n_chars, if there, is that of the new text.

    Null texts stay null and shorter ones as they are; repeated rows are repeats, so both lose all bytes that 200-byte strings cover.
    Texts of any length are cut whole. No row goes; other columns, whatever their names, are kept; an empty table gives an empty table.
    """
    cut = suffix_dedup.remove_repeats(docs, 200)
    kinds = dict(docs.dtypes)
    return cut.select(*[F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go.

    What a text holds is found for the text, so equal texts stay or go together. Null, empty and short texts hold nothing and stay.
    Texts of any length are searched whole. Columns, whatever their names, are kept; without benchmark items, or with an empty table,
    nothing goes. Only documents with leaks (by a bit table of their texts, so a few others too) are joined with the decision.
    """
    with Scratch(spark, "leaks") as scratch:
        text = F.col("text").cast("string")
        keys = [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
        found = decontam.find_leaks(docs.select(text.alias("text"), *keys), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("t1", "t2"), decontam.COSINE)
        leaks = scratch.save(found.select("t1", "t2").distinct(), "texts", keep=True)
        table = spark.sparkContext.broadcast(repeat_table(leaks, "t1"))
        rows = docs.select(row_of(docs).alias("row"), *keys)
        kept = by_table(rows, "t1", table, False).select("row").unionByName(by_table(rows, "t1", table, True).join(leaks, ["t1", "t2"], "left_anti").select("row"))
        return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix of sources, and the words it gives.

    Null and empty texts have no words and give none; a null source is a source of its own, the last. Texts of any length count whole.
    Repeated rows are documents of their own. Other columns are not read; an empty table gives an empty result.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_strings),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: SQL can express neither the learned models nor the seeded draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage leaves, and what it read, goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as results:
        for name, stage in STAGES:
            with Scratch(spark, f"pipeline-{name}"):
                before, docs = docs, results.save(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
            results.drop(before)
    return docs

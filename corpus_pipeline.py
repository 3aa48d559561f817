"""From raw documents to training shards: language, near-duplicates, benchmark leaks, source mix, shards.

Every stage is (spark, docs, sf_dir) -> DataFrame, works on all rows its predecessor kept and, but for the last, returns the
columns of docs. Rows are kept whole beside what a stage computes, so extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.llm.decontaminate import mark_contamination
from bookloom.llm.frames import packed, unpacked
from bookloom.llm.langid import UNKNOWN, fit, predict
from bookloom.llm.minhash import SENT_IDS, near_duplicates
from bookloom.llm.mixing import with_copies
from bookloom.llm.sharding import with_shard
from bookloom.session import cut_lineage

#: a document is rejected if no language reaches this probability
LEAST_LANGUAGE = 0.35
SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; those without letters, null and empty texts go. Where no row has a label, no
    language can be learned and none is judged: all with a letter stay."""
    model = fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    seen = predict(packed(docs, "text"), model)
    return unpacked(seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows that repeat an id, one. Rows without
    id, and texts without words, are no duplicates of anything."""
    found = cut_lineage(near_duplicates(docs).select("id", "kept"))
    gone = found.where("not kept").select(F.col("id").alias("doc_id")).distinct()
    repeated = found.where("kept").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("doc_id"))

    def sent(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= SENT_IDS else ids

    left = docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return left
    again = sent(repeated)
    return left.join(again, "doc_id", "left_anti").select(docs.columns) \
        .unionByName(left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    marked = mark_contamination(packed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(marked.where(F.size("items") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those without words are never taken."""
    mixed = with_copies(packed(docs, "doc_id", "text", "source"))
    return unpacked(mixed.where("copies > 0 and size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard of each in `shard`; copies of a text share one."""
    placed = with_shard(packed(docs, "text"), SHARDS, digest="_digest")
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != "shard"], "shard")


STAGES = [("language_id", language), ("minhash_near_dedup", near_dedup), ("decontamination", decontaminate),
          ("source_mixing", mix), ("sharding", shard)]

#: SQL cannot express the language model; tests compare the other stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontam, mixing, neardup, sharding, toxicity
from quernstone.llm.common import n_words, table, written

SHARDS = 16
#: Differing bits of fingerprints of distinct words up to which texts are candidates.
NEAR_BITS = 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from all labelled rows among them.

    A null or empty text scores like any without a term; rows without an id or a label are judged
    but not learned from; repeated rows fare alike; an empty table stays empty; other columns are kept.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Candidates are texts with distinct words within ``NEAR_BITS`` and texts that meet in a
    MinHash band; only texts that share 0.8 of their five-word shingles are linked. Texts without
    words are copies of each other; of repeated rows one stays; null ids come last; an empty table
    stays empty; other columns are kept.
    """
    return neardup.dedup(docs, NEAR_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; rows are judged one by one, so repeated ones fare alike;
    an empty table, of documents or of the benchmark, drops nothing; other columns are kept.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0, 1 or 2) as the mix takes it.

    A null text has no words; a null source is one like others; repeated and tied rows are
    taken apart, so many as come nearest the target; an empty table stays empty. Columns
    called like the mix's own keep their values.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, own))
    mixed = mixing.mix(docs.toDF(*own), n_words(F.col(names["text"])), names["source"], names["doc_id"])
    repeated = mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*own).toDF(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, shuffled reproducibly over 16 shards.

    Null ids and texts are values like others; each of repeated rows gets a slot of its own;
    an empty table stays empty. Columns called shard or slot are replaced.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL can express neither the learned toxicity model nor crc32 and XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs

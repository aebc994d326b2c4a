"""A corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens. Each stage works on all that the one before kept.

A stage is (name, function); function(spark, docs, sf_dir) gives the next stage's documents. All but the last return
the columns of documents. Between stages the rows are written as Parquet to the shared folder and read again.

Defined cases: null and empty texts pass through every stage like other texts; an empty table stays empty; a row
without doc_id cannot be named as a duplicate and is kept; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import byte_bpe, mixing, quality, simhash, toxicity
from waymark.llm.common import filter_texts, numbered_rows, plain_rows, small_side, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return filter_texts(docs, lambda texts: [bool(s >= quality.THRESHOLD) for s in model.score([quality.passages(t) for t in texts])])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))  # of bounded size

    def keep(texts: list[bytes]) -> list[bool]:
        scores = model.value.score(texts)
        model.value.tidy()
        return [bool(s < toxicity.THRESHOLD) for s in scores]

    return filter_texts(docs, keep)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of those of the least doc_id, the first by a hash of the text.

    Rows are told apart by a number of their own, written down before it is used; doc_id only chooses which row stays.
    """
    rows = numbered_rows(docs)
    groups = simhash.near_duplicate_groups(rows.where("_own.key is not null").select("_own", "_text"), "_own", "_text")
    first = written(groups.where("_own = group").select(F.col("group.row").alias("_first")), "first")
    kept = rows.join(small_side(first, 1 << 19), F.col("_own.row") == F.col("_first"), "left_semi")
    return plain_rows(kept.unionByName(rows.where("_own.key is null")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in the order of their training positions; empty ones once."""
    rows = numbered_rows(docs)
    source = F.col(f"_row.c{docs.columns.index('source')}")
    plan = mixing.plan_rows(rows.select("_own", "_text", source.alias("source")), "_own", "_text", "source").where("copies > 0 or size = 0")
    uses = plan.select(F.col("_own.row").alias("_use"), F.when(F.col("copies") > 0, F.col("positions")).otherwise(F.array("position")).alias("_uses"))
    placed = rows.join(small_side(written(uses, "uses"), 1 << 18), F.col("_own.row") == F.col("_use")).withColumn("_at", F.explode("_uses")).orderBy("_at", "_own")
    return plain_rows(placed, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_ids(docs, path, public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe", encode),
]

#: Trained models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus made ready for training: toxic texts out, near copies and benchmark passages out, names hidden, packed.

Every stage works on all rows that its predecessor kept and is written as
Parquet in the shared folder before the next one reads it.

The stages run in one session, whose executors keep what they have once taken:
whole texts go to Python in small batches in all of them.

Near copies and benchmark passages are decided row by row: each row gets a
number in a written table, so null ids and ids that stand on several rows are
no special case. Of a group of copies the row of the smallest id stays (null
ids last, the first row among equals); null and empty texts are no copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm import decontaminate, minhash, packing, pii, toxicity
from glossweave.llm.common import table
from glossweave.llm.queries import pseudonym_key
from glossweave.session import materialize, scratch_path, small_batches

# The rows of run() depend on a trained classifier and on tokenizers; SQL has neither.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that all labels together teach to be toxic go."""
    with small_batches(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
        scored = toxicity.scored(docs, model, "__score")
        # Written here, while batches are small.
        return materialize(scored.filter("__score < 0.5").select(*docs.columns), "clean")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written table of the rows with a number each, and the name of that column."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8) stays: the one with the smallest id."""
    rows, name = numbered(docs)
    with small_batches(spark):
        groups = minhash.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("row"), "component_id").join(
        rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("id")), "row"
    )
    named = materialize(named, "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))["row"].alias("row")
    gone = named.join(named.groupBy("component_id").agg(first), "row", "left_anti")
    gone = materialize(gone.select(F.col("row").alias(name)), "gone")
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    rows, name = numbered(docs)
    with small_batches(spark):
        found = decontaminate.contaminated(rows.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        gone = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def without_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pii.pseudonymise(docs, pseudonym_key(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    # The executors are full of what earlier stages took: a smaller memory of pieces costs time only.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, added=True, most=200_000, chars=1_000_000)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_names),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

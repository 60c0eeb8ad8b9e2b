"""The training-data pipeline: quality rules, line dedup, near-duplicate groups, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet into the
shared folder and reads it again as the next one's docs. All but the last return the columns of documents, with n_chars
brought up to date where a text was cut. A document whose whole text was cut stays as an empty text.

A row is known by doc_id and the hash of its text, compared with nulls, so rows with a null id and different texts under
one id are judged each. Of rows that share both, one stays after the stage of near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bin_packing import pack_documents
from loomgraph.llm.jaccard_join import jaccard_components
from loomgraph.llm.line_dedup import remove_chunks
from loomgraph.llm.quality_rules import judge
from loomgraph.llm.shared import save
from loomgraph.llm.substring_dedup import remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def _keyed(docs: DataFrame, keys: DataFrame, how: str, more: str = "") -> DataFrame:
    """docs with or without the rows that keys (doc_id, text_hash) name."""
    return docs.alias("d").join(keys.alias("k"), F.expr(f"d.doc_id <=> k.doc_id and xxhash64(d.text) = k.text_hash {more}"), how).select(*[F.col(f"d.`{n}`") for n in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    rejected = judge(keyed, labels, keys=("text_hash", "lang")).where("not kept").select("doc_id", "text_hash", "lang").distinct()
    return _keyed(docs, rejected, "left_anti", "and d.lang <=> k.lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut out of all but the first document that has them."""
    return _measured(remove_chunks(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, one with an id before one without."""
    found = jaccard_components(docs, with_roots=True).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    found = save(found.withColumn("place", place), "found")
    first = found.where("root is not null").groupBy("root").agg(F.min("place").alias("first"))
    later = found.join(first, "root").where("place <> first").select("doc_id", "text_hash")
    kept = _keyed(docs, later, "left_anti")
    again = found.where("copies > 1").select("doc_id", "text_hash")
    if again.isEmpty():
        return kept
    one = _keyed(kept, again, "left_semi").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)
    return _keyed(kept, again, "left_anti").union(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all but the first document that has them."""
    return _measured(remove_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: Encoding with a tokenizer can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

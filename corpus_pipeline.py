"""The corpus pipeline: five stages, each one operator of cairnlake.llm over all documents.

Each stage takes (spark, docs, sf_dir) and returns documents' columns, the last its own result.
run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import fresh_path, stored, table
from cairnlake.llm.jaccard import BROADCAST_IDS, jaccard_components
from cairnlake.llm.mixing import mixed_documents
from cairnlake.llm.pieces import sentencepiece_documents
from cairnlake.llm.pii import find_pii, redacted
from cairnlake.llm.quality import score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    used = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    whole = docs.select(*used, F.struct("*").alias("_row"))  # so that no name clashes
    return score_quality(whole, table(spark, sf_dir, "labels"), keep=("_row",)).filter("keep").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, that of the smallest doc_id; of rows that
    repeat a doc_id and its text too, one. Documents without words link with nothing and stay,
    as do those without a doc_id. Where rows of one doc_id have different texts, they are one
    node, and stay or go together."""
    groups = jaccard_components(docs).select(F.col("doc_id").alias("_id"), "component_id").filter("_id IS NOT NULL AND _id <> component_id").distinct()
    groups = stored(groups.select("_id"), "pipeline-copies")
    few = groups.count() <= BROADCAST_IDS  # then no text is exchanged
    left = docs.select(F.col("doc_id").alias("_d"), F.struct("*").alias("_row")).join(F.broadcast(groups) if few else groups, F.col("_d") == F.col("_id"), "left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    if not again.isEmpty():
        same = Window.partitionBy("_d", F.sha2(F.coalesce("_row.text", F.lit("")), 256)).orderBy(F.xxhash64("_row"))
        rest = left.join(again, F.col("_d") == F.col("_id"), "left_semi").withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k")
        left = left.join(again, F.col("_d") == F.col("_id"), "left_anti").unionByName(rest)
    return left.select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data spans replaced by their kind; no document goes."""
    found = find_pii(docs.select("text", F.struct("*").alias("_row")), keep=["_row"])
    spans = F.concat("base", "added")
    out = found.select("_row", F.when(F.size(spans) > 0, redacted(F.col("text"), spans)).otherwise(F.col("_row")["text"]).alias("_new"))
    columns = [F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, the last copy cut where a block ends."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text of the mix, and whether they decode to it."""
    import public_tokenizers

    out = sentencepiece_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express a trained classifier or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

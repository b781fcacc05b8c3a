"""The corpus pipeline: documents through five stages, each a job that is written and read again.

Every stage but the last returns the columns of documents. Rows without an id stay
with the others; of rows that are equal in every column, near-duplicate removal keeps
one. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.llm import bpe as bpe_op
from volspan.llm import decontaminate as leaks_op
from volspan.llm import jaccard_join as jaccard_op
from volspan.llm import quality_rules as quality_op
from volspan.llm import secret_scan as secrets_op
from volspan.llm.shared import WorkTables, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids up to which a list of them is broadcast to the scan of the documents; beyond, both are shuffled.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Bands are fitted on texts labelled good."""
    whole, chunks = quality_op.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_op.quality_rules(docs, out="quality verdict", keep=COLUMNS, document_bands=whole, chunk_bands=chunks)
    return judged.where(F.col("`quality verdict`.kept")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one with the smallest id stays."""
    groups = jaccard_op.jaccard_components(docs, k=5, percent=80)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")
    ids = stored(groups.groupBy("doc_id").agg(F.sum(stays).alias("kept_rows")), "near_duplicates")
    gone = ids.where("kept_rows = 0 and doc_id is not null").select(F.col("doc_id").alias("gone id"))
    again = ids.where("kept_rows > 1").select(F.col("doc_id").alias("again id"))
    n_gone, n_again = gone.count(), again.count()
    if n_gone <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = docs.join(gone, docs["doc_id"] == F.col("gone id"), "left_anti").select(*COLUMNS)
    if n_again:  # rows of one id, or without any: equal ones are one
        again = F.broadcast(again) if n_again <= BROADCAST_IDS else again
        same = out["doc_id"].eqNullSafe(F.col("again id"))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates())
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts overlap none and stay."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks_op.decontaminate(docs, bench).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced, and `n_chars` follows; null texts stay null."""
    clean = secrets_op.redact_secrets(docs, out="redacted text", keep=COLUMNS)
    changed = F.col("`redacted text`.n_spans") > 0
    text = F.col("`redacted text`.text")
    n_chars = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; a null text has none."""
    import public_tokenizers

    coded = bpe_op.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out="coded", keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "coded.*")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: Compression ratios, spaced seeds and guess costs have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with WorkTables(spark) as work:  # what a stage read goes when its own table is written
        for name, stage in STAGES[:-1]:
            read, docs = list(work.paths), work.stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            work.drop(read)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))

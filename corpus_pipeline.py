"""The corpus pipeline over documents: five stages, each written as Parquet and read
again as the next one's input.

Every stage but the last returns the columns of documents, in their order. For all of
them: rows without doc_id have no identity, the stages that compare documents keep them;
null and empty texts are kept and change nothing; texts may be of any length; an empty
table gives an empty one; columns besides doc_id, text and n_chars are carried along
whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import bpe, decontam, neardup, secrets, toxicity
from terrasift.llm.common import keep, only_ids, table, without_ids


def _own_names(stage):
    """The stage with columns besides doc_id, text and n_chars under names that nothing else has."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [n if n in ("doc_id", "text", "n_chars") else f"carried_{i}" for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).toDF(*names)

    return run


@_own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Each row is judged by its text
    alone, so rows with equal texts share their fate; labels teach, they do not decide."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, predicted="_toxic").where("_toxic = 0").select(docs.columns)


@_own_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares 0.8 of its five-word shingles, pair by pair, the
    document with the smallest id stays. Rows with equal ids are documents of their
    own while their texts differ, the smallest text first; of equal ones one stays."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        found = neardup.near_duplicates(docs, k=5, percent=80)
        return without_ids(docs, found.where("not kept").select("doc_id").distinct(), "doc_id").select(docs.columns)
    known = neardup.numbered(docs.where("doc_id is not null"), "doc_id")
    found = neardup.near_duplicates(known, id_col="_row", k=5, percent=80)
    rest = without_ids(known, found.where("not kept").select("_row"), "_row")
    return rest.select(docs.columns).union(docs.where("doc_id is null"))


@_own_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more go. Rows that share a
    doc_id are judged by their own texts, repeated rows alike."""
    benchmark = table(spark, sf_dir, "benchmark")
    ids = lambda rows: keep(decontam.contaminated(rows, benchmark).select(F.col("id").alias("doc_id")).distinct())
    found = ids(docs)
    rows = keep(only_ids(docs.select("doc_id", "text"), found, "doc_id").distinct())
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without_ids(docs, found, "doc_id").select(docs.columns)
    known = neardup.numbered(rows, "doc_id")
    bad = known.join(ids(known.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row"), "_row").select("doc_id", F.sha2("text", 256).alias("_sha"))
    return without_ids(docs.withColumn("_sha", F.sha2("text", 256)), bad, ["doc_id", "_sha"]).select(docs.columns)


@_own_names
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; n_chars follows where a text changes. No row
    goes, repeated rows stay repeated."""
    found = secrets.scan(docs)
    changed = F.size("spans") > 0
    found = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row left; a null text has no tokens."""
    found = bpe.encode_decode(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]
#: SQL expresses neither the classifier nor the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs) if i < len(STAGES) else docs
    return docs

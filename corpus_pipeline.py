"""The corpus pipeline: documents pass through five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. A stage keeps rows it has no ground to reject: null and empty texts, null ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import bpe, decontaminate, jaccard, lines, toxicity
from pixelmill.llm.text import read, shared_dir


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """docs with its columns of these names (an operator's own) under others, until _own() brings them back."""
    return docs.select([F.col(f"`{c}`").alias(f"__own_{c}" if c.lower() in names else c) for c in docs.columns])


def _own(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from out."""
    there = set(out.columns)
    return out.select([F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in there else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    out = toxicity.predicted(_apart(docs, "score", "predicted"), read(spark, sf_dir, "labels"))
    return _own(out.filter("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of lines; n_chars follows the text."""
    out = lines.deduplicated(_apart(docs, "kept_text", "n_lines", "removed_runs"))
    cut = F.size("removed_runs") > 0
    made = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _own(out.withColumns(made), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of rows with one id and one text one.

    A row is known by its id and the digest of its text, so rows that share an id but not the text are judged apart."""
    rows = docs.withColumn("__row", F.md5("text"))
    kept = jaccard.near_duplicates(rows, carry=("__row",)).filter("doc_id = component_id")
    kept = kept.groupBy(F.col("doc_id").alias("__id"), F.coalesce("__row", F.lit("")).alias("__digest")).agg(F.count(F.lit(1)).alias("__times"))
    named = rows.join(kept, (rows["doc_id"] == kept["__id"]) & (F.coalesce(rows["__row"], F.lit("")) == kept["__digest"]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    # repeated rows are few as a rule, and combined before they are shuffled
    again = named.filter("__times > 1").groupBy("__id", "__digest").agg(F.min_by(F.struct(*own), F.to_json(F.struct(*own))).alias("__first")).select("__first.*")
    return named.filter("__times = 1").select(*own).unionAll(again).unionAll(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and of the decoded text."""
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.tokenized(docs).select(*names, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Model fitting and automata can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

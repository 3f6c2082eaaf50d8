"""Tables that are written: passages by document, JSON logs, backups, versions; and labelled question sets that are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = "question string, reference string, relevant_filenames array<string>, relevant_chunk_ids array<string>, relevant_passages array<string>, expect_no_context boolean, history array<struct<role:string,content:string>>, answer_contains array<string>, answer_contains_all array<array<string>>, answer_excludes array<string>, filenames array<string>, tags array<string>, chain string, task string"


def write_passages(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Put documents' passages into a table in partitions by a hash of the file name; only partitions they fall into change.

    chunks must hold every passage of those partitions that stays (see corpus.upserted).
    """
    part = F.pmod(F.xxhash64("filename"), F.lit(buckets)).cast("int")
    spark = chunks.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        chunks.withColumn("part", part).repartition("part").sortWithinPartitions("filename", "ordinal").write.mode("overwrite").partitionBy("part").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_log(rows: DataFrame, path: str, *order: str) -> None:
    """A log as JSON lines, oldest first within each file, files by range of the order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").json(path)


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, refused) of a JSON lines file; refused rows carry the rule they break."""
    rows = spark.read.schema(QUESTION).json(path)
    bad = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "no question")
    labelled = F.size(F.coalesce("relevant_filenames", F.array())) + F.size(F.coalesce("relevant_chunk_ids", F.array())) + F.size(F.coalesce("relevant_passages", F.array())) > 0
    bad = bad.when(F.coalesce("expect_no_context", F.lit(False)) & labelled, "expects nothing but has labels").when(F.col("task").isNotNull() & ~F.col("task").isin("summarize", "compare", "brief"), "unknown task")
    checked = rows.withColumn("rule", bad)
    return checked.filter("rule is null").drop("rule"), checked.filter("rule is not null")


def manifest(docs: DataFrame, name: str, digest: str, size: str) -> DataFrame:
    """A backup's list: name, sha, size, and whether the original is at hand."""
    return docs.select(F.col(name).alias("name"), F.col(digest).alias("sha"), F.col(size).alias("size"), F.lit(True).alias("original"))


def restore_plan(backup: DataFrame, stored: DataFrame, max_bytes: int) -> DataFrame:
    """(name, outcome) of a backup against what is stored: skipped, missing, rejected or queued."""
    both = backup.join(stored.select("name", F.col("sha").alias("have")), "name", "left")
    outcome = F.when(F.col("have").eqNullSafe(F.col("sha")), "skipped").when(~F.col("original"), "missing").when(F.col("size") > max_bytes, "rejected").otherwise("queued")
    return both.select("name", outcome.alias("outcome"))


def kept_versions(versions: DataFrame, keep: int) -> DataFrame:
    """The newest keep versions of each name; a version equal to the one before it is none."""
    w = Window.partitionBy("name")
    fresh = versions.withColumn("before", F.lag("sha").over(w.orderBy("saved"))).filter("before is null or before <> sha")
    return fresh.withColumn("n", F.row_number().over(w.orderBy(F.desc("saved")))).filter(F.col("n") <= keep).drop("n", "before")

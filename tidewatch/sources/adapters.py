"""The test tables in the shape of contents, comments, users, posts, threads and verdicts.

``seq`` is the order in which rows came in; "first" and "latest" always refer to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"),
        F.col("l_orderkey").alias("content_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_quantity").cast("long").alias("like_count"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.floor(F.col("l_tax") * 100).cast("long").alias("reply_count"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("content_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_totalprice").alias("view_count"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("status"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sign"),
        F.greatest(F.lit(0), F.floor("c_acctbal")).cast("long").alias("follower"),
        (F.col("c_nationkey") * 40).cast("long").alias("following"),
        (key % 7).cast("int").alias("level"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("face"), key.cast("string"), F.lit(".jpg"))).alias("avatar"),
        F.when(key % 3 == 0, 0).otherwise(-1).alias("verify_type"),
        F.when(key % 4 == 0, None).otherwise(key % 3).cast("long").alias("post_count"),
        F.when(key % 6 == 0, -1).otherwise(key % 2).cast("long").alias("upload_count"),
        F.when(key % 2 == 0, F.concat(F.lit("20"), F.lpad((key % 25).cast("string"), 2, "0"), F.lit("-03-01"))).otherwise((key * 1_000_000).cast("string")).alias("registered_raw"),
    )


def comments_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("comment_id"),
        F.col("event_type").alias("content_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        F.floor("value").cast("long").alias("like_count"),
        F.col("event_id").alias("seq"),
    )


def comments_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"),
        F.col("lang").alias("content_id"),
        F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("user_id"),
        "text",
        F.col("doc_id").alias("seq"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots have root_id 0; identifiers start at 100 so that none is 0."""
    base = (F.col("conv_id") + 1) * 100
    return table(spark, sf_dir, "conversations").select(
        (base + F.col("turn")).alias("comment_id"),
        F.when(F.col("turn") == 0, 0).otherwise(base).alias("root_id"),
        F.when(F.col("turn") == 0, 0).otherwise(base + F.col("turn") - 1).alias("parent_id"),
        F.col("role").alias("user_name"),
        F.col("turn").alias("seq"),
        "text",
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("user_id"), F.col("toxic").alias("type_id"), (50 + 40 * F.col("quality")).cast("double").alias("confidence")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments_text(spark, sf_dir).filter("content_id <> 'en'")
    return rows.select(F.col("comment_id").alias("post_id"), "user_id", "text", "seq", (F.col("comment_id") % 3 == 0).alias("is_repost"))


def scored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of users as an engine run leaves them, one row for each document id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("lang").alias("content_id"), (F.col("n_chars") % 1001 / 10).alias("score"), F.col("doc_id").alias("seq")
    )

"""Dedup, upsert, set operations, first-N and paging on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import features


def pick_one(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. A bounded number of rows leaves each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_by_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return pick_one(rows, keys, F.col(seq))


def latest_by_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return pick_one(rows, keys, F.col(seq).desc())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows of both; where a key is in ``new``, its latest row there wins."""
    fresh = latest_by_key(new, keys, seq)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def append_new_only(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """``old`` and the first row of each key of ``new`` that ``old`` does not have."""
    return old.unionByName(first_by_key(new, keys, seq).join(old.select(*keys), keys, "left_anti"))


def first_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows, with the total number of rows and of pages (one at least)."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def comment_tree(comments: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of root comments, newest first, each with its replies (oldest first, nested), and total and total_pages.

    Replies are gathered for the page's roots only; the page is at most ``size`` rows."""
    roots = page(comments.filter("root_id = 0"), [F.desc("comment_id")], number, size)
    replies = comments.select(F.col("root_id").alias("root"), F.struct("seq", *[c for c in comments.columns if c not in ("seq", "root_id")]).alias("reply"))
    found = replies.join(F.broadcast(roots.select(F.col("comment_id").alias("root"))), "root").groupBy("root").agg(F.array_sort(F.collect_list("reply")).alias("replies"))
    return roots.join(found, F.col("comment_id") == F.col("root"), "left").drop("root")


def pending(everything: DataFrame, done: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    """Keys of ``everything`` that are neither done nor queued."""
    return everything.select(key).distinct().join(done.select(key), key, "left_anti").join(queued.select(key), key, "left_anti")


def pending_counts(everything: DataFrame, done: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    """How many keys are pending, done and queued among all."""
    marked = everything.select(key).distinct().join(done.select(key).distinct().withColumn("done", F.lit(1)), key, "left").join(queued.select(key).distinct().withColumn("queued", F.lit(1)), key, "left")
    return marked.agg(
        F.count_if(F.col("done").isNull() & F.col("queued").isNull()).alias("pending"),
        F.count("done").alias("skipped_done"),
        F.count("queued").alias("skipped_queued"),
    )


def purge(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that do not meet the condition; a null condition keeps the row."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def coverage(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """Share of the declared replies that were collected, and whether it is low; null where none were declared."""
    share = F.try_divide("collected", "declared")
    return rows.withColumn("coverage", share).withColumn("low", share < least)


def failure_codes(rows: DataFrame) -> DataFrame:
    """Failed requests and contents by code; 0 and null are no failure."""
    failed = rows.filter(F.coalesce("code", F.lit(0)) != 0)
    return failed.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("content_id").alias("n_contents"))


def user_detail(user_id: int, report: DataFrame, comments: DataFrame, users: DataFrame, most: int = 5) -> DataFrame:
    """One row: the user's report row, whether there is a profile, the year of registration (from the raw date, else from
    the band of the id), the number of comments, and the latest ones, newest first."""
    own = comments.filter(F.col("user_id") == user_id)
    latest = own.orderBy(F.desc("created_at"), "comment_id").limit(most)
    listed = latest.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("minus_at"), "comment_id", "content_id", "like_count"))).alias("latest"))
    profile = users.filter(F.col("user_id") == user_id).select("user_id", "registered_raw", F.lit(True).alias("profile_present"))
    row = report.filter(F.col("user_id") == user_id).join(own.groupBy("user_id").agg(F.count("*").alias("n_comments")), "user_id", "left").join(profile, "user_id", "left")
    year = F.coalesce(F.regexp_extract("registered_raw", r"^(20\d\d)-", 1).try_cast("int"), features.id_year(F.col("user_id")))
    return row.crossJoin(listed).select(*report.columns, F.coalesce("profile_present", F.lit(False)).alias("profile_present"), year.cast("int").alias("year"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "latest")

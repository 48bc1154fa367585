"""Windows anchored at the first event, bursts, registration batches, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.storage import written


def window_spans(rows: DataFrame, width: int) -> DataFrame:
    """Per content: its first comment's time and its number of windows, for rows (content_id, user_id, at)."""
    spans = rows.groupBy("content_id").agg(F.min("at").alias("t0"), F.max("at").alias("t1"))
    return spans.select("content_id", "t0", F.ceil((F.col("t1") - F.col("t0")) / width).cast("long").alias("n_windows")).filter("n_windows > 0")


def window_users(comments: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The spans of all contents, and the distinct users of each window that has any."""
    rows = comments.filter("created_at IS NOT NULL").select("content_id", "user_id", F.unix_micros("created_at").alias("at"))
    spans = window_spans(rows, width)
    placed = rows.join(spans, "content_id").withColumn("slot", F.floor((F.col("at") - F.col("t0")) / width).cast("long")).filter("slot < n_windows")
    return spans, placed.select("content_id", "user_id", "slot").distinct()


def burst_windows(comments: DataFrame, width_s: int = 600) -> DataFrame:
    """Distinct users in tumbling windows that start at a content's first comment; empty windows count 0.

    Windows start before the last comment only, so a comment exactly on the last boundary is in none."""
    width = width_s * 1_000_000
    spans, users = window_users(comments, width)
    slots = spans.select("content_id", "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1)).alias("slot"))
    counts = users.groupBy("content_id", "slot").agg(F.count("*").alias("n_users"))
    return slots.join(counts, ["content_id", "slot"], "left").select(
        "content_id", "slot", F.timestamp_micros(F.col("t0") + F.col("slot") * width).alias("window_start"), F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users")
    )


def burst_scores(comments: DataFrame, width_s: int = 600, z_limit: float = 2.0) -> DataFrame:
    """Users of windows far above their content's mean: min(1, z / 5) for each such window, divided by the content's maximum.

    Empty windows enter the mean and the deviation by their number only and are never made."""
    spans, users = window_users(comments, width_s * 1_000_000)
    users = written(users, "window-users")
    counts = users.groupBy("content_id", "slot").agg(F.count("*").alias("n_users"))
    sums = counts.groupBy("content_id").agg(F.sum("n_users").alias("s"), F.sum(F.col("n_users") * F.col("n_users")).alias("q"))
    n, total = F.col("n_windows"), F.col("s")
    variance = F.try_divide(F.col("q") - F.try_divide(total * total, n), n - 1)
    stats = sums.join(spans, "content_id").select("content_id", F.try_divide(total, n).alias("mean"), F.sqrt(variance).alias("sd"))
    hot = counts.join(stats, "content_id").filter("sd > 0").withColumn("z", F.try_divide(F.col("n_users") - F.col("mean"), F.col("sd"))).filter(F.col("z") > z_limit)
    hot = hot.select("content_id", "slot", F.least(F.lit(1.0), F.col("z") / 5).alias("gain"))
    raw = users.join(hot, ["content_id", "slot"]).groupBy("content_id", "user_id").agg(F.sum("gain").alias("raw"))
    most = raw.groupBy("content_id").agg(F.max("raw").alias("most"))
    return raw.join(most, "content_id").select("content_id", "user_id", (F.col("raw") / F.col("most")).alias("score"))


def registration_batches(registrations: DataFrame) -> DataFrame:
    """Users registered on days with more than mean + 2 sd registrations: day count / largest such count."""
    days = registrations.filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))
    limit = days.agg((F.avg("n") + 2 * F.stddev_samp("n")).alias("threshold")).scalar()
    peaks = days.filter(F.col("n") > limit)
    most = peaks.agg(F.max("n").alias("most")).scalar()
    return registrations.join(peaks, "day").select("user_id", "day", (F.col("n") / most).alias("score"))


def timeline(comments: DataFrame, width_min: int = 30) -> DataFrame:
    """Comments in bins that start at the minute of a content's first comment; bins without any are left out."""
    rows = comments.filter("created_at IS NOT NULL")
    start = rows.groupBy("content_id").agg(F.date_trunc("minute", F.min("created_at")).alias("t0"))
    width = width_min * 60
    slot = F.floor((F.unix_seconds("created_at") - F.unix_seconds("t0")) / width).cast("long")
    bins = rows.join(start, "content_id").withColumn("bin", F.timestamp_seconds(F.unix_seconds("t0") + slot * width))
    return bins.groupBy("content_id", F.date_format("bin", "yyyy-MM-dd HH:mm").alias("bin_start")).agg(F.count("*").alias("n"))


def inactivity_gap(comments: DataFrame, limit_days: int = 30) -> DataFrame:
    """Longest run of days between two active days of a user, whether it is long, the last activity and a reason."""
    days = comments.select("user_id", F.to_date("created_at").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))
    gaps = days.withColumn("gap", F.date_diff("day", before)).groupBy("user_id").agg(F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("gap_days"), F.max("day").alias("last_day"))
    flag = F.col("gap_days") >= limit_days
    return gaps.select(
        "user_id", "gap_days", flag.alias("sudden"), F.date_format("last_day", "yyyy-MM-dd").alias("last_active"), F.when(flag, F.concat(F.lit("silent for "), F.col("gap_days").cast("string"), F.lit(" days"))).alias("reason")
    )


def reactivation_gap(current: DataFrame, history: DataFrame, limit_days: int = 30) -> DataFrame:
    """Whole days between a user's last history entry and latest comment, and whether that is more than the limit."""
    now = current.groupBy("user_id").agg(F.max("created_at").alias("now_at"))
    then = history.groupBy("user_id").agg(F.max("created_at").alias("then_at"))
    days = F.floor((F.unix_seconds("now_at") - F.unix_seconds("then_at")) / 86_400).cast("long")
    return now.join(then, "user_id").select("user_id", days.alias("gap_days")).withColumn("reactivated", F.col("gap_days") > limit_days)


def activity_hours(comments: DataFrame, top: int = 5) -> DataFrame:
    """The most active hours of each user, most comments first, then the earlier hour."""
    hours = comments.groupBy("user_id", F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "hour"))
    return hours.withColumn("rank", rank).filter(F.col("rank") <= top)


def history_habits(comments: DataFrame) -> DataFrame:
    """Each user's most active hour (the earlier of equal ones) and mean text length to one decimal."""
    hours = comments.groupBy("user_id", F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    best = F.min(F.struct(-F.col("n"), F.col("hour").alias("hour")))["hour"]
    return hours.groupBy("user_id").agg(best.alias("active_hour"), F.round(F.sum("chars") / F.sum("n"), 1).alias("avg_length"))


def daily_activity(comments: DataFrame, days: int = 30) -> DataFrame:
    """Counts of each user's most recent active days."""
    counts = comments.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= days).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def gap_statistics(comments: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The comments with the gap to the one before of the same user and content, and aggregates of these gaps."""
    own = Window.partitionBy("content_id", "user_id").orderBy("created_at")
    gap = (F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(own))) / 1e6
    return comments.withColumn("gap", gap), [F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap")]


def variation() -> Column:
    return F.when((F.col("n_gaps") >= 2) & (F.col("mean_gap") > 0), F.col("sd_gap") / F.col("mean_gap"))


def regularity_score(cv: Column) -> Column:
    return F.when(cv < 0.3, 0.9).when(cv < 0.5, 0.6).when(cv < 0.8, 0.3).otherwise(0.0)


def time_regularity(comments: DataFrame) -> DataFrame:
    """Coefficient of variation of the gaps between a user's comments on a content, and its score; three comments at least."""
    rows, sums = gap_statistics(comments.filter("created_at IS NOT NULL").select("content_id", "user_id", "created_at"))
    stats = rows.groupBy("content_id", "user_id").agg(*sums).withColumn("cv", variation())
    return stats.select("content_id", "user_id", "cv", regularity_score(F.col("cv")).alias("f16"))

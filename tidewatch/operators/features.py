"""Features of a user on a content, each between 0 and 1. ``cc`` is the user's number of comments there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import DEFAULT_SIGN, NO_AVATAR, any_hit, distinct_hits, garbled_name

#: Upper bounds of account numbers and the year in which they were given out; later numbers: 2025.
YEAR_BANDS = [
    (1e6, 2010),
    (1e7, 2011),
    (1e8, 2013),
    (2e8, 2015),
    (3e8, 2017),
    (4e8, 2018),
    (5e8, 2019),
    (6e8, 2020),
    (7e8, 2021),
    (8e8, 2022),
    (1e9, 2023),
    (1.2e9, 2024),
]
LAST_YEAR = 2025
#: Suspicion of each account level; unknown levels 0.3.
LEVEL_SCORES = {0: 1.0, 1: 0.8, 2: 0.6, 3: 0.3, 4: 0.1, 5: 0.0, 6: 0.0}


def id_year(user_id: Column) -> Column:
    """The year band of an account number."""
    year = F.lit(LAST_YEAR)
    for bound, value in reversed(YEAR_BANDS):
        year = F.when(user_id < int(bound), value).otherwise(year)
    return year


def registration_date(raw: Column) -> Column:
    """A date text of at least ten characters, or seconds since 1970 above 10^9; else null."""
    seconds = raw.try_cast("long")
    return F.coalesce(
        F.when(F.length(raw) >= 10, F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date")),
        F.when(seconds > 1_000_000_000, F.to_date(F.timestamp_seconds(seconds))),
    )


def registration_year(raw: Column, user_id: Column) -> Column:
    return F.coalesce(F.year(registration_date(raw)), id_year(user_id))


def account_age(raw: Column, user_id: Column, level: Column, cc: Column, as_of: str) -> Column:
    """By days since registration; without a date by January 1 of the number's year, without a number by level."""
    from_band = F.when(user_id.isNotNull(), F.make_date(id_year(user_id), F.lit(1), F.lit(1)))
    days = F.date_diff(F.to_date(F.lit(as_of)), F.coalesce(registration_date(raw), from_band))
    return (
        F.when(days.isNull(), F.when(level <= 1, 0.6).otherwise(0.3))
        .when(days < 30, F.when(cc >= 5, 0.9).otherwise(0.7))
        .when(days < 90, F.when(cc >= 5, 0.6).otherwise(0.4))
        .when(days < 180, F.greatest(F.lit(0.30), F.least(F.lit(1.0), cc * 0.03)))
        .when(days < 365, F.greatest(F.lit(0.20), F.least(F.lit(1.0), cc * 0.02)))
        .when(days < 730, F.greatest(F.lit(0.10), F.least(F.lit(1.0), cc * 0.01)))
        .when(days < 1825, 0.05)
        .otherwise(0.02)
    )


def follow_ratio(follower: Column, following: Column, has_profile: Column) -> Column:
    return (
        F.when(~has_profile, 0.3)
        .when((follower < 50) & (following > 500), 0.9)
        .when((follower < 100) & (following > 300), 0.7)
        .when((follower < 200) & (following > 200), 0.4)
        .otherwise(0.0)
    )


def level_score(level: Column, cc: Column) -> Column:
    base = F.lit(0.3)
    for value, score in LEVEL_SCORES.items():
        base = F.when(level == value, score).otherwise(base)
    return F.least(F.lit(1.0), base * F.least(F.lit(1.0), cc / 5))


def no_avatar(avatar: Column) -> Column:
    return (F.coalesce(avatar, F.lit("")) == "") | F.lower(avatar).contains(NO_AVATAR)


def avatar_verify(avatar: Column, verify_type: Column, has_profile: Column) -> Column:
    missing = F.when(no_avatar(avatar), 0.5).otherwise(0.0) + F.when(F.coalesce(verify_type, F.lit(-1)) == -1, 0.5).otherwise(0.0)
    return F.when(has_profile, missing).otherwise(0.3)


def skeleton_hits(avatar: Column, name: Column, post_count: Column, n_posts: Column, upload_count: Column, sign: Column) -> Column:
    """How many of five marks an empty account shows; an unknown number of uploads is no mark."""
    marks = [
        no_avatar(avatar),
        garbled_name(name),
        F.coalesce(post_count, n_posts, F.lit(0)) == 0,
        F.coalesce(upload_count, F.lit(-1)) == 0,
        F.coalesce(sign == DEFAULT_SIGN, F.lit(False)),
    ]
    return sum((m.cast("int") for m in marks), F.lit(0))


def refreshed_skeleton_hits(avatar: Column, name: Column, post_count: Column, upload_count: Column, sign: Column) -> Column:
    """The marks as a fresh profile shows them: only untouched default names count, unknown posts are no mark."""
    default_name = (F.coalesce(name, F.lit("")) == "") | (name.startswith("bili_") & (F.length(name) > 8))
    marks = [no_avatar(avatar), default_name, F.coalesce(post_count, F.lit(-1)) == 0, F.coalesce(upload_count, F.lit(-1)) == 0, F.coalesce(sign == DEFAULT_SIGN, F.lit(False))]
    return sum((m.cast("int") for m in marks), F.lit(0))


def signature_score(sign: Column, has_profile: Column, direct: list[str], defensive: list[str], provoking: list[str]) -> Column:
    """Distinct terms of three lexicons in a signature: one or several direct .25/.50, defensive .15/.30, provoking .10/.20."""
    total = F.lit(0)
    for terms, one, more in ((direct, 25, 50), (defensive, 15, 30), (provoking, 10, 20)):
        n = distinct_hits(sign, terms)
        total = total + F.when(n >= 2, more).when(n == 1, one).otherwise(0)
    empty = (F.coalesce(sign, F.lit("")) == "") | (sign == DEFAULT_SIGN)
    return F.when(~has_profile, 0.0).when(empty, 0.05).when(F.length(F.trim(sign)) < 5, 0.10).otherwise(F.least(F.lit(1.0), total / 100))


#: Rows that a task aggregates or joins at once where nearly each has a key of its own.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The rows by keys, dealt to so many tasks that the memory of one does not grow with their number (``most``, or fewer)."""
    n_tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_ROWS))
    return rows.repartition(n_tasks, *keys)


def comment_stats(comments: DataFrame, n_comments: int | None = None) -> DataFrame:
    """Per content and user: number of comments, mean likes, and the like count of the first comment. Few users comment twice on a
    content, so comments are dealt before they are aggregated: a table of those of one file would be nearly as long as they are."""
    rows = dealt(comments, comments.count() if n_comments is None else n_comments, "content_id", "user_id")
    return rows.groupBy("content_id", "user_id").agg(
        F.count("*").alias("cc"), F.avg("like_count").alias("avg_like"), F.min_by("like_count", "seq").alias("first_like")
    )


def comment_stats_of(comments: DataFrame, users: DataFrame) -> DataFrame:
    """``comment_stats`` with the columns of ``users``, null where there is no such user."""
    n_comments = comments.count()
    return dealt(comment_stats(comments, n_comments), n_comments, "user_id").join(users, "user_id", "left")


def like_ratio(avg_like: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - avg_like / 10)


def lexicon_flags(positive: list[str], negative: list[str], hard: list[str], soft: list[str]) -> list[Column]:
    """What a comment's text holds, in columns without the text."""
    text, long = F.col("text"), F.coalesce(F.length("text") >= 3, F.lit(False))
    flags = {"is_long": long, "is_positive": long & any_hit(text, positive), "is_negative": long & any_hit(text, negative), "is_hard": any_hit(text, hard), "is_soft": any_hit(text, soft)}
    return [flag.alias(name) for name, flag in flags.items()]


def lexicon_counts() -> list[Column]:
    """Aggregates of ``lexicon_flags`` that ``sentiment_score`` and ``spam_score`` read."""
    counts = [F.count_if(F.col(flag)).alias(name) for flag, name in (("is_long", "n_long"), ("is_positive", "n_positive"), ("is_negative", "n_negative"), ("is_soft", "n_soft"))]
    return [*counts, F.max("is_hard").alias("is_hard"), F.count("*").alias("cc")]


def sentiment_score() -> Column:
    share = F.greatest("n_positive", "n_negative") / F.col("n_long")
    return F.when(F.col("n_long") < 3, 0.0).otherwise(F.greatest(F.lit(0.0), (share - 0.5) * 2))


def spam_score() -> Column:
    share = F.col("n_soft") / F.col("cc")
    return F.when(F.col("is_hard"), 1.0).when(F.col("n_soft") == 0, 0.0).when(share >= 0.5, 0.9).when(F.col("n_soft") >= 3, 0.85).when(F.col("n_soft") == 2, 0.7).otherwise(0.5)


def sentiment_extreme(comments: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """How one-sided a user's comments of three characters or more are; 0 below three of them."""
    flagged = comments.select("content_id", "user_id", *lexicon_flags(positive, negative, [], [])).filter("is_long")
    counts = flagged.groupBy("content_id", "user_id").agg(*lexicon_counts())
    return counts.select("content_id", "user_id", sentiment_score().alias("f7"))


def post_lexicon(posts: DataFrame, terms: list[str]) -> DataFrame:
    """1 for a user with a post that holds a term."""
    return posts.groupBy("user_id").agg(F.max(any_hit(F.col("text"), terms).cast("int")).cast("double").alias("f14"))


def spam_lexicon(comments: DataFrame, hard: list[str], soft: list[str]) -> DataFrame:
    """1 with a hard term; else by the number and share of comments with soft terms."""
    counts = comments.select("content_id", "user_id", *lexicon_flags([], [], hard, soft)).groupBy("content_id", "user_id").agg(*lexicon_counts())
    return counts.select("content_id", "user_id", spam_score().alias("f15"))


def refreshed(report: DataFrame, profiles: DataFrame) -> DataFrame:
    """Report rows (user_id, f4, f12, ...) whose user has a profile with that profile's features; others keep theirs.
    ``verify`` is JSON text whose ``type`` is the verify state, -1 where it cannot be read."""
    verify = F.coalesce(F.get_json_object("verify", "$.type").try_cast("int"), F.lit(-1))
    hits = refreshed_skeleton_hits(F.lower("avatar"), F.col("name"), F.col("post_count"), F.col("upload_count"), F.col("sign"))
    new = profiles.select("user_id", (hits / 5).alias("new_f12"), avatar_verify(F.col("avatar"), verify, F.lit(True)).alias("new_f4"))
    rows = report.join(new, "user_id", "left")
    return rows.withColumns({f: F.coalesce(f"new_{f}", f) for f in ("f4", "f12")}).drop("new_f4", "new_f12")

"""The analysis of all contents in one job: comments to scored users, with a report for each content."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.functions.text import any_hit
from tidewatch.operators import features, scoring, similarity, timeseries
from tidewatch.sources.storage import written


@dataclass(frozen=True)
class Lexicons:
    """Term lists that the user supplies; empty ones hit nothing."""

    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    posts: list[str] = field(default_factory=list)
    spam_hard: list[str] = field(default_factory=list)
    spam_soft: list[str] = field(default_factory=list)
    sign_direct: list[str] = field(default_factory=list)
    sign_defensive: list[str] = field(default_factory=list)
    sign_provoking: list[str] = field(default_factory=list)


def user_features(comments: DataFrame, users: DataFrame, posts: DataFrame, lexicons: Lexicons, as_of: str, members: DataFrame | None = None, burst_width_s: int = 600) -> DataFrame:
    """One row for each content and user with the thirteen features; without ``members`` (clusters) f5 is 0."""
    keys = ["content_id", "user_id"]
    # One aggregation of the comments, without their texts, gives all that needs no other table.
    flags = features.lexicon_flags(lexicons.positive, lexicons.negative, lexicons.spam_hard, lexicons.spam_soft)
    gaps, gap_sums = timeseries.gap_statistics(comments.select(*keys, "created_at", "like_count", *flags))
    stats = gaps.groupBy(*keys).agg(*features.lexicon_counts(), *gap_sums, F.avg("like_count").alias("avg_like"))
    stats = stats.select(*keys, "cc", "avg_like", features.sentiment_score().alias("f7"), features.spam_score().alias("f15"), timeseries.regularity_score(timeseries.variation()).alias("f16"))
    by_post = posts.groupBy("user_id").agg(F.count("*").alias("n_posts"), F.max(any_hit(F.col("text"), lexicons.posts).cast("int")).cast("double").alias("f14"))
    rows = stats.join(users.withColumn("profile_present", F.lit(True)), "user_id", "left").join(by_post, "user_id", "left")
    has = F.coalesce("profile_present", F.lit(False))
    rows = rows.select(
        *keys,
        "cc",
        has.alias("profile_present"),
        features.account_age(F.col("registered_raw"), F.col("user_id"), F.col("level"), F.col("cc"), as_of).alias("f1"),
        features.follow_ratio(F.col("follower"), F.col("following"), has).alias("f2"),
        features.level_score(F.coalesce("level", F.lit(3)), F.col("cc")).alias("f3"),
        features.avatar_verify(F.col("avatar"), F.col("verify_type"), has).alias("f4"),
        "f7",
        features.like_ratio(F.col("avg_like")).alias("f8"),
        (features.skeleton_hits(F.col("avatar"), F.col("name"), F.col("post_count"), F.coalesce("n_posts", F.lit(0)), F.col("upload_count"), F.col("sign")) / 5).alias("f12"),
        features.signature_score(F.col("sign"), has, lexicons.sign_direct, lexicons.sign_defensive, lexicons.sign_provoking).alias("f18"),
        "f14",
        "f15",
        "f16",
    )
    f5 = similarity.participation(comments, members) if members is not None else stats.select(*keys, F.lit(0.0).alias("f5"))
    f6 = timeseries.burst_scores(comments, burst_width_s).withColumnRenamed("score", "f6")
    rows = rows.join(f5, keys, "left").join(f6, keys, "left")
    return rows.select(*keys, "cc", "profile_present", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in scoring.WEIGHTS])


def summary_text(stats: DataFrame) -> DataFrame:
    """A sentence for each content."""
    share = lambda c: F.format_string("%.1f", F.round(F.col(c) / F.col("total_users") * 100, 1))
    text = F.concat(
        F.col("total_users").cast("string"), F.lit(" users commented. "),
        F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" are high risk ("), share("high"), F.lit("%), "), F.col("medium").cast("string"), F.lit(" medium ("), share("medium"), F.lit("%). "))).otherwise(""),
        F.when(F.col("n_clusters") > 0, F.concat(F.col("n_clusters").cast("string"), F.lit(" groups of near-equal comments."))).otherwise(""),
    )
    return stats.withColumn("summary", F.trim(text))


def observed(rows: DataFrame, counted: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and the metrics that the first action on them gives."""
    metrics = Observation()
    return rows.observe(metrics, *[c.alias(name) for name, c in counted.items()]), metrics


def verdict_sentences(rows: DataFrame) -> DataFrame:
    """A sentence for each content on its users' verdicts (content_id, type_id)."""
    kinds = rows.filter("type_id IS NOT NULL").groupBy("content_id", "type_id").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("type_id") > 0, F.struct(-F.col("n"), F.col("type_id").alias("type_id"), F.col("n").alias("n")))))
    sums = kinds.groupBy("content_id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("type_id") > 0, F.col("n"))), F.lit(0)).alias("found"), listed.alias("kinds"))
    names = F.array_join(F.transform("kinds", lambda k: F.format_string("type %d %d", k["type_id"], k["n"])), ", ")
    return sums.withColumn("sentence", F.concat(F.format_string("%d users reviewed, %d confirmed.", "total", "found"), F.when(F.size("kinds") > 0, F.concat(F.lit(" By type: "), names, F.lit("."))).otherwise("")))


def report_documents(comments: DataFrame, users: DataFrame, posts: DataFrame, meta: DataFrame, lexicons: Lexicons, as_of: str, export_at: float = 70) -> DataFrame:
    """One row for each content: meta, statistics, summary, suspects, cluster details, timeline, and the users to export.
    ``meta`` has content_id and what is known of the content."""
    members = written(similarity.cluster_members(comments), "cluster-members")
    scored = written(scoring.with_scores(user_features(comments, users, posts, lexicons, as_of, members)), "scored-users")
    rows = analysed(members, scored)
    details = similarity.cluster_details(comments, members)
    detail = F.struct("cluster_rank", "member_rank", "cluster_id", "size", "comment_id", "user_id", "text")
    clusters = details.groupBy("content_id").agg(F.array_sort(F.collect_list(detail)).alias("clusters"))
    times = timeseries.timeline(comments).groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("bin_start", "n"))).alias("timeline"))
    export = scoring.ranked(scored, "content_id", "user_id").filter((F.col("score") >= export_at) & (F.col("rank") <= 500))
    export = export.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("rank", "user_id", "score"))).alias("export"))
    known = meta.select("content_id", F.struct(*[c for c in meta.columns if c != "content_id"]).alias("meta"))
    for part in (known, clusters, times, export):
        rows = rows.join(part, "content_id", "left")
    return rows


def analyze_all(comments: DataFrame, users: DataFrame, posts: DataFrame, lexicons: Lexicons, as_of: str) -> DataFrame:
    """A row for each content: statistics, summary, and its twenty highest users as structs (a top-k report)."""
    members = written(similarity.cluster_members(comments), "cluster-members")
    scored = written(scoring.with_scores(user_features(comments, users, posts, lexicons, as_of, members)), "scored-users")
    return analysed(members, scored)


def analysed(members: DataFrame, scored: DataFrame) -> DataFrame:
    """The analysis of each content from its cluster members and scored users."""
    stats = scoring.risk_statistics(scored, ["content_id"])
    clusters = members.groupBy("content_id").agg(F.countDistinct("cluster_id").alias("n_clusters"))
    best = scoring.ranked(scored, "content_id", "user_id").filter("rank <= 20")
    suspects = best.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("rank", "user_id", "score", "risk", "signals"))).alias("suspects"))
    joined = stats.join(clusters, "content_id", "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0))).join(suspects, "content_id", "left")
    return summary_text(joined)

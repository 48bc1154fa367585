"""Properties of the core operators: ranges, sums, empty inputs, plans."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features, scoring, timeseries
from tidewatch.plans import analysis, flagship
from tidewatch.sources import adapters as A
from tidewatch.sources.files import read_rows, write_rows
from tidewatch.sources.storage import shared_dir

SF_DIR = "/root/testdata/sf0.001"


def test_features_lie_between_0_and_1(spark):
    rows = analysis.user_features(spark, SF_DIR)
    limits = rows.agg(*[F.min(f).alias(f"low_{f}") for f in scoring.WEIGHTS], *[F.max(f).alias(f"high_{f}") for f in scoring.WEIGHTS]).first().asDict()
    assert all(0 <= v <= 1 for v in limits.values())


def test_buckets_add_up(spark):
    rows = A.scored_users(spark, SF_DIR)
    assert scoring.score_distribution(rows, "content_id").agg(F.sum("n")).first()[0] == rows.count()


def test_nothing_in_nothing_out(spark):
    comments, users, posts = analysis.with_times(spark, SF_DIR).limit(0), A.users(spark, SF_DIR), A.posts(spark, SF_DIR).limit(0)
    assert flagship.analyze_all(comments, users, posts, analysis.LEXICONS, analysis.AS_OF).count() == 0
    assert timeseries.burst_scores(comments).count() == timeseries.timeline(comments).count() == 0


def test_plan_without_products(spark):
    plan = analysis.user_features(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("form", ["parquet", "json", "csv", "orc"])
def test_formats(spark, form):
    rows = A.users(spark, SF_DIR).select("user_id", "name", "level")
    path = shared_dir(spark, f"rows-{form}")
    write_rows(rows, path, form)
    assert sorted(map(tuple, read_rows(spark, path, form, "user_id long, name string, level int").collect())) == sorted(map(tuple, rows.collect()))


def test_named_stores(spark, tmp_path):
    from tidewatch.sources import files

    files.register_store("by_user", "json", ["user_id"], timestampFormat="yyyy")
    rows = spark.range(6).selectExpr("id", "id % 2 AS user_id")
    for store in ("parquet", "csv", "by_user"):
        files.save_to(store, rows, f"{tmp_path}/{store}")
        back = files.load_from(spark, store, f"{tmp_path}/{store}", "id long, user_id long")
        assert sorted(map(tuple, back.select("id", "user_id").collect())) == [(i, i % 2) for i in range(6)]


def test_all_features_are_the_single_ones(spark):
    """One aggregation gives what the functions for single features give, and the report counts these users."""
    from tidewatch.operators import features

    sf_dir = "/root/testdata/sf0.001"
    comments, lexicons = analysis.with_times(spark, sf_dir), analysis.LEXICONS
    rows = {(r["content_id"], r["user_id"]): r.asDict() for r in analysis.all_features(spark, sf_dir).collect()}
    parts = {
        "f6": timeseries.burst_scores(comments).withColumnRenamed("score", "f6"),
        "f7": features.sentiment_extreme(comments, lexicons.positive, lexicons.negative),
        "f15": features.spam_lexicon(comments, lexicons.spam_hard, lexicons.spam_soft),
        "f16": timeseries.time_regularity(comments),
        "f8": features.comment_stats(comments).select("content_id", "user_id", features.like_ratio(F.col("avg_like")).alias("f8")),
    }
    for name, part in parts.items():
        single = {(r["content_id"], r["user_id"]): r[name] for r in part.collect()}
        assert single.keys() <= rows.keys()
        assert all(row[name] == pytest.approx(single.get(key) or 0.0, abs=1e-9) for key, row in rows.items())
    posts = {r["user_id"]: r["f14"] for r in features.post_lexicon(A.posts(spark, sf_dir), lexicons.posts).collect()}
    assert all(row["f14"] == posts.get(user, 0.0) for (_, user), row in rows.items())
    scores = {key: r["score"] for r in scoring.with_scores(analysis.all_features(spark, sf_dir)).collect() if (key := (r["content_id"], r["user_id"]))}
    for report in analysis.analyze_all(spark, sf_dir).collect():
        own = {u: s for (c, u), s in scores.items() if c == report["content_id"]}
        assert report["total_users"] == len(own) and report["high"] + report["medium"] + report["low"] == len(own)
        assert [x["rank"] for x in report["suspects"]] == list(range(1, min(20, len(own)) + 1)) and {x["user_id"] for x in report["suspects"]} <= own.keys()


def test_no_task_holds_many_of_the_users_of_contents(spark, monkeypatch):
    """Rows of nearly as many keys as rows are dealt to more tasks the more there are; copies and unknown users change nothing."""
    monkeypatch.setattr(features, "TASK_ROWS", 100, raising=False)
    comments = spark.range(4_000).select((F.col("id") % 1_000).alias("content_id"), (F.col("id") % 2_000 % 601).alias("user_id"), (F.col("id") % 7).alias("like_count"), F.col("id").alias("seq"))
    users = spark.range(500).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("level"))
    held = lambda rows: [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    stats = features.comment_stats(comments)
    assert sum(held(stats)) == 2_000 and max(held(stats)) < 200
    joined = features.comment_stats_of(comments, users)
    assert sum(held(joined)) == 2_000 and max(held(joined)) < 200
    assert joined.filter("level IS NULL").count() == sum(c % 601 >= 500 for c in range(2_000))
    wanted = {(c % 1_000, c % 601): (2, (c % 7 + (c + 2_000) % 7) / 2, c % 7) for c in range(2_000)}
    assert {(r["content_id"], r["user_id"]): (r["cc"], r["avg_like"], r["first_like"]) for r in stats.collect()} == wanted

"""Registered queries: dedup, set operations, joins, aggregates, paging over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import features, keyed, scoring
from tidewatch.plans.registered import COMMENTS, CONTENTS, POSTS, SEQ, SEQ_DESC, TEXTS, THREADS, TIMED, USERS, VERDICTS, query
from tidewatch.sources import adapters as A
from tidewatch.sources import files
from tidewatch.sources.storage import shared_dir

KEPT = ["comment_id", "content_id", "user_id", "like_count", "reply_count"]


@query(f"WITH {COMMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ}) AS k FROM comments) SELECT {', '.join(KEPT)} FROM r WHERE k = 1")
def dedup_first(spark, sf_dir):
    return keyed.first_by_key(A.comments_rel(spark, sf_dir), ["comment_id"]).select(*KEPT)


@query(f"WITH {COMMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ_DESC}) AS k FROM comments) SELECT {', '.join(KEPT)} FROM r WHERE k = 1")
def upsert_latest(spark, sf_dir):
    return keyed.latest_by_key(A.comments_rel(spark, sf_dir), ["comment_id"]).select(*KEPT)


@query(f"""WITH {COMMENTS}, old AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ_DESC}) AS k FROM comments WHERE reply_count < 4),
new AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ_DESC}) AS k FROM comments WHERE reply_count >= 4)
SELECT {', '.join(KEPT)} FROM new WHERE k = 1 UNION ALL SELECT {', '.join(KEPT)} FROM old WHERE k = 1 AND comment_id NOT IN (SELECT comment_id FROM new)""")
def upsert_comments(spark, sf_dir):
    rows = A.comments_rel(spark, sf_dir)
    old = keyed.latest_by_key(rows.filter("reply_count < 4"), ["comment_id"])
    return keyed.upsert(old, rows.filter("reply_count >= 4"), ["comment_id"]).select(*KEPT)


@query(f"""WITH {COMMENTS}, old AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ}) AS k FROM comments WHERE reply_count < 4),
new AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY {SEQ}) AS k FROM comments WHERE reply_count >= 4)
SELECT {', '.join(KEPT)} FROM old WHERE k = 1 UNION ALL SELECT {', '.join(KEPT)} FROM new WHERE k = 1 AND comment_id NOT IN (SELECT comment_id FROM old)""")
def append_new_only(spark, sf_dir):
    rows = A.comments_rel(spark, sf_dir)
    old = keyed.first_by_key(rows.filter("reply_count < 4"), ["comment_id"])
    return keyed.append_new_only(old, rows.filter("reply_count >= 4"), ["comment_id"]).select(*KEPT)


@query(f"WITH {CONTENTS} SELECT owner_id, content_id, row_number() OVER (PARTITION BY owner_id ORDER BY published_at DESC, content_id) AS place FROM (SELECT DISTINCT owner_id, content_id, published_at FROM contents)")
def creator_listing(spark, sf_dir):
    rows = A.contents(spark, sf_dir).dropDuplicates(["owner_id", "content_id"])
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("published_at"), "content_id"))
    return rows.select("owner_id", "content_id", place.cast("long").alias("place"))


@query(f"WITH {CONTENTS}, gone AS (SELECT content_id FROM contents WHERE source = '5-LOW') SELECT 'contents' AS tbl, count(*) AS deleted FROM gone UNION ALL SELECT 'comments', count(*) FROM lineitem WHERE l_orderkey IN (SELECT content_id FROM gone)")
def purge_by_category(spark, sf_dir):
    contents, comments = A.contents(spark, sf_dir), A.comments_rel(spark, sf_dir)
    gone = contents.filter("source = '5-LOW'").select("content_id")
    left = {"contents": (contents, keyed.purge(contents, F.col("source") == "5-LOW")), "comments": (comments, comments.join(gone, "content_id", "left_anti"))}
    counts = [before.agg(F.lit(name).alias("tbl"), (F.count("*") - after.agg(F.count("*").alias("kept")).scalar()).alias("deleted")) for name, (before, after) in left.items()]
    return counts[0].union(counts[1])


@query(f"WITH {COMMENTS} SELECT DISTINCT user_id FROM comments ORDER BY user_id")
def distinct_users(spark, sf_dir):
    return A.comments_rel(spark, sf_dir).select("user_id").distinct().orderBy("user_id")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def pending_users(spark, sf_dir):
    orders = A.contents(spark, sf_dir).withColumnRenamed("owner_id", "user_id")
    return keyed.pending(A.users(spark, sf_dir), orders.filter("status = 'F'"), orders.filter("status = 'O'"), "user_id")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS u FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT DISTINCT o_custkey AS u FROM orders WHERE o_orderstatus = 'O'),
m AS (SELECT c_custkey IN (SELECT u FROM d) AS done, c_custkey IN (SELECT u FROM q) AS queued FROM customer)
SELECT count(*) FILTER (NOT done AND NOT queued) AS pending, count(*) FILTER (done) AS skipped_done, count(*) FILTER (queued) AS skipped_queued FROM m""")
def pending_user_counts(spark, sf_dir):
    orders = A.contents(spark, sf_dir).withColumnRenamed("owner_id", "user_id")
    return keyed.pending_counts(A.users(spark, sf_dir), orders.filter("status = 'F'"), orders.filter("status = 'O'"), "user_id")


@query(f"WITH {TEXTS}, {POSTS} SELECT DISTINCT user_id FROM texts WHERE user_id NOT IN (SELECT user_id FROM posts WHERE is_repost AND length(text) > 5000)")
def pending_posts(spark, sf_dir):
    done = A.posts(spark, sf_dir).filter("is_repost AND length(text) > 5000").select("user_id")
    return A.comments_text(spark, sf_dir).select("user_id").distinct().join(done, "user_id", "left_anti")


@query("""SELECT o_orderkey AS content_id, coalesce(n, 0) AS n_comments, o_orderstatus = 'F' AS has_report, false AS placeholder FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT l_orderkey, count(*), false, true FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2004-01-01' - INTERVAL 300 SECOND""")
def list_contents(spark, sf_dir):
    """Contents with comment counts and reports; contents known by comments alone follow once they are five minutes old."""
    known = A.contents(spark, sf_dir).filter("source <> '5-LOW'")
    counts = A.comments_rel(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("n_comments"), F.max("created_at").alias("newest"))
    listed = known.join(counts, "content_id", "left").select("content_id", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), (F.col("status") == "F").alias("has_report"), F.lit(False).alias("placeholder"))
    settled = F.col("newest") < F.to_timestamp(F.lit("2004-01-01")) - F.expr("INTERVAL 300 SECONDS")
    alone = counts.join(known, "content_id", "left_anti").filter(settled).select("content_id", "n_comments", F.lit(False).alias("has_report"), F.lit(True).alias("placeholder"))
    return listed.unionByName(alone)


@query(f"WITH {COMMENTS}, {USERS} SELECT comment_id, c.user_id, coalesce(follower, 0) AS follower, coalesce(level, 0) AS level, u.user_id IS NOT NULL AS profile_present, count(*) AS copies FROM comments c LEFT JOIN (SELECT * FROM users WHERE user_id % 10 <> 0) u ON c.user_id = u.user_id GROUP BY ALL")
def comments_with_profile(spark, sf_dir):
    users = A.users(spark, sf_dir).filter("user_id % 10 <> 0").select("user_id", "follower", "level", F.lit(True).alias("profile_present"))
    rows = A.comments_rel(spark, sf_dir).join(users, "user_id", "left")
    keys = ["comment_id", "user_id", F.coalesce("follower", F.lit(0)).alias("follower"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("profile_present", F.lit(False)).alias("profile_present")]
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"))


@query(f"WITH {THREADS} SELECT a.comment_id, a.user_name, p.user_name AS parent_name FROM threads a LEFT JOIN threads p ON a.parent_id = p.comment_id AND a.parent_id <> 0")
def reply_parent_name(spark, sf_dir):
    rows = A.threads(spark, sf_dir)
    parents = rows.select(F.col("comment_id").alias("parent_id"), F.col("user_name").alias("parent_name"))
    return rows.join(parents, "parent_id", "left").select("comment_id", "user_name", "parent_name")


@query(f"WITH {COMMENTS}, {CONTENTS} SELECT content_id, count(*) AS n FROM comments WHERE content_id NOT IN (SELECT content_id FROM contents WHERE source <> '1-URGENT') GROUP BY 1")
def orphan_comments(spark, sf_dir):
    known = A.contents(spark, sf_dir).filter("source <> '1-URGENT'")
    return A.comments_rel(spark, sf_dir).join(known, "content_id", "left_anti").groupBy("content_id").agg(F.count("*").alias("n"))


@query(f"WITH {COMMENTS}, {CONTENTS} SELECT content_id, view_count FROM contents WHERE view_count > 0 AND content_id NOT IN (SELECT content_id FROM comments)")
def pending_contents(spark, sf_dir):
    return A.contents(spark, sf_dir).filter("view_count > 0").join(A.comments_rel(spark, sf_dir), "content_id", "left_anti").select("content_id", "view_count")


@query(f"WITH {COMMENTS}, {CONTENTS}, m AS (SELECT view_count, content_id IN (SELECT content_id FROM comments) AS has FROM contents) SELECT count(*) FILTER (NOT has AND view_count >= 100000) AS injected, count(*) FILTER (has) AS skipped_collected, count(*) FILTER (NOT has AND view_count < 100000) AS skipped_small FROM m")
def pending_content_counts(spark, sf_dir):
    seen = A.comments_rel(spark, sf_dir).select("content_id").distinct().withColumn("has", F.lit(1))
    rows = A.contents(spark, sf_dir).join(seen, "content_id", "left")
    has, small = F.col("has").isNotNull(), F.col("view_count") < 100_000
    return rows.agg(F.count_if(~has & ~small).alias("injected"), F.count_if(has).alias("skipped_collected"), F.count_if(~has & small).alias("skipped_small"))


@query(f"WITH {COMMENTS} SELECT content_id, user_id, count(*) AS cc, arg_min(like_count, {{'a': created_at, 'b': l_partkey, 'c': user_id, 'd': l_extendedprice}}) AS first_like, round(avg(like_count), 6) AS avg_like FROM comments GROUP BY 1, 2")
def user_comment_stats(spark, sf_dir):
    return features.comment_stats(A.comments_rel(spark, sf_dir)).withColumn("avg_like", F.round("avg_like", 6))


@query(f"WITH {TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY content_id, user_id ORDER BY comment_id) AS rank FROM texts) SELECT content_id, user_id, rank, comment_id, left(text, 80) AS sample FROM r WHERE rank <= 3")
def sample_comments(spark, sf_dir):
    return keyed.first_n(A.comments_text(spark, sf_dir), ["content_id", "user_id"], 3, F.col("seq")).select("content_id", "user_id", F.col("rank").cast("long").alias("rank"), "comment_id", F.substring("text", 1, 80).alias("sample"))


@query(f"WITH {CONTENTS} SELECT owner_id, count(*) AS n_contents, round(sum(view_count), 2) AS views FROM contents GROUP BY 1 ORDER BY 2 DESC, 1")
def owner_groups(spark, sf_dir):
    return A.contents(spark, sf_dir).groupBy("owner_id").agg(F.count("*").alias("n_contents"), F.round(F.sum("view_count"), 2).alias("views")).orderBy(F.desc("n_contents"), "owner_id")


@query("SELECT 'contents' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'comments', count(*) FROM lineitem UNION ALL SELECT 'users', count(*) FROM customer UNION ALL SELECT 'reports', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'overlays', count(*) FROM events")
def dataset_totals(spark, sf_dir):
    contents = A.contents(spark, sf_dir)
    parts = {"contents": contents, "comments": A.comments_rel(spark, sf_dir), "users": A.users(spark, sf_dir), "reports": contents.filter("status = 'F'"), "overlays": A.comments_time(spark, sf_dir)}
    rows = [rows.agg(F.lit(name).alias("entity"), F.count("*").alias("n")) for name, rows in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


@query(f"WITH {VERDICTS} SELECT type_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM verdicts GROUP BY 1 ORDER BY 2 DESC, 1")
def verdict_type_counts(spark, sf_dir):
    return A.verdicts(spark, sf_dir).groupBy("type_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")).orderBy(F.desc("n"), "type_id")


@query(f"WITH {COMMENTS} SELECT content_id, count(*) AS n FROM comments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_contents(spark, sf_dir):
    return A.comments_rel(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "content_id").limit(20)


@query(f"WITH {COMMENTS}, {CONTENTS} SELECT content_id, count(user_id) AS n, CASE WHEN status = 'F' THEN 'analysed' ELSE 'waiting' END AS state FROM contents LEFT JOIN comments USING (content_id) GROUP BY 1, 3")
def content_status(spark, sf_dir):
    counts = A.comments_rel(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("n"))
    return A.contents(spark, sf_dir).join(counts, "content_id", "left").select("content_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("status") == "F", "analysed").otherwise("waiting").alias("state"))


@query(f"WITH {COMMENTS} SELECT content_id, count(*) AS collected, sum(like_count) AS declared, round(count(*) / sum(like_count), 6) AS coverage, count(*) / sum(like_count) < 0.3 AS low FROM comments GROUP BY 1")
def collection_coverage(spark, sf_dir):
    rows = A.comments_rel(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("collected"), F.sum("like_count").alias("declared"))
    return keyed.coverage(rows).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {COMMENTS} SELECT CASE WHEN reply_count = 0 THEN -404 WHEN reply_count < 3 THEN -412 ELSE 12002 END AS code, count(*) AS n, count(DISTINCT content_id) AS n_contents FROM comments WHERE reply_count <> 5 GROUP BY 1")
def failure_codes(spark, sf_dir):
    """How often each code stands for a failed request; a code of 0 is none."""
    code = F.when(F.col("reply_count") == 0, -404).when(F.col("reply_count") < 3, -412).when(F.col("reply_count") == 5, 0).otherwise(12002)
    return keyed.failure_codes(A.comments_rel(spark, sf_dir).withColumn("code", code))


@query(f"WITH {TEXTS}, {POSTS} SELECT user_id, count(*) FILTER (is_repost) AS reposts, count(*) AS n_posts FROM posts GROUP BY 1")
def repost_counts(spark, sf_dir):
    return A.posts(spark, sf_dir).groupBy("user_id").agg(F.count_if("is_repost").alias("reposts"), F.count("*").alias("n_posts"))


@query(f"WITH {CONTENTS} SELECT content_id, (SELECT count(*) FROM contents) AS total, (SELECT greatest(1, CAST(ceil(count(*) / 50) AS BIGINT)) FROM contents) AS total_pages FROM contents ORDER BY content_id DESC LIMIT 50 OFFSET 50")
def contents_page(spark, sf_dir):
    return keyed.page(A.contents(spark, sf_dir), [F.desc("content_id")], 2, 50).select("content_id", "total", "total_pages")


@query("SELECT event_id AS comment_id, event_type AS content_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY event_id LIMIT 50")
def overlays_page(spark, sf_dir):
    return keyed.page(A.comments_time(spark, sf_dir), [F.col("seq")], 1, 50).select("comment_id", "content_id", "total")


@query(f"WITH {THREADS}, pg AS (SELECT comment_id FROM threads WHERE root_id = 0 ORDER BY comment_id DESC LIMIT 20 OFFSET 20) SELECT p.comment_id AS root, count(t.comment_id) AS n_replies, coalesce(string_agg(CAST(t.comment_id AS VARCHAR) || ' ' || t.user_name, ',' ORDER BY t.seq), '') AS replies, (SELECT count(*) FROM threads WHERE root_id = 0) AS total FROM pg p LEFT JOIN threads t ON t.root_id = p.comment_id GROUP BY 1")
def comment_tree(spark, sf_dir):
    """The second page of roots, newest first, each with its replies in order."""
    tree = keyed.comment_tree(A.threads(spark, sf_dir), 2, 20)
    said = F.array_join(F.transform("replies", lambda x: F.concat_ws(" ", x["comment_id"].cast("string"), x["user_name"])), ",")
    return tree.select(F.col("comment_id").alias("root"), F.coalesce(F.size("replies"), F.lit(0)).cast("long").alias("n_replies"), F.coalesce(said, F.lit("")).alias("replies"), "total")


@query(f"WITH {COMMENTS} SELECT comment_id, user_id, like_count FROM comments WHERE content_id = 42 ORDER BY created_at DESC, comment_id, user_id, like_count LIMIT 10")
def recent_comments(spark, sf_dir):
    return A.comments_rel(spark, sf_dir).filter("content_id = 42").orderBy(F.desc("created_at"), "comment_id", "user_id", "like_count").limit(10).select("comment_id", "user_id", "like_count")


@query(f"WITH {COMMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY {SEQ}, comment_id) AS k FROM comments) SELECT content_id, count(*) AS kept FROM r WHERE k <= 5 GROUP BY 1")
def cap_per_content(spark, sf_dir):
    """The cap is the feature: a collection keeps the first comments of each content (here five)."""
    return keyed.first_n(A.comments_rel(spark, sf_dir), ["content_id"], 5, F.col("seq"), F.col("comment_id")).groupBy("content_id").agg(F.count("*").alias("kept"))


@query(f"WITH {TEXTS}, {POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id) AS k FROM posts) SELECT user_id, post_id FROM r WHERE k <= 50")
def cap_posts(spark, sf_dir):
    return keyed.first_n(A.posts(spark, sf_dir), ["user_id"], 50, F.col("seq")).select("user_id", "post_id")


@query(f"WITH {CONTENTS} SELECT content_id, source, owner_id FROM contents WHERE source = '2-HIGH' AND owner_id < 500 AND status = 'F'")
def contents_filtered(spark, sf_dir):
    return A.contents(spark, sf_dir).filter("source = '2-HIGH' AND owner_id < 500 AND status = 'F'").select("content_id", "source", "owner_id")


@query("SELECT count(*) FILTER (id <= 10000000000) AS valid, count(*) FILTER (id > 10000000000) AS skipped FROM (SELECT c_custkey * 10000000 AS id FROM customer)")
def valid_user_ids(spark, sf_dir):
    rows = A.users(spark, sf_dir).select((F.col("user_id") * 10_000_000).alias("id"))
    return rows.agg(F.count_if(F.col("id") <= 10_000_000_000).alias("valid"), F.count_if(F.col("id") > 10_000_000_000).alias("skipped"))


@query("SELECT event_id AS seq, '[' || event_type || '] user ' || user_id AS line FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, sf_dir):
    from tidewatch.sources.files import log_tail as tail

    lines = A.comments_time(spark, sf_dir).select("seq", F.concat(F.lit("["), "content_id", F.lit("] user "), F.col("user_id").cast("string")).alias("line"))
    return tail(lines, "[error]", 100)


@query(f"""WITH {COMMENTS}, {USERS}, s AS (SELECT content_id, user_id, count(*) AS cc, avg(like_count) AS al FROM comments GROUP BY 1, 2),
f AS (SELECT content_id, s.user_id, greatest(0, 1 - al / 10) AS f8, least(1, CASE coalesce(level, 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 WHEN 4 THEN 0.1 ELSE 0.0 END * least(1, cc / 5)) AS f3 FROM s LEFT JOIN users u USING (user_id)),
t AS (SELECT content_id, round(100 * (0.5 * f3 + 0.5 * f8), 1) AS score FROM f)
SELECT content_id, count(*) AS total_users, count(*) FILTER (score >= 60) AS high, count(*) FILTER (score >= 30 AND score < 60) AS medium, count(*) FILTER (score < 30) AS low, round(avg(score), 1) AS avg_score FROM t GROUP BY 1""")
def risk_statistics(spark, sf_dir):
    stats = features.comment_stats_of(A.comments_rel(spark, sf_dir), A.users(spark, sf_dir).select("user_id", "level"))
    f3, f8 = features.level_score(F.coalesce("level", F.lit(3)), F.col("cc")), features.like_ratio(F.col("avg_like"))
    return scoring.risk_statistics(stats.withColumn("score", F.round(100 * (0.5 * f3 + 0.5 * f8), 1)), ["content_id"])


@query("SELECT count(*) FILTER (n_chars % 1001 / 10 >= 60) AS total_high_risk, count(DISTINCT lang) AS reports FROM documents")
def total_high_risk(spark, sf_dir):
    return A.scored_users(spark, sf_dir).agg(F.count_if(F.col("score") >= scoring.HIGH).alias("total_high_risk"), F.countDistinct("content_id").alias("reports"))


@query(f"""WITH {TIMED}, {USERS}, c AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, comment_id) AS k FROM timed WHERE user_id = 7)
SELECT c.user_id, 7.5 AS score, u.user_id IS NOT NULL AS profile_present, CAST(CASE WHEN registered_raw LIKE '20__-%' THEN left(registered_raw, 4) ELSE '{features.YEAR_BANDS[0][1]}' END AS INTEGER) AS year, count(*) AS n_comments, string_agg(CAST(comment_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS latest
FROM c LEFT JOIN users u USING (user_id) GROUP BY ALL""")
def user_detail(spark, sf_dir):
    """One user's report row, latest comments, profile flag and year of registration (from the id where none is known)."""
    comments = A.comments_time(spark, sf_dir)
    report = spark.range(1).select(F.lit(7).cast("long").alias("user_id"), F.lit(7.5).alias("score"))
    detail = keyed.user_detail(7, report, comments, A.users(spark, sf_dir))
    latest = F.array_join(F.transform("latest", lambda x: x["comment_id"].cast("string")), ",")
    return detail.select("user_id", "score", "profile_present", "year", "n_comments", latest.alias("latest"))


@query(f"WITH {CONTENTS} SELECT owner_id, content_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY published_at DESC, content_id) AS BIGINT) AS place FROM (SELECT DISTINCT owner_id, content_id, published_at FROM contents)")
def creator_listing_files(spark, sf_dir):
    """The listing written by owner bucket, rows in order within each file, and read back."""
    rows = A.contents(spark, sf_dir).dropDuplicates(["owner_id", "content_id"]).select("owner_id", "content_id", "published_at")
    path = shared_dir(spark, "creator-listing")
    files.write_bucketed(rows, path, "owner_id", 16, F.desc("published_at"), F.col("content_id"))
    back = files.read_bucketed(spark, path)
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("published_at"), "content_id"))
    return back.select("owner_id", "content_id", place.cast("long").alias("place"))


@query(f"WITH {COMMENTS} SELECT comment_id, content_id, user_id, like_count FROM comments WHERE content_id IN (7, 32, 99)")
def store_lookup(spark, sf_dir):
    """A typed table stored by content bucket; the lookup reads the buckets of its keys only."""
    path = shared_dir(spark, "comment-store")
    files.write_bucketed(A.comments_rel(spark, sf_dir).drop("seq"), path, "content_id", 32, F.col("created_at"))
    return files.lookup_bucketed(spark, path, "content_id", [7, 32, 99], 32).select("comment_id", "content_id", "user_id", "like_count")


@query(f"WITH {COMMENTS} SELECT 'user' AS found_by, comment_id, content_id, user_id, like_count FROM comments WHERE user_id = 7 UNION ALL SELECT 'id', comment_id, content_id, user_id, like_count FROM comments WHERE comment_id IN (11, 323, 999999999) UNION ALL SELECT 'time', comment_id, content_id, user_id, like_count FROM comments WHERE created_at >= DATE '1995-03-01' AND created_at < DATE '1995-03-08'")
def store_lookup_by_user(spark, sf_dir):
    """Lookups by columns that are not the store's key: by user, by comment id and by time."""
    path = shared_dir(spark, "indexed-comment-store")
    rows = A.comments_rel(spark, sf_dir).drop("seq")
    files.write_bucketed(rows, path, "content_id", 8, near=["user_id", "created_at"], bloom=("comment_id", "user_id"), block_bytes=1 << 20)
    lookups = {"user": F.col("user_id") == 7, "id": F.col("comment_id").isin(11, 323, 999_999_999), "time": (F.col("created_at") >= "1995-03-01") & (F.col("created_at") < "1995-03-08")}
    found = [files.lookup_indexed(spark, path, c).select(F.lit(name).alias("found_by"), "comment_id", "content_id", "user_id", "like_count") for name, c in lookups.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])

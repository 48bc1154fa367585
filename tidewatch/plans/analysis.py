"""Registered queries: texts, features, time series, clusters, scores, verdicts, reports, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import features, keyed, registry, scoring, similarity, timeseries
from tidewatch.plans import flagship
from tidewatch.plans.registered import COMMENTS, POSTS, SCORED, TEXTS, THREADS, TIMED, USERS, VERDICTS, query
from tidewatch.sources import adapters as A
from tidewatch.sources import files
from tidewatch.sources.storage import shared_dir

AS_OF = "2024-02-01"
#: Neutral terms of the test texts; real lists come from the user.
LEXICONS = flagship.Lexicons(
    positive=["thand", "free"], negative=["reon", "token"], posts=["tion", "token"], spam_hard=["example.com"], spam_soft=["ering", "license"],
    sign_direct=["MACH", "AUTO"], sign_defensive=["FURN", "BUILD"], sign_provoking=["HOUSE"],
)
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0]"


def terms(names: list[str], column: str = "text") -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in names) + ")"


@query(f"WITH {TEXTS}, c AS (SELECT comment_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '@[^ \\t\\n\\r]+[ \\t\\n\\r]*', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM texts) SELECT comment_id, body FROM c WHERE body <> ''")
def clean_comments(spark, sf_dir):
    return A.comments_text(spark, sf_dir).select("comment_id", X.clean_comment(F.col("text")).alias("body")).filter("body IS NOT NULL")


@query(f"WITH {TEXTS} SELECT comment_id, regexp_replace(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '@[^ \\t\\n\\r]+', '', 'g'), '[ \\t\\n\\r]+', '', 'g') AS body FROM texts")
def preprocess_text(spark, sf_dir):
    return A.comments_text(spark, sf_dir).select("comment_id", X.preprocess(F.col("text")).alias("body"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[[^\]]*\]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS body FROM pages")
def strip_html(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


@query(f"WITH {TEXTS} SELECT comment_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS body FROM texts")
def truncate_text(spark, sf_dir):
    return A.comments_text(spark, sf_dir).select("comment_id", X.truncate(F.col("text")).alias("body"))


@query("SELECT c_custkey AS user_id, coalesce(TRY_CAST(regexp_replace(c_name || c_custkey, '[^0-9]', '', 'g') AS BIGINT), 0) AS n FROM customer")
def parse_count(spark, sf_dir):
    rows = A.users(spark, sf_dir)
    return rows.select("user_id", X.parse_count(F.concat("name", F.col("user_id").cast("string"))).alias("n"))


@query("SELECT key, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, left(text, 50) AS key FROM documents) GROUP BY 1")
def dedup_prefix(spark, sf_dir):
    rows = A.comments_text(spark, sf_dir)
    return rows.groupBy(X.dedup_key(F.lit(None).cast("string"), F.col("text")).alias("key")).agg(F.min("comment_id").alias("first_id"), F.count("*").alias("n"))


@query(f"WITH {TEXTS} SELECT content_id, min(comment_id) AS seq FROM texts GROUP BY content_id, trim(text)")
def exact_text_dedup(spark, sf_dir):
    return similarity.exact_text_dedup(A.comments_text(spark, sf_dir), ["content_id"])


@query()
def near_dup_dedup(spark, sf_dir):
    return similarity.near_dup_dedup(A.comments_text(spark, sf_dir))


@query(f"""WITH {TEXTS}, b AS (SELECT content_id, comment_id, regexp_replace(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '@[^ \\t\\n\\r]+', '', 'g'), '[ \\t\\n\\r]+', '', 'g') AS body FROM texts)
SELECT content_id, min(comment_id) AS first_id, count(*) AS size FROM b WHERE length(body) >= 5 GROUP BY content_id, body HAVING count(*) >= 3""")
def exact_duplicate_clusters(spark, sf_dir):
    return similarity.exact_duplicate_clusters(A.comments_text(spark, sf_dir))


@query()
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(A.comments_text(spark, sf_dir))


@query()
def similarity_clusters(spark, sf_dir):
    return similarity.cluster_members(A.comments_text(spark, sf_dir))


@query()
def f5_similarity(spark, sf_dir):
    rows = A.comments_text(spark, sf_dir)
    return similarity.participation(rows, similarity.cluster_members(rows))


@query()
def cluster_details(spark, sf_dir):
    rows = A.comments_text(spark, sf_dir)
    return similarity.cluster_details(rows, similarity.cluster_members(rows))


@query(f"WITH {THREADS} SELECT comment_id AS node, min(comment_id) OVER (PARTITION BY comment_id // 100) AS root FROM threads WHERE comment_id // 100 IN (SELECT comment_id // 100 FROM threads GROUP BY 1 HAVING count(*) > 1)")
def components_edges(spark, sf_dir):
    """Comments of all threads, connected with what they answer."""
    from tidewatch.operators.graph import components

    answers = A.threads(spark, sf_dir).filter("parent_id <> 0")
    return components(answers.select(F.col("comment_id").alias("a"), F.col("parent_id").cast("long").alias("b")))


@query()
def components_orders(spark, sf_dir):
    """All contents and the accounts that commented on them (as negative numbers), connected by each comment."""
    from tidewatch.operators.graph import components

    return components(A.comments_rel(spark, sf_dir).select(F.col("content_id").alias("a"), (-1 - F.col("user_id")).alias("b")))


@query(f"WITH {TEXTS}, t AS (SELECT user_id, unnest(regexp_extract_all(text, '([一-鿿]{{2,}}|[a-zA-Z0-9]{{2,}})')) AS topic FROM texts), c AS (SELECT user_id, topic, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, encode(topic)) AS rank FROM c) SELECT user_id, topic, n, rank FROM r WHERE rank <= 10")
def top_topics(spark, sf_dir):
    return similarity.top_topics(A.comments_text(spark, sf_dir), ["user_id"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TEXTS}, h AS (SELECT user_id, {terms(LEXICONS.positive)} AS g, {terms(LEXICONS.negative)} AS b FROM texts) SELECT user_id, round(avg(CAST(g AND NOT b AS DOUBLE)), 6) AS positive, round(avg(CAST(b AND NOT g AS DOUBLE)), 6) AS negative, round(avg(CAST(g = b AS DOUBLE)), 6) AS neutral FROM h GROUP BY 1")
def sentiment_share(spark, sf_dir):
    return similarity.sentiment_share(A.comments_text(spark, sf_dir), ["user_id"], LEXICONS.positive, LEXICONS.negative)


@query()
def templating_indicator(spark, sf_dir):
    return similarity.templating(A.comments_text(spark, sf_dir))


@query()
def comment_digest(spark, sf_dir):
    """Sizes, sentiment, topics, template flag and examples of each user's texts."""
    return similarity.comment_digest(A.comments_text(spark, sf_dir), LEXICONS.positive, LEXICONS.negative)


@query("SELECT count(*) AS n_rows, count(text) AS n_texts, max(length(text)) AS longest, count(*) FILTER (lang = 'en') AS n_en FROM documents")
def run_metrics(spark, sf_dir):
    """Numbers that a run reports of what it read, taken while its comments are cleaned."""
    rows = A.comments_text(spark, sf_dir)
    counted = {"n_rows": F.count("*"), "n_texts": F.count("text"), "longest": F.max(F.length("text")), "n_en": F.count_if(F.col("content_id") == "en")}
    watched, metrics = flagship.observed(rows, counted)
    watched.select("comment_id", X.clean_comment(F.col("text")).alias("body")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(metrics.get[c] for c in counted)], "n_rows long, n_texts long, longest long, n_en long")


YEAR_SQL = "CASE " + " ".join(f"WHEN x < {int(b)} THEN {y}" for b, y in features.YEAR_BANDS) + f" ELSE {features.LAST_YEAR} END"


@query(f"SELECT c_custkey AS user_id, {YEAR_SQL} AS year FROM (SELECT c_custkey, c_custkey * 1000000 AS x FROM customer)")
def id_year_band(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", features.id_year(F.col("user_id") * 1_000_000).alias("year"))


DATE_SQL = "CASE WHEN length(registered_raw) >= 10 AND TRY_CAST(left(registered_raw, 10) AS DATE) IS NOT NULL THEN TRY_CAST(left(registered_raw, 10) AS DATE) WHEN TRY_CAST(registered_raw AS BIGINT) > 1000000000 THEN CAST(to_timestamp(CAST(registered_raw AS BIGINT)) AT TIME ZONE 'UTC' AS DATE) END"


@query(f"WITH {USERS} SELECT user_id, coalesce(year({DATE_SQL}), {YEAR_SQL.replace('x <', 'user_id <')}) AS year FROM users")
def registration_year(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", features.registration_year(F.col("registered_raw"), F.col("user_id")).cast("long").alias("year"))


@query(f"""WITH {USERS}, d AS (SELECT user_id, level, user_id % 8 AS cc, date_diff('day', coalesce({DATE_SQL}, make_date({YEAR_SQL.replace('x <', 'user_id <')}, 1, 1)), DATE '{AS_OF}') AS days FROM users)
SELECT user_id, CASE WHEN days < 30 THEN CASE WHEN cc >= 5 THEN 0.9 ELSE 0.7 END WHEN days < 90 THEN CASE WHEN cc >= 5 THEN 0.6 ELSE 0.4 END WHEN days < 180 THEN greatest(0.3, least(1.0, cc * 0.03))
 WHEN days < 365 THEN greatest(0.2, least(1.0, cc * 0.02)) WHEN days < 730 THEN greatest(0.1, least(1.0, cc * 0.01)) WHEN days < 1825 THEN 0.05 ELSE 0.02 END::DOUBLE AS f1 FROM d""")
def f1_account_age(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", features.account_age(F.col("registered_raw"), F.col("user_id"), F.col("level"), F.col("user_id") % 8, AS_OF).alias("f1"))


@query(f"WITH {USERS} SELECT user_id, CAST(CASE WHEN follower < 50 AND following > 500 THEN 0.9 WHEN follower < 100 AND following > 300 THEN 0.7 WHEN follower < 200 AND following > 200 THEN 0.4 ELSE 0 END AS DOUBLE) AS f2 FROM users")
def f2_follow_ratio(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", features.follow_ratio(F.col("follower"), F.col("following"), F.lit(True)).alias("f2"))


@query(f"WITH {COMMENTS}, {USERS}, s AS (SELECT content_id, user_id, count(*) AS cc FROM comments GROUP BY 1, 2) SELECT content_id, user_id, round(CAST(least(1.0, CASE coalesce(level, 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 WHEN 4 THEN 0.1 ELSE 0.0 END * least(1.0, cc / 5)) AS DOUBLE), 6) AS f3 FROM s LEFT JOIN users USING (user_id)")
def f3_level(spark, sf_dir):
    stats = features.comment_stats_of(A.comments_rel(spark, sf_dir), A.users(spark, sf_dir))
    return stats.select("content_id", "user_id", F.round(features.level_score(F.coalesce("level", F.lit(3)), F.col("cc")), 6).alias("f3"))


@query(f"WITH {USERS} SELECT user_id, CAST(CASE WHEN avatar = '' THEN 0.5 ELSE 0 END + CASE WHEN verify_type = -1 THEN 0.5 ELSE 0 END AS DOUBLE) AS f4 FROM users")
def f4_avatar_verify(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", features.avatar_verify(F.col("avatar"), F.col("verify_type"), F.lit(True)).alias("f4"))


BURST_SQL = f"""WITH {TIMED}, t AS (SELECT content_id, min(epoch_us(created_at)) AS t0, max(epoch_us(created_at)) AS t1 FROM timed GROUP BY 1),
w AS (SELECT content_id, t0, CAST(ceil((t1 - t0) / 21600000000) AS BIGINT) AS n FROM t),
slots AS (SELECT content_id, t0, unnest(generate_series(0, n - 1)) AS slot FROM w),
placed AS (SELECT timed.content_id, user_id, (epoch_us(created_at) - t0) // 21600000000 AS slot FROM timed JOIN w USING (content_id)),
c AS (SELECT content_id, slot, count(DISTINCT user_id) AS n_users FROM placed GROUP BY 1, 2),
win AS (SELECT s.content_id, s.slot, coalesce(n_users, 0) AS n_users FROM slots s LEFT JOIN c ON s.content_id = c.content_id AND s.slot = c.slot)"""


@query(BURST_SQL + " SELECT content_id, slot, n_users FROM win")
def burst_windows(spark, sf_dir):
    return timeseries.burst_windows(A.comments_time(spark, sf_dir), 21_600).select("content_id", "slot", "n_users")


@query(BURST_SQL + """, st AS (SELECT content_id, avg(n_users) AS m, stddev_samp(n_users) AS sd FROM win GROUP BY 1),
hot AS (SELECT win.content_id, slot, least(1, (n_users - m) / sd / 5) AS gain FROM win JOIN st USING (content_id) WHERE (n_users - m) / sd > 2),
raw AS (SELECT p.content_id, user_id, sum(gain) AS r FROM (SELECT DISTINCT content_id, user_id, slot FROM placed) p JOIN hot ON p.content_id = hot.content_id AND p.slot = hot.slot GROUP BY 1, 2)
SELECT content_id, user_id, round(r / max(r) OVER (PARTITION BY content_id), 6) AS score FROM raw""")
def burst_scores(spark, sf_dir):
    return timeseries.burst_scores(A.comments_time(spark, sf_dir), 21_600).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT day, n FROM d WHERE n > (SELECT avg(n) + 2 * stddev_samp(n) FROM d))
SELECT o_orderkey AS user_id, round(n / (SELECT max(n) FROM p), 6) AS score FROM orders JOIN p ON CAST(o_orderdate AS DATE) = day""")
def registration_batches(spark, sf_dir):
    rows = A.contents(spark, sf_dir).select(F.col("content_id").alias("user_id"), F.to_date("published_at").alias("day"))
    return timeseries.registration_batches(rows).select("user_id", F.round("score", 6).alias("score"))


@query(f"WITH {TIMED}, t AS (SELECT content_id, date_trunc('minute', min(created_at)) AS t0 FROM timed GROUP BY 1) SELECT content_id, strftime(make_timestamp((CAST(epoch(t0) AS BIGINT) + CAST(epoch(date_trunc('second', created_at)) - epoch(t0) AS BIGINT) // 1800 * 1800) * 1000000), '%Y-%m-%d %H:%M') AS bin_start, count(*) AS n FROM timed JOIN t USING (content_id) GROUP BY 1, 2")
def comment_timeline(spark, sf_dir):
    return timeseries.timeline(A.comments_time(spark, sf_dir))


GAP_SQL = f"WITH {COMMENTS}, d AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM comments), g AS (SELECT user_id, day, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d)"


@query(GAP_SQL + " SELECT user_id, coalesce(max(gap), 0) AS gap_days, coalesce(max(gap), 0) >= 30 AS sudden, strftime(max(day), '%Y-%m-%d') AS last_active, CASE WHEN coalesce(max(gap), 0) >= 30 THEN 'silent for ' || max(gap) || ' days' END AS reason FROM g GROUP BY 1")
def inactivity_gap(spark, sf_dir):
    return timeseries.inactivity_gap(A.comments_rel(spark, sf_dir))


@query("WITH n AS (SELECT l_suppkey AS user_id, max(l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), h AS (SELECT l_suppkey AS user_id, max(l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT user_id, CAST(floor((epoch(n.t) - epoch(h.t)) / 86400) AS BIGINT) AS gap_days, floor((epoch(n.t) - epoch(h.t)) / 86400) > 30 AS reactivated FROM n JOIN h USING (user_id)")
def reactivation_gap(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"), "l_returnflag")
    return timeseries.reactivation_gap(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"))


@query(f"WITH {TIMED}, h AS (SELECT user_id, hour(created_at) AS hour, count(*) AS n FROM timed GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS rank FROM h) SELECT user_id, hour, n, rank FROM r WHERE rank <= 5")
def activity_hours(spark, sf_dir):
    return timeseries.activity_hours(A.comments_time(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long")).withColumn("hour", F.col("hour").cast("long"))


@query(f"WITH {TIMED}, h AS (SELECT user_id, hour(created_at) AS hour, count(*) AS n, sum(length(content_id)) AS chars FROM timed GROUP BY 1, 2) SELECT user_id, arg_max(hour, n * 100 - hour) AS active_hour, round(sum(chars) / sum(n), 1) AS avg_length FROM h GROUP BY 1")
def history_habits(spark, sf_dir):
    rows = A.comments_time(spark, sf_dir).withColumn("text", F.col("content_id"))
    return timeseries.history_habits(rows).withColumn("active_hour", F.col("active_hour").cast("long"))


@query(f"WITH {TIMED}, d AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM timed GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n FROM r WHERE k <= 30")
def daily_activity(spark, sf_dir):
    return timeseries.daily_activity(A.comments_time(spark, sf_dir))


@query(f"""WITH {TIMED}, g AS (SELECT content_id, user_id, (epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY content_id, user_id ORDER BY created_at)) / 1e6 AS gap FROM timed),
s AS (SELECT content_id, user_id, count(gap) AS k, avg(gap) AS m, stddev_pop(gap) AS sd FROM g GROUP BY 1, 2), c AS (SELECT *, CASE WHEN k >= 2 AND m > 0 THEN sd / m END AS cv FROM s)
SELECT content_id, user_id, round(cv, 6) AS cv, CAST(CASE WHEN cv < 0.3 THEN 0.9 WHEN cv < 0.5 THEN 0.6 WHEN cv < 0.8 THEN 0.3 ELSE 0 END AS DOUBLE) AS f16 FROM c""")
def f16_regularity(spark, sf_dir):
    return timeseries.time_regularity(A.comments_time(spark, sf_dir)).withColumn("cv", F.round("cv", 6))


@query(BURST_SQL + """, st AS (SELECT content_id, avg(n_users) AS m, stddev_samp(n_users) AS sd FROM win GROUP BY 1),
hot AS (SELECT win.content_id, slot, least(1, (n_users - m) / sd / 5) AS gain FROM win JOIN st USING (content_id) WHERE (n_users - m) / sd > 2),
raw AS (SELECT p.content_id, user_id, sum(gain) AS r FROM (SELECT DISTINCT content_id, user_id, slot FROM placed) p JOIN hot ON p.content_id = hot.content_id AND p.slot = hot.slot GROUP BY 1, 2),
sc AS (SELECT content_id, user_id, r / max(r) OVER (PARTITION BY content_id) AS score FROM raw)
SELECT content_id, user_id, round(coalesce(max(score), 0), 6) AS f6 FROM timed LEFT JOIN sc USING (content_id, user_id) GROUP BY 1, 2""")
def f6_burst(spark, sf_dir):
    rows = A.comments_time(spark, sf_dir)
    scores = timeseries.burst_scores(rows, 21_600)
    return rows.select("content_id", "user_id").distinct().join(scores, ["content_id", "user_id"], "left").select("content_id", "user_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("f6"))


@query(f"WITH {TEXTS}, c AS (SELECT content_id, user_id, count(*) AS n, count(*) FILTER ({terms(LEXICONS.positive)}) AS p, count(*) FILTER ({terms(LEXICONS.negative)}) AS g FROM texts WHERE length(text) >= 3 GROUP BY 1, 2) SELECT content_id, user_id, round(CAST(CASE WHEN n < 3 THEN 0 ELSE greatest(0, (greatest(p, g) / n - 0.5) * 2) END AS DOUBLE), 6) AS f7 FROM c")
def f7_sentiment_extreme(spark, sf_dir):
    return features.sentiment_extreme(A.comments_text(spark, sf_dir), LEXICONS.positive, LEXICONS.negative).withColumn("f7", F.round("f7", 6))


@query(f"WITH {TIMED} SELECT content_id, user_id, round(greatest(0, 1 - avg(like_count) / 10), 6) AS f8 FROM timed GROUP BY 1, 2")
def f8_like_ratio(spark, sf_dir):
    stats = features.comment_stats(A.comments_time(spark, sf_dir))
    return stats.select("content_id", "user_id", F.round(features.like_ratio(F.col("avg_like")), 6).alias("f8"))


GARBLED_SQL = r"""(n = '' OR regexp_matches(n, '(?i)^bili_[0-9A-Za-z_]{5,}$') OR regexp_matches(n, '^用户[0-9]{5,}$') OR regexp_matches(n, '^[0-9]{6,}$')
 OR (regexp_matches(n, '^[a-zA-Z0-9_]{6,}$') AND length(regexp_replace(n, '[^0-9]', '', 'g')) / length(n) > 0.35 AND NOT regexp_matches(n, '[a-zA-Z]{3}'))
 OR regexp_matches(n, '(?i)^(asdfgh|qwerty|zxcvbn|qazwsx)[a-z]*$')
 OR (length(regexp_extract(n, '^([a-zA-Z]+)[0-9]{4,}$', 1)) > 0 AND (((length(n) - length(regexp_extract(n, '^([a-zA-Z]+)[0-9]{4,}$', 1))) / length(n) >= 0.6 AND length(regexp_extract(n, '^([a-zA-Z]+)[0-9]{4,}$', 1)) <= 3) OR ((length(n) - length(regexp_extract(n, '^([a-zA-Z]+)[0-9]{4,}$', 1))) / length(n) >= 0.5 AND length(regexp_extract(n, '^([a-zA-Z]+)[0-9]{4,}$', 1)) <= 4))))"""


@query(f"SELECT p_partkey AS user_id, n AS name, {GARBLED_SQL} AS garbled FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ab' || p_partkey * 1000 WHEN 1 THEN 'bili_' || p_partkey * 10000 WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN p_partkey * 1000000 || '' ELSE 'name' || p_partkey END AS n FROM part)")
def garbled_name(spark, sf_dir):
    key = F.col("p_partkey")
    text = lambda k, by: (key * by).cast("string") if not k else F.concat(F.lit(k), (key * by).cast("string"))
    name = F.when(key % 5 == 0, text("ab", 1000)).when(key % 5 == 1, text("bili_", 10_000)).when(key % 5 == 2, F.replace("p_name", F.lit(" "), F.lit("_"))).when(key % 5 == 3, text("", 1_000_000)).otherwise(text("name", 1))
    return A.table(spark, sf_dir, "part").select(key.alias("user_id"), name.alias("name")).withColumn("garbled", X.garbled_name(F.col("name")))


@query(f"WITH {USERS}, u AS (SELECT *, name AS n FROM users) SELECT user_id, CAST(((avatar = '')::INT + {GARBLED_SQL}::INT + (coalesce(post_count, 0) = 0)::INT + (upload_count = 0)::INT) / 5 AS DOUBLE) AS f12 FROM u")
def f12_skeleton(spark, sf_dir):
    hits = features.skeleton_hits(F.col("avatar"), F.col("name"), F.col("post_count"), F.lit(0), F.col("upload_count"), F.col("sign"))
    return A.users(spark, sf_dir).select("user_id", (hits / 5).alias("f12"))


@query(f"WITH {TEXTS}, {POSTS} SELECT user_id, CAST(max({terms(LEXICONS.posts)}::INT) AS DOUBLE) AS f14 FROM posts GROUP BY 1")
def f14_post_lexicon(spark, sf_dir):
    return features.post_lexicon(A.posts(spark, sf_dir), LEXICONS.posts)


@query(f"WITH {TEXTS}, c AS (SELECT content_id, user_id, count(*) AS n, max({terms(LEXICONS.spam_hard)}::INT) AS hard, count(*) FILTER ({terms(LEXICONS.spam_soft)}) AS h FROM texts GROUP BY 1, 2) SELECT content_id, user_id, CAST(CASE WHEN hard = 1 THEN 1 WHEN h = 0 THEN 0 WHEN h / n >= 0.5 THEN 0.9 WHEN h >= 3 THEN 0.85 WHEN h = 2 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS f15 FROM c")
def f15_spam_lexicon(spark, sf_dir):
    return features.spam_lexicon(A.comments_text(spark, sf_dir), LEXICONS.spam_hard, LEXICONS.spam_soft)


def hits_sql(names: list[str]) -> str:
    return "(" + " + ".join(f"contains(sign, '{t}')::INT" for t in names) + ")"


@query(f"""WITH {USERS} SELECT user_id, CAST(least(100, CASE WHEN {hits_sql(LEXICONS.sign_direct)} >= 2 THEN 50 WHEN {hits_sql(LEXICONS.sign_direct)} = 1 THEN 25 ELSE 0 END
 + CASE WHEN {hits_sql(LEXICONS.sign_defensive)} >= 2 THEN 30 WHEN {hits_sql(LEXICONS.sign_defensive)} = 1 THEN 15 ELSE 0 END + CASE WHEN {hits_sql(LEXICONS.sign_provoking)} >= 1 THEN 10 ELSE 0 END) / 100 AS DOUBLE) AS f18 FROM users""")
def f18_signature(spark, sf_dir):
    score = features.signature_score(F.col("sign"), F.lit(True), LEXICONS.sign_direct, LEXICONS.sign_defensive, LEXICONS.sign_provoking)
    return A.users(spark, sf_dir).select("user_id", score.alias("f18"))


@query("SELECT p_partkey AS a, CAST(CASE WHEN p_name = p_type THEN 1 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END AS DOUBLE) AS similarity FROM part")
def edit_similarity(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), X.edit_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query(f"""WITH {USERS}, r AS (SELECT doc_id AS user_id, CAST(n_chars % 7 / 7 AS DOUBLE) AS f4, CAST(n_chars % 6 / 5 AS DOUBLE) AS f12 FROM documents)
SELECT r.user_id, CASE WHEN u.user_id IS NULL THEN f4 ELSE CAST(CASE WHEN avatar = '' THEN 0.5 ELSE 0 END + CASE WHEN verify_type = -1 THEN 0.5 ELSE 0 END AS DOUBLE) END AS f4,
 CASE WHEN u.user_id IS NULL THEN f12 ELSE ((avatar = '')::INT + (coalesce(post_count, -1) = 0)::INT + (upload_count = 0)::INT) / 5 END AS f12 FROM r LEFT JOIN users u USING (user_id)""")
def refresh_profile_features(spark, sf_dir):
    """Report rows whose user has a fresh profile take its features, the others keep theirs; the verify state is JSON text."""
    report = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), (F.col("n_chars") % 7 / 7).alias("f4"), (F.col("n_chars") % 6 / 5).alias("f12"))
    profiles = A.users(spark, sf_dir).withColumn("verify", F.to_json(F.struct(F.col("verify_type").alias("type")))).drop("verify_type")
    return features.refreshed(report, profiles).select("user_id", "f4", "f12")


@query(f"WITH {USERS} SELECT user_id, CASE WHEN avatar = '' THEN 'avatar no' ELSE 'avatar yes' END || ' | posts ' || coalesce(CAST(post_count AS VARCHAR), '?') || ' | uploads ' || CASE WHEN upload_count >= 0 THEN CAST(upload_count AS VARCHAR) ELSE '?' END || ' | sign ' || left(sign, 30) AS line FROM users")
def profile_line(spark, sf_dir):
    return A.users(spark, sf_dir).select("user_id", X.profile_line(F.col("avatar"), F.col("post_count"), F.col("upload_count"), F.col("sign")).alias("line"))


@query(f"WITH {USERS} SELECT user_id, '等级=Lv' || level || ' | 粉丝=' || follower || CASE WHEN avatar <> '' THEN ' | 有头像' ELSE '' END AS digest FROM users")
def profile_digest(spark, sf_dir):
    text = F.concat(F.lit("Level: "), F.col("level").cast("string"), F.lit(" 粉丝："), F.col("follower").cast("string"), F.when(F.col("avatar") != "", " 头像").otherwise(""))
    return A.users(spark, sf_dir).select("user_id", X.profile_digest(text).alias("digest"))


@query("SELECT doc_id AS user_id, CASE WHEN n_chars >= 100 AND n_chars > 100 THEN 'share ' || CAST(round(n_chars / 100) AS BIGINT) || '%' ELSE 'share ' || n_chars || '%' END AS note FROM documents")
def repair_percent(spark, sf_dir):
    note = F.concat(F.lit("share "), F.col("n_chars").cast("string"), F.lit("%"))
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), X.repair_percent(note).alias("note"))


def all_features(spark, sf_dir):
    """Features of the users who comment on texts, with profiles from the customers of the same number."""
    return flagship.user_features(with_times(spark, sf_dir), A.users(spark, sf_dir), A.posts(spark, sf_dir), LEXICONS, AS_OF)


def with_times(spark, sf_dir):
    """Text comments with a time and likes that follow from their number."""
    rows = A.comments_text(spark, sf_dir)
    return rows.withColumn("created_at", F.timestamp_seconds(1_704_067_200 + F.col("comment_id") * 613 % 2_000_000)).withColumn("like_count", F.col("comment_id") % 13)


@query()
def user_features(spark, sf_dir):
    return all_features(spark, sf_dir)


@query()
def user_features_with_clusters(spark, sf_dir):
    """All features, with the share of clustered comments from the clusters of the same comments."""
    rows = with_times(spark, sf_dir)
    return flagship.user_features(rows, A.users(spark, sf_dir), A.posts(spark, sf_dir), LEXICONS, AS_OF, similarity.cluster_members(rows))


SCORE_SQL = f"""WITH {USERS}, f AS (SELECT user_id, CASE WHEN level = 0 THEN 1.0 WHEN level = 1 THEN 0.8 WHEN level = 2 THEN 0.6 WHEN level = 3 THEN 0.3 WHEN level = 4 THEN 0.1 ELSE 0 END AS f3,
 CASE WHEN avatar = '' THEN 0.5 ELSE 0 END + CASE WHEN verify_type = -1 THEN 0.5 ELSE 0 END AS f4, ((avatar = '')::INT + (coalesce(post_count, 0) = 0)::INT + (upload_count = 0)::INT) AS k, (user_id % 11 = 0)::INT AS f15, user_id % 3 AS content_id FROM users),
b AS (SELECT *, CASE WHEN k >= 5 THEN 0.35 WHEN k = 4 THEN 0.3 WHEN k = 3 THEN 0.25 WHEN k = 2 THEN 0.2 ELSE 0 END AS b1, CASE WHEN k / 5 >= 0.5 AND f4 >= 0.25 THEN 0.15 ELSE 0 END AS b2, CASE WHEN f15 = 1 THEN 0.2 ELSE 0 END AS b4 FROM f),
s AS (SELECT *, round(round(100 * least(1.0, CAST(0.13 * f3 + 0.08 * f4 + 0.23 * k / 5 + 0.04 * f15 + b1 + b2 + b4 AS DOUBLE)), 6), 1) AS score FROM b)"""


def scored_profiles(spark, sf_dir):
    """Scores of profiles by the features that need no comments."""
    hits = features.refreshed_skeleton_hits(F.col("avatar"), F.lit("name"), F.coalesce("post_count", F.lit(0)), F.col("upload_count"), F.col("sign"))
    given = {"f3": features.level_score(F.col("level"), F.lit(5)), "f4": features.avatar_verify(F.col("avatar"), F.col("verify_type"), F.lit(True)), "f12": hits / 5, "f15": (F.col("user_id") % 11 == 0).cast("double")}
    rows = A.users(spark, sf_dir).select("user_id", (F.col("user_id") % 3).alias("content_id"), *[given.get(f, F.lit(0.0)).alias(f) for f in scoring.WEIGHTS])
    return scoring.with_scores(rows)


@query(SCORE_SQL + " SELECT user_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS risk FROM s")
def suspicion_score(spark, sf_dir):
    return scored_profiles(spark, sf_dir).select("user_id", "score", "risk")


@query(SCORE_SQL + " SELECT user_id, round(CAST(0.13 * f3 + 0.08 * f4 + 0.23 * k / 5 + 0.04 * f15 AS DOUBLE), 6) AS weighted FROM s")
def weighted_score(spark, sf_dir):
    return scored_profiles(spark, sf_dir).select("user_id", F.round(scoring.weighted(), 6).alias("weighted"))


@query(SCORE_SQL + " SELECT user_id, concat_ws(',', CASE WHEN b1 > 0 THEN 'empty account' END, CASE WHEN b2 > 0 THEN 'empty account without picture' END, CASE WHEN b4 > 0 THEN 'spam lexicon' END) AS signals FROM s")
def decisive_signals(spark, sf_dir):
    return scored_profiles(spark, sf_dir).select("user_id", F.array_join("signals", ",").alias("signals"))


@query(SCORE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) AS rank FROM s) SELECT content_id, user_id, score, rank FROM r WHERE rank <= 300")
def top_suspects(spark, sf_dir):
    return scoring.ranked(scored_profiles(spark, sf_dir), "content_id", "user_id").filter("rank <= 300").select("content_id", "user_id", "score", F.col("rank").cast("long").alias("rank"))


@query(SCORE_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) AS rank FROM s) SELECT content_id, user_id, score FROM r WHERE rank <= 500")
def suspects_lite(spark, sf_dir):
    """The list without its wide columns."""
    rows = scoring.ranked(scored_profiles(spark, sf_dir), "content_id", "user_id").filter("rank <= 500")
    return rows.drop(*scoring.WEIGHTS, "signals", "risk", "rank")


@query(SCORE_SQL + ", e AS (SELECT user_id, unnest([{'f': 'f12', 'v': k / 5}, {'f': 'f15', 'v': CAST(f15 AS DOUBLE)}, {'f': 'f3', 'v': CAST(f3 AS DOUBLE)}, {'f': 'f4', 'v': CAST(f4 AS DOUBLE)}]) AS e FROM s), r AS (SELECT user_id, e.f AS feature, e.v AS v, row_number() OVER (PARTITION BY user_id ORDER BY e.v DESC, e.f) AS rank FROM e WHERE e.v > 0.3) SELECT user_id, rank, feature, round(v * 100, 1) AS percent FROM r WHERE rank <= 3")
def top_features(spark, sf_dir):
    return scoring.top_features(scored_profiles(spark, sf_dir), ["user_id"])


@query(f"WITH {SCORED}, s AS (SELECT content_id, unnest([0, 1, 2, 3, 4]) AS bucket FROM (SELECT DISTINCT content_id FROM scored)) SELECT s.content_id, s.bucket, count(x.content_id) AS n FROM s LEFT JOIN scored x ON s.content_id = x.content_id AND s.bucket = least(4, floor(x.score / 20)) GROUP BY 1, 2")
def score_distribution(spark, sf_dir):
    return scoring.score_distribution(A.scored_users(spark, sf_dir), "content_id")


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) AS rank FROM scored WHERE score >= 20) SELECT content_id, user_id, score, rank FROM r WHERE rank <= 50")
def candidates(spark, sf_dir):
    return scoring.candidates(A.scored_users(spark, sf_dir)).select("content_id", "user_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) AS rank FROM scored WHERE score >= greatest(10, least(70, 85))) SELECT content_id, user_id, score, rank FROM r WHERE rank <= 10")
def deep_candidates(spark, sf_dir):
    rows = A.scored_users(spark, sf_dir).filter(F.col("score") >= scoring.clamp_threshold(F.lit(85)))
    return scoring.candidates(rows, 0, 10).select("content_id", "user_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SCORED} SELECT content_id, user_id, (row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) - 1) // 5 AS batch FROM scored WHERE score >= 20 QUALIFY batch < 10")
def candidate_batches(spark, sf_dir):
    rows = A.scored_users(spark, sf_dir).filter("score >= 20")
    return scoring.batches(rows, 5, F.desc("score"), F.col("user_id")).select("content_id", "user_id", "batch")


@query(f"WITH {SCORED}, {VERDICTS} SELECT user_id, round(CAST(100 * CASE WHEN type_id > 0 THEN 0.75 * CASE WHEN score > 1 THEN score / 100 ELSE score END + 0.25 * confidence / 100 ELSE CASE WHEN score > 1 THEN score / 100 ELSE score END END AS DOUBLE), 4) AS fused, type_id = 0 AND CASE WHEN score > 1 THEN score / 100 ELSE score END >= 0.5 AS review FROM scored LEFT JOIN verdicts USING (user_id)")
def fuse_stage1(spark, sf_dir):
    rows = scoring.fuse_first(A.scored_users(spark, sf_dir), A.verdicts(spark, sf_dir))
    review = F.when(F.col("type_id").isNotNull(), F.col("review_note").isNotNull()).when(scoring.unit(F.col("score")) < 0.5, F.lit(False))
    return rows.select("user_id", F.round("fused", 4).alias("fused"), review.alias("review"))


@query(f"WITH {SCORED}, {VERDICTS}, d AS (SELECT user_id, type_id, confidence - 10 AS c2 FROM verdicts WHERE user_id % 2 = 0), u AS (SELECT user_id, CASE WHEN score > 1 THEN score / 100 ELSE score END AS e FROM scored) SELECT user_id, round(CAST(100 * CASE WHEN d.type_id > 0 THEN 0.5 * e + 0.25 * v.confidence / 100 + 0.25 * c2 / 100 ELSE e END AS DOUBLE), 4) AS fused, d.type_id IS NOT NULL AS deep_analysed, coalesce(h.n, 0) AS n_history, h.last_at FROM u LEFT JOIN verdicts v USING (user_id) LEFT JOIN d USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS last_at FROM events GROUP BY 1) h USING (user_id)")
def fuse_stage2(spark, sf_dir):
    """With each user's history: number of entries and day of the last."""
    first = A.verdicts(spark, sf_dir)
    history = A.comments_time(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_history"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_at"))
    deep = first.filter("user_id % 2 = 0").withColumn("confidence", F.col("confidence") - 10)
    return scoring.fuse_second(A.scored_users(spark, sf_dir), first, deep, history).select("user_id", F.round("fused", 4).alias("fused"), "deep_analysed", "n_history", "last_at")


@query(f"WITH {SCORED}, {VERDICTS} SELECT user_id, coalesce(type_id, 0) AS type_id, coalesce(confidence, 0) AS confidence, CASE WHEN type_id IS NULL THEN 'not analysed' ELSE 'analysed' END AS status FROM scored LEFT JOIN verdicts USING (user_id)")
def verdict_defaults(spark, sf_dir):
    return scoring.verdict_defaults(A.scored_users(spark, sf_dir), A.verdicts(spark, sf_dir))


@query(f"WITH {SCORED}, {VERDICTS} SELECT user_id, coalesce(confidence, score) AS score, type_id FROM scored LEFT JOIN verdicts USING (user_id)")
def report_merge_verdicts(spark, sf_dir):
    new = A.verdicts(spark, sf_dir).withColumnRenamed("confidence", "score")
    return scoring.merged_verdicts(A.scored_users(spark, sf_dir), new).select("user_id", "score", "type_id")


@query(f"WITH {VERDICTS} SELECT user_id AS doc, user_id AS mid, type_id, confidence, user_id % 4 = 3 AS risk_confirmed, CASE WHEN user_id % 4 = 3 THEN 'deep' ELSE 'plain' END AS reasoning FROM verdicts")
def parse_verdicts(spark, sf_dir):
    """Replies in four wrappings: an object with results in a fence, one bare object, an array inside prose, and a deep
    verdict with names of its own."""
    v = A.verdicts(spark, sf_dir)
    mid = F.col("user_id").alias("mid")
    one = F.to_json(F.struct(mid, "type_id", "confidence", F.lit("plain").alias("reasoning")))
    deep = F.to_json(F.struct(mid, F.col("type_id").alias("deep_type_id"), F.col("confidence").alias("deep_confidence"), F.lit("deep").alias("deep_reasoning"), F.lit(True).alias("risk_confirmed")))
    kind = F.col("user_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n{\"results\": ["), one, F.lit("]}\n```"))).when(kind == 1, one).when(kind == 2, F.concat(F.lit("So: ["), one, F.lit("] - done"))).otherwise(deep)
    rows = scoring.parse_verdicts(v.select(F.col("user_id").alias("doc"), reply.alias("reply")), "doc")
    return rows.select("doc", "mid", "type_id", "confidence", "risk_confirmed", "reasoning")


PROFILE_SQL = "CASE WHEN avatar = '' THEN 'avatar no' ELSE 'avatar yes' END || ' | posts ' || coalesce(CAST(post_count AS VARCHAR), '?') || ' | uploads ' || CASE WHEN upload_count >= 0 THEN CAST(upload_count AS VARCHAR) ELSE '?' END || ' | sign ' || left(sign, 30)"


@query(SCORE_SQL.replace("WITH ", f"WITH {TEXTS}, ", 1) + f""", c AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, user_id) AS position FROM s),
m AS (SELECT user_id, text, row_number() OVER (PARTITION BY user_id ORDER BY comment_id) AS k FROM texts),
said AS (SELECT user_id, string_agg(left(coalesce(text, ''), 100), ' | ' ORDER BY k) AS said FROM m WHERE k <= 3 GROUP BY 1),
g AS (SELECT user_id, unnest([{{'n': 'f12', 'v': k / 5}}, {{'n': 'f15', 'v': CAST(f15 AS DOUBLE)}}, {{'n': 'f3', 'v': CAST(f3 AS DOUBLE)}}, {{'n': 'f4', 'v': CAST(f4 AS DOUBLE)}}]) AS e FROM s),
shown AS (SELECT user_id, string_agg(e.n || ' ' || CAST(round(e.v * 100) AS INTEGER) || '%', ', ' ORDER BY e.v DESC, e.n) AS shown FROM g WHERE e.v >= 0.3 GROUP BY 1),
p AS (SELECT user_id, {PROFILE_SQL} AS line FROM users),
l AS (SELECT content_id, position, (position - 1) // 5 AS batch, concat_ws(chr(10), 'user ' || user_id || ': score ' || printf('%.1f', score), 'features: ' || shown, 'profile: ' || line, 'comments: ' || said) AS part
  FROM c LEFT JOIN shown USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN said USING (user_id) WHERE position <= 50)
SELECT content_id, batch, string_agg(part, chr(10) || chr(10) ORDER BY position) AS packet FROM l GROUP BY 1, 2""")
def review_packets(spark, sf_dir):
    """A text for each batch of five candidates, for an outside reviewer or model."""
    u = A.users(spark, sf_dir)
    profiles = u.select("user_id", X.profile_line(F.col("avatar"), F.col("post_count"), F.col("upload_count"), F.col("sign")).alias("line"))
    return scoring.review_packets(scored_profiles(spark, sf_dir), A.comments_text(spark, sf_dir), profiles)


@query(f"WITH {SCORED}, s AS (SELECT content_id, count(*) AS t, count(*) FILTER (score >= 60) AS h, count(*) FILTER (score >= 30 AND score < 60) AS m FROM scored GROUP BY 1) SELECT content_id, t || ' users commented. ' || h || ' are high risk (' || printf('%.1f', round(h / t * 100, 1)) || '%), ' || m || ' medium (' || printf('%.1f', round(m / t * 100, 1)) || '%).' AS summary FROM s")
def summary_text(spark, sf_dir):
    stats = scoring.risk_statistics(A.scored_users(spark, sf_dir), ["content_id"]).withColumn("n_clusters", F.lit(0))
    return flagship.summary_text(stats).select("content_id", "summary")


@query(f"""WITH {SCORED}, {VERDICTS}, k AS (SELECT content_id, type_id, count(*) AS n FROM scored JOIN verdicts USING (user_id) GROUP BY 1, 2), t AS (SELECT content_id, sum(n) AS total, coalesce(sum(n) FILTER (type_id > 0), 0) AS found FROM k GROUP BY 1)
SELECT content_id, total || ' users reviewed, ' || found || ' confirmed.' || coalesce(' By type: ' || (SELECT string_agg('type ' || type_id || ' ' || n, ', ' ORDER BY n DESC, type_id) FROM k WHERE k.content_id = t.content_id AND type_id > 0) || '.', '') AS sentence FROM t""")
def verdict_sentences(spark, sf_dir):
    """What the verdicts say of each content: users reviewed, confirmed, and by type."""
    rows = A.scored_users(spark, sf_dir).join(A.verdicts(spark, sf_dir), "user_id")
    return flagship.verdict_sentences(rows).select("content_id", "sentence")


@query()
def analyze_all(spark, sf_dir):
    """The flagship: every content's comments analysed in one job."""
    return flagship.analyze_all(with_times(spark, sf_dir), A.users(spark, sf_dir), A.posts(spark, sf_dir), LEXICONS, AS_OF)


@query()
def report_document(spark, sf_dir):
    """The report of each content, written as JSON by content and read back."""
    comments = with_times(spark, sf_dir)
    meta = A.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("content_id")).agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_rows"))
    reports = flagship.report_documents(comments, A.users(spark, sf_dir), A.posts(spark, sf_dir), meta, LEXICONS, AS_OF)
    path = shared_dir(spark, "reports")
    files.write_rows(reports, path, "json", ["content_id"])
    return spark.read.schema(reports.schema).json(path)


REG_SQL = """WITH old AS (SELECT c_custkey AS user_id, c_name AS user_name, '' AS avatar, CAST(c_custkey % 101 AS DOUBLE) AS score, CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS added_by, 1 AS nr, ['old'] AS sources, CASE WHEN c_custkey % 3 = 0 THEN 'seen' ELSE '' END AS notes FROM customer WHERE c_custkey % 3 <> 1),
new AS (SELECT c_custkey AS user_id, '' AS user_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'a' || c_custkey END AS avatar, CAST(c_custkey * 7 % 101 AS DOUBLE) AS score, CASE WHEN c_custkey % 9 = 0 THEN 'manual' ELSE 'auto' END AS added_by, 1 AS nr, CASE WHEN c_custkey % 2 = 0 THEN ['old'] ELSE ['new'] END AS sources, 'again' AS notes FROM customer WHERE c_custkey % 3 <> 2),
merged AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(nullif(o.user_name, ''), nullif(n.user_name, ''), 'UID' || coalesce(o.user_id, n.user_id)) AS user_name, coalesce(nullif(o.avatar, ''), n.avatar, '') AS avatar,
 greatest(o.score, n.score) AS score, CASE WHEN o.added_by = 'manual' OR n.added_by = 'manual' THEN 'manual' ELSE 'auto' END AS added_by, coalesce(o.nr, 0) + coalesce(n.nr, 0) AS reasons_count, len(list_distinct(list_concat(coalesce(o.sources, []), coalesce(n.sources, [])))) AS sources_count,
 concat_ws('; ', nullif(o.notes, ''), nullif(n.notes, '')) AS notes FROM old o FULL JOIN new n ON o.user_id = n.user_id),
reg AS (SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS risk FROM merged)"""


def registry_sides(spark, sf_dir):
    key, text = F.col("user_id"), F.col("user_id").cast("string")
    reason = lambda score: F.array(F.struct(F.lit("engine").alias("type"), F.lit("c").alias("content_id"), score.alias("score")))
    users = A.users(spark, sf_dir).select("user_id", "name")
    old_score, new_score = (key % 101).cast("double"), (key * 7 % 101).cast("double")
    old = users.filter(key % 3 != 1).select(key, F.col("name").alias("user_name"), F.lit("").alias("avatar"), old_score.alias("score"), F.when(key % 4 == 0, "manual").otherwise("auto").alias("added_by"), reason(old_score).alias("reasons"), F.array(F.lit("old")).alias("sources"), F.when(key % 3 == 0, "seen").otherwise("").alias("notes"))
    new = users.filter(key % 3 != 2).select(key, F.lit("").alias("user_name"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("a"), text)).alias("avatar"), new_score.alias("score"), F.when(key % 9 == 0, "manual").otherwise("auto").alias("added_by"), reason(new_score).alias("reasons"), F.array(F.when(key % 2 == 0, "old").otherwise("new")).alias("sources"), F.lit("again").alias("notes"))
    return old, new


def merged_registry(spark, sf_dir):
    return registry.merge(*registry_sides(spark, sf_dir))


@query(REG_SQL + " SELECT user_id, user_name, avatar, score, risk, added_by, reasons_count, sources_count, notes FROM reg")
def registry_merge(spark, sf_dir):
    rows = merged_registry(spark, sf_dir)
    return registry.exported(rows).join(rows.select("user_id", "avatar", "notes"), "user_id")


@query(REG_SQL + " SELECT user_id, user_name, score, risk, added_by, reasons_count, sources_count FROM reg")
def registry_export(spark, sf_dir):
    """Written as CSV with a header and as JSON, and read back from both: each gives every second row."""
    rows = registry.exported(merged_registry(spark, sf_dir))
    back = []
    for k, form in enumerate(("csv", "json")):
        path = shared_dir(spark, f"registry-{form}")
        files.write_rows(rows, path, form)
        back.append(files.read_rows(spark, path, form, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).filter(F.col("user_id") % 2 == k))
    return back[0].unionByName(back[1])


@query(REG_SQL + " SELECT count(*) AS total, count(*) FILTER (added_by = 'auto') AS auto, count(*) FILTER (added_by = 'manual') AS manual, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low, round(avg(score), 1) AS avg_score FROM reg")
def registry_stats(spark, sf_dir):
    return registry.stats(merged_registry(spark, sf_dir))


@query(REG_SQL + " SELECT user_id, score, (SELECT count(*) FROM reg WHERE risk = 'high' AND contains(lower(user_name), '00')) AS total FROM reg WHERE risk = 'high' AND contains(lower(user_name), '00') ORDER BY score DESC, user_id LIMIT 20")
def registry_list(spark, sf_dir):
    rows = registry.listing(merged_registry(spark, sf_dir), risk_is="high").filter(F.lower("user_name").contains("00"))
    return keyed.page(rows, [F.desc("score"), F.col("user_id")], 1, 20).select("user_id", "score", "total")


@query(REG_SQL + ", r AS (SELECT user_id, reasons_count, row_number() OVER (ORDER BY reasons_count DESC, user_id) AS k FROM reg), t AS (SELECT user_id, row_number() OVER (ORDER BY greatest(CASE WHEN user_id % 3 <> 1 THEN user_id * 7919 % 1000 END, CASE WHEN user_id % 3 <> 2 THEN user_id * 104729 % 1000 END), user_id) AS k FROM reg), n AS (SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM reg) SELECT 'reasons' AS sorted_by, user_id, total, total_pages FROM r, n WHERE k BETWEEN 26 AND 50 UNION ALL SELECT 'time', user_id, total, total_pages FROM t, n WHERE k <= 25")
def registry_pages(spark, sf_dir):
    """The second page by number of reasons, and the first by the time that the merged registry keeps, oldest first."""
    sides = [side.withColumn("updated_at", F.timestamp_seconds(F.col("user_id") * factor % 1000)) for side, factor in zip(registry_sides(spark, sf_dir), (7919, 104_729), strict=True)]
    rows = registry.merge(*sides)
    pages = {"reasons": registry.listing_page(rows, 2, 25, "reasons"), "time": registry.listing_page(rows, 1, 25, "time", descending=False)}
    found = [page.select(F.lit(name).alias("sorted_by"), "user_id", "total", "total_pages") for name, page in pages.items()]
    return found[0].unionByName(found[1])


@query(REG_SQL + " SELECT count(*) FILTER (o.k IS NOT NULL) AS removed, count(*) FILTER (o.k IS NULL) AS kept FROM reg LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON user_id = k")
def registry_removed(spark, sf_dir):
    gone = A.contents(spark, sf_dir).filter("status = 'P'").select(F.col("owner_id").alias("user_id"))
    return registry.removed_count(merged_registry(spark, sf_dir), gone)


@query(SCORE_SQL + ", e AS (SELECT user_id, unnest([{'f': 'f12', 'v': k / 5}, {'f': 'f15', 'v': CAST(f15 AS DOUBLE)}, {'f': 'f3', 'v': CAST(f3 AS DOUBLE)}, {'f': 'f4', 'v': CAST(f4 AS DOUBLE)}]) AS e FROM s WHERE score >= 70), r AS (SELECT user_id, e.f AS f, e.v AS v, row_number() OVER (PARTITION BY user_id ORDER BY e.v DESC, e.f) AS rank FROM e) SELECT user_id, s.score, 'engine: ' || string_agg(r.f, ', ' ORDER BY rank) AS reason FROM r JOIN s USING (user_id) WHERE rank <= 3 AND v > 0.3 GROUP BY 1, 2")
def registry_reasons_named(spark, sf_dir):
    """What the registry keeps of an analysis: the score and its three largest features."""
    rows = registry.collected(scored_profiles(spark, sf_dir))
    return rows.select("user_id", "score", F.get("reasons", F.lit(0))["type"].alias("reason"))


@query(REG_SQL + " SELECT user_id, user_name, score, notes FROM reg WHERE user_id = 12")
def registry_get(spark, sf_dir):
    return merged_registry(spark, sf_dir).filter("user_id = 12").select("user_id", "user_name", "score", "notes")


@query(REG_SQL + " SELECT user_id FROM reg WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def registry_remove(spark, sf_dir):
    gone = A.contents(spark, sf_dir).filter("status = 'P'").select(F.col("owner_id").alias("user_id"))
    return registry.remove(merged_registry(spark, sf_dir), gone).select("user_id")


@query(REG_SQL + " SELECT user_id, CASE WHEN user_id = 12 THEN 'checked' ELSE notes END AS notes FROM reg")
def registry_notes(spark, sf_dir):
    return registry.with_notes(merged_registry(spark, sf_dir), 12, "checked").select("user_id", "notes")


@query(REG_SQL + " SELECT user_id, CASE WHEN avatar <> '' THEN avatar ELSE coalesce(p, '') END AS avatar FROM reg LEFT JOIN (SELECT o_custkey, 'p' || min(o_orderkey) AS p FROM orders GROUP BY 1) ON user_id = o_custkey")
def registry_avatar_fill(spark, sf_dir):
    pictures = A.contents(spark, sf_dir).select(F.col("owner_id").alias("user_id"), F.concat(F.lit("p"), F.col("content_id").cast("string")).alias("avatar"), F.col("content_id").alias("seq"))
    return registry.fill_avatars(merged_registry(spark, sf_dir), pictures).select("user_id", "avatar")


@query("SELECT user_id, max(score) AS score, count(*) AS reasons_count, count(DISTINCT lang) AS sources_count FROM (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS user_id, lang, n_chars % 1001 / 10 AS score FROM documents) WHERE score >= 70 GROUP BY 1")
def registry_collect(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("user_id"), F.col("lang").alias("content_id"), (F.col("n_chars") % 1001 / 10).alias("score"))
    return registry.collected(docs).select("user_id", "score", F.size("reasons").cast("long").alias("reasons_count"), F.size("sources").cast("long").alias("sources_count"))


@query(REG_SQL + " SELECT user_id, CASE WHEN added_by = 'manual' THEN 'added by hand' ELSE 'score ' || printf('%.1f', score) || ' in the analysis' END AS reason FROM reg")
def registry_reasons(spark, sf_dir):
    return merged_registry(spark, sf_dir).select("user_id", registry.reason_text(F.col("added_by"), F.col("score")).alias("reason"))


@query(f"WITH {SCORED} SELECT user_id, CASE WHEN user_id = (SELECT min(doc_id) FROM labels WHERE toxic = 1) THEN 99 ELSE score END AS score FROM scored")
def report_merge_one(spark, sf_dir):
    """The verdict on one user replaces the score of its report row only."""
    one = A.verdicts(spark, sf_dir).filter("type_id = 1").agg(F.min("user_id").alias("user_id")).withColumn("score", F.lit(99.0))
    return scoring.merged_verdicts(A.scored_users(spark, sf_dir), one).select("user_id", "score")

"""Registered queries: landed payloads and files. Payloads are derived from the tables by Spark, then read as landed data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.registered import CONTENTS, TEXTS, USERS, query
from tidewatch.sources import adapters as A
from tidewatch.sources import files, normalize
from tidewatch.sources.storage import shared_dir


def landed(rows, name: str, form: str = "text") -> str:
    """Writes rows as landed files and returns their folder."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.format(form).save(path)
    return path


def content_payload():
    return F.to_json(
        F.struct(
            F.concat(F.lit("BV"), F.col("content_id").cast("string")).alias("bvid"), F.col("content_id").alias("aid"), F.col("source").alias("title"), F.concat(F.lit("http://pic/"), F.col("content_id").cast("string")).alias("pic"),
            F.struct(F.col("owner_id").alias("mid"), F.lit("owner").alias("name")).alias("owner"), F.struct(F.floor("view_count").cast("long").alias("view")).alias("stat"), F.array(F.struct(F.col("status").alias("tag_name"))).alias("tags"),
        )
    )


@query(f"WITH {CONTENTS} SELECT 'BV' || content_id AS content_id, source AS title, owner_id, 'owner' AS owner_name, CAST(floor(view_count) AS BIGINT) AS view_count FROM contents")
def read_contents(spark, sf_dir):
    rows = A.contents(spark, sf_dir)
    body = content_payload()
    line = F.when(F.col("status") == "F", F.concat(F.lit('{"video_info":'), body, F.lit("}"))).otherwise(body)
    return files.read_contents(spark, landed(rows.select(line.alias("value")), "contents-json"), lines=True)


@query("SELECT (conv_id + 1) * 100 + turn AS comment_id, CASE WHEN turn = 0 THEN 0 ELSE (conv_id + 1) * 100 END AS root_id, text, role AS user_name FROM conversations")
def read_comments(spark, sf_dir):
    """One file line for each thread: an array, or an object with comments or replies."""
    rows = A.threads(spark, sf_dir)
    thread = F.floor(F.col("comment_id") / 100).cast("long")
    each = F.struct(F.col("comment_id").alias("rpid"), F.col("root_id").alias("root"), F.col("parent_id").alias("parent"), F.col("text").alias("content"), F.col("user_name").alias("uname"))
    lists = rows.groupBy(thread.alias("thread")).agg(F.to_json(F.array_sort(F.collect_list(each))).alias("list"))
    kind = F.col("thread") % 3
    body = F.when(kind == 0, F.col("list")).when(kind == 1, F.concat(F.lit('{"comments":'), "list", F.lit("}"))).otherwise(F.concat(F.lit('{"replies":'), "list", F.lit("}")))
    path = landed(lists.select(body.alias("value")), "comments-json")
    return files.read_comments(spark, path, whole_files=False).select("comment_id", "root_id", "text", "user_name")


@query("SELECT CAST((conv_id + 1) // 50 AS VARCHAR) AS key, (conv_id + 1) * 100 + turn AS comment_id, text, role AS user_name FROM conversations WHERE (conv_id + 1) // 50 <> 1")
def read_landed_arrays(spark, sf_dir):
    """Files of an array each (or an object with one), for 50 threads, by the format of landed files; one file is left out by its name."""
    from tidewatch.sources import landed as source

    source.register(spark)
    rows = A.threads(spark, sf_dir)
    part = F.floor(F.col("comment_id") / 5_000).cast("long")
    each = F.struct(F.col("comment_id").alias("rpid"), F.col("text").alias("content"), F.col("user_name").alias("uname"))
    lists = rows.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(each)).alias("list"))
    body = F.when(F.col("part") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"code": 0, "comments": '), "list", F.lit("}")))
    path = shared_dir(spark, "landed-arrays")
    files.write_named(lists.select(body.alias("value"), F.concat(F.col("part").cast("string"), F.lit("_comments")).alias("name")), path)
    value = F.from_json("value", "rpid long, content string, uname string")
    found = spark.read.format("landed").load(path).filter("key <> '1' AND error IS NULL").select("key", value.alias("c"))
    return found.select("key", F.col("c.rpid").alias("comment_id"), F.col("c.content").alias("text"), F.col("c.uname").alias("user_name"))


@query(f"WITH {USERS} SELECT user_id, name, sign, level, follower FROM users WHERE user_id IN (SELECT l_suppkey FROM lineitem)")
def read_users(spark, sf_dir):
    rows = A.users(spark, sf_dir).select(F.col("user_id").alias("mid"), "name", F.col("avatar").alias("face"), "sign", "level", "follower", "following")
    wanted = A.comments_rel(spark, sf_dir).select("user_id").distinct()
    return files.read_users(spark, landed(rows, "users-json", "json"), wanted).select("user_id", "name", "sign", "level", "follower")


@query(f"WITH {TEXTS} SELECT CAST(comment_id AS VARCHAR) AS post_id, user_id, text, comment_id % 3 = 0 AS is_repost FROM texts WHERE content_id <> 'en'")
def read_posts(spark, sf_dir):
    """Files by user: the id comes from the folder name."""
    rows = A.posts(spark, sf_dir).select(F.col("post_id").cast("string").alias("dynamic_id"), F.col("text").alias("content"), "is_repost", "user_id")
    path = shared_dir(spark, "posts-json")
    files.write_rows(rows, path, "json", ["user_id"])
    return files.read_posts(spark, path)


@query(f"WITH {TEXTS} SELECT CAST(comment_id AS VARCHAR) AS post_id, user_id, text, comment_id % 3 = 0 AS is_repost FROM texts WHERE content_id <> 'en'")
def read_named_posts(spark, sf_dir):
    """Files with an array of a user's posts: the id comes from the file name. A file has the posts of up to 500 numbers."""
    each = F.struct(F.col("post_id").cast("string").alias("dynamic_id"), F.col("text").alias("content"), "is_repost")
    lists = A.posts(spark, sf_dir).groupBy("user_id", F.floor(F.col("post_id") / 500).cast("string").alias("part")).agg(F.to_json(F.collect_list(each)).alias("value"))
    path = shared_dir(spark, "named-posts")
    files.write_named(lists.select("value", F.concat(F.col("user_id").cast("string"), F.lit("_posts_"), "part").alias("name")), path)
    return files.read_posts(spark, path, by_file=True)


@query(f"WITH {USERS} SELECT 'BV' || user_id AS content_id, user_id AS owner_id, name AS title FROM users")
def read_named_contents(spark, sf_dir):
    """Files that do not name their content: the key comes from the file name."""
    rows = A.users(spark, sf_dir)
    path = shared_dir(spark, "named-contents")
    keyed = rows.select(F.to_json(F.struct(F.col("user_id").alias("owner_mid"), F.col("name").alias("title"))).alias("value"), F.concat(F.lit("BV"), F.col("user_id").cast("string")).alias("name"))
    files.write_named(keyed, path, folders=1_024)
    return files.read_contents(spark, path).select("content_id", "owner_id", "title")


@query("SELECT count(*) FILTER (user_id % 7 <> 0) AS readable, count(*) FILTER (user_id % 7 = 0) AS quarantined FROM events")
def quarantine_corrupt(spark, sf_dir):
    """Lines that break off are set aside, the others are read."""
    rows = A.comments_time(spark, sf_dir)
    body = F.to_json(F.struct("comment_id", "user_id"))
    line = F.when(F.col("user_id") % 7 == 0, F.expr("substring(to_json(struct(comment_id, user_id)), 1, 12)")).otherwise(body)
    good, bad = files.split_corrupt(spark, landed(rows.select(line.alias("value")), "lines-json"), "comment_id long, user_id long")
    path = shared_dir(spark, "quarantine")
    files.quarantine(bad, path)
    bad = spark.read.parquet(path).filter("file IS NOT NULL AND found_at IS NOT NULL")
    return good.agg(F.count("*").alias("readable")).withColumn("quarantined", bad.agg(F.count("*").alias("n")).scalar())


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'blocked' ELSE 'not logged in' END AS error, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS mid FROM orders")
def unwrap_envelope(spark, sf_dir):
    code = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", -412).otherwise(-101)
    rows = A.contents(spark, sf_dir).select("content_id", F.to_json(F.struct(code.alias("code"), F.struct(F.col("owner_id").alias("mid")).alias("data"))).alias("payload"))
    return normalize.unwrap_envelope(rows).select(F.col("content_id").alias("id"), "error", F.get_json_object("data", "$.mid").alias("mid"))


@query(f"WITH {CONTENTS} SELECT 'BV' || content_id AS content_id, owner_id, CAST(floor(view_count) AS BIGINT) AS view_count, 0 AS reply_count, 'https://pic/' || content_id AS pic, status AS tag, 'hot' AS source FROM contents")
def normalize_content(spark, sf_dir):
    rows = normalize.normalize_content(A.contents(spark, sf_dir).select(content_payload().alias("data")))
    return rows.select("content_id", "owner_id", "view_count", F.col("reply_count").cast("int").alias("reply_count"), "pic", F.get("tags", F.lit(0)).alias("tag"), "source")


@query("SELECT event_id AS comment_id, 9 AS root_id, 9 AS parent_id, event_type AS text, user_id, CAST(floor(value) AS BIGINT) AS like_count, CAST(user_id % 7 AS INTEGER) AS level FROM events")
def normalize_comments(spark, sf_dir):
    """Pages of sub-replies: root and parent default to the given root."""
    rows = A.comments_time(spark, sf_dir)
    member = F.struct(F.col("user_id").alias("mid"), F.struct((F.col("user_id") % 7).alias("current_level")).alias("level_info"))
    reply = F.struct(F.col("comment_id").alias("rpid"), F.unix_seconds("created_at").alias("ctime"), F.col("like_count").alias("like"), F.struct(F.col("content_id").alias("message")).alias("content"), member.alias("member"))
    pages = rows.select(F.to_json(F.struct(F.array(reply).alias("replies"))).alias("data"))
    out = normalize.normalize_comments(pages, root=F.lit(9).cast("long"))
    return out.select("comment_id", F.col("root_id").cast("int").alias("root_id"), F.col("parent_id").cast("int").alias("parent_id"), "text", "user_id", "like_count", "level")


@query(f"WITH {USERS} SELECT user_id, name, sign, level, follower, coalesce(post_count, -1) AS post_count FROM users")
def normalize_user(spark, sf_dir):
    u = A.users(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("user_id").alias("mid"), "name", F.col("avatar").alias("face"), "sign", F.col("level").cast("string").alias("level"), "follower", "following", "post_count"))
    return normalize.normalize_user(u.select(payload.alias("data"))).select("user_id", "name", "sign", "level", "follower", "post_count")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id, coalesce(text, '') AS text, doc_id % 3 = 0 OR doc_id % 5 = 0 AS is_repost FROM documents")
def normalize_posts(spark, sf_dir):
    """Whole texts, in the module or in its description."""
    d = A.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    module = F.struct(F.when(key % 2 == 0, F.col("text")).alias("text"), F.struct(F.when(key % 2 == 1, F.col("text")).alias("text")).alias("desc"))
    payload = F.to_json(F.struct(key.cast("string").alias("id_str"), F.when(key % 3 == 0, "DYNAMIC_TYPE_FORWARD").otherwise("DYNAMIC_TYPE_WORD").alias("type"), F.when(key % 5 == 0, F.struct(key.alias("id"))).alias("orig"), F.struct(module.alias("module_dynamic")).alias("modules")))
    return normalize.normalize_posts(d.select(payload.alias("data"))).select("post_id", "text", "is_repost")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE coalesce(text, '') END AS text, doc_id % 3 = 0 AS is_repost FROM documents")
def normalize_posts_archive(spark, sf_dir):
    """The variant in which the archive's title comes first and a label names reposts."""
    d = A.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    archive = F.when(key % 4 == 0, F.struct(F.struct(F.col("source").alias("title")).alias("archive")))
    payload = F.to_json(F.struct(key.cast("string").alias("id_str"), F.when(key % 3 == 0, "转发了").otherwise("投稿了").alias("action"), F.struct(F.struct("text", archive.alias("major")).alias("module_dynamic")).alias("modules")))
    return normalize.normalize_posts(d.select(payload.alias("data")), archive_first=True).select("post_id", "text", "is_repost")


@query("SELECT o_custkey AS owner_id, 'owner' || o_custkey AS owner_name, o_orderkey AS aid, o_orderstatus AS title, 83 AS duration_s FROM orders")
def normalize_creator_listing(spark, sf_dir):
    rows = A.contents(spark, sf_dir)
    v = F.struct(F.col("content_id").alias("aid"), F.concat(F.lit("owner"), F.col("owner_id").cast("string")).alias("author"), F.col("owner_id").alias("mid"), F.col("status").alias("title"), F.lit("01:23").alias("length"))
    payload = F.to_json(F.struct(F.struct(F.array(v).alias("vlist")).alias("list")))
    return normalize.normalize_listing(rows.select(payload.alias("data"))).select("owner_id", "owner_name", "aid", "title", "duration_s")


@query("""SELECT page_id, nullif(regexp_extract(html, 'var t="([^"]*)"', 1), '') AS state FROM pages""")
def extract_page_state(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", normalize.page_state(F.col("html"), r'var t="([^"]*)"').alias("state"))


@query("SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN '{\"url\":' || CAST(to_json(url) AS VARCHAR) || ',\"note\":\"a }; \\\" </script> b\",\"in\":{\"n\":1}}' END AS state FROM pages")
def extract_initial_state(spark, sf_dir):
    """The state of every page, whose strings hold what ends it elsewhere; every fourth page has none."""
    pages = A.table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    url = F.regexp_extract(F.to_json(F.struct(F.col("url").alias("u"))), r'(?s)^\{"u":(.*)\}$', 1)
    state = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"url":'), url, F.lit(',"note":"a }; \\" </script> b","in":{"n":1}}'))
    end = F.when(kind == 0, ";(function(){var s;}());</script>").when(kind == 1, ";</script><p>};</p>").otherwise("</script>")
    return pages.select("page_id", normalize.initial_state(F.concat("html", F.when(kind != 3, F.concat(state, end)).otherwise(""))).alias("state"))


@query("SELECT page_id, 'n}' || page_id AS name, '' AS avatar, url AS sign, CAST(page_id % 7 AS INTEGER) AS level, page_id * 3 AS follower, CAST(page_id % 2 AS INTEGER) AS vip_status, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 3 AS INTEGER) END AS official_type, coalesce(CASE WHEN page_id % 5 <> 0 THEN 'a \"b\"' END, '') AS official_title, page_id % 11 AS upload_count FROM pages WHERE page_id % 4 <> 3")
def state_profiles(spark, sf_dir):
    """Profile rows from the state objects of the pages; every fourth page's user has no name."""
    key = F.col("page_id")
    official = F.when(key % 5 != 0, F.struct((key % 3).alias("type"), F.lit('a "b"').alias("title")))
    up = F.struct(F.when(key % 4 != 3, F.concat(F.lit("n}"), key.cast("string"))).otherwise("").alias("name"), F.col("url").alias("sign"), (key % 7).alias("level"), (key * 3).alias("follower"), F.struct((key % 2).alias("status")).alias("vip"), official.alias("official"), (key % 11).alias("archive_count"))
    html = F.concat("html", F.lit("<script>window.__INITIAL_STATE__="), F.to_json(F.struct(up.alias("up"))), F.lit(";</script>"))
    pages = A.table(spark, sf_dir, "pages").select("page_id", html.alias("html"), "url")
    return normalize.state_profile(pages.drop("url")).select("page_id", "name", "avatar", "sign", "level", "follower", "vip_status", "official_type", "official_title", "upload_count")


@query("SELECT page_id, CAST(page_id % 7 AS INTEGER) AS level, coalesce(nullif(split_part(url, '/', 3), ''), 'x') AS sign FROM pages")
def extract_page_fields(spark, sf_dir):
    """Profile fields behind each page's own markup."""
    pages = A.table(spark, sf_dir, "pages")
    host = F.coalesce(F.nullif(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("")), F.lit("x"))
    html = F.concat("html", F.lit('<meta name="description" content="about。'), host, F.lit('"><i class="user_level_'), (F.col("page_id") % 7).cast("string"), F.lit('">'))
    sign, level = normalize.page_fields(html)
    return pages.select("page_id", level.alias("level"), sign.alias("sign"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'BV0123456789' WHEN 1 THEN CAST(page_id AS VARCHAR) ELSE NULL END AS content_id FROM pages")
def extract_link_id(spark, sf_dir):
    key = F.col("page_id")
    link = F.when(key % 3 == 0, F.concat("url", F.lit("/BV0123456789"))).when(key % 3 == 1, F.concat(F.lit("https://x/oid="), key.cast("string"))).otherwise(F.split_part("url", F.lit("://"), F.lit(1)))
    return A.table(spark, sf_dir, "pages").select("page_id", normalize.link_id(link).alias("content_id"))


@query("SELECT event_id AS overlay_id, event_type AS content_id, event_type || ' <3' AS text, CAST(floor(event_id / 2.0 * 1000) AS BIGINT) AS progress_ms, 25 AS font_size FROM events WHERE event_id % 4 <> 0")
def parse_overlay_xml(spark, sf_dir):
    """Files of up to 500 elements; every fourth element has six attributes and is dropped, some carry further ones."""
    key = F.col("comment_id")
    attributes = F.concat_ws(",", (key / 2).cast("string"), F.lit("1"), F.lit("25"), F.lit("16777215"), F.lit("1700000000"), F.lit("0"), F.when(key % 4 != 0, "abcd"), F.when(key % 4 != 0, key.cast("string")))
    xml = F.concat(F.when(key % 3 == 0, '<d id="1" p="').otherwise('<d p="'), attributes, F.when(key % 5 == 0, '" user="x">').otherwise('">'), F.col("content_id"), F.lit(" <3</d>"))
    rows = A.comments_time(spark, sf_dir).groupBy("content_id", F.floor(key / 500).alias("part")).agg(F.concat(F.lit("<i>"), F.array_join(F.collect_list(xml), ""), F.lit("</i>")).alias("xml"))
    return normalize.parse_overlay_xml(rows).select("overlay_id", "content_id", "text", "progress_ms", "font_size")


@query("SELECT event_id AS overlay_id, CAST(user_id AS INTEGER) AS progress_ms, event_type AS text, CAST(user_id % 11 AS INTEGER) AS weight, CAST(event_id % 3 AS INTEGER) AS pool, CAST(event_id AS VARCHAR) AS id_text, 5 AS attributes FROM events")
def decode_overlay_segments(spark, sf_dir):
    rows = event_segments(spark, sf_dir).select(F.col("comment_id").cast("string").alias("path"), F.unhex("segment").alias("content"))
    return normalize.decode_overlay_segments(rows).select("overlay_id", "progress_ms", "text", "weight", "pool", "id_text", "attributes")


def event_segments(spark, sf_dir):
    """The events, each with a segment of one element as hexadecimal digits."""

    def varint(value):
        """Bytes of seven bits, as many as the number needs; all but the last with the high bit."""
        value = value.cast("long")
        left = [value] + [F.shiftright(value, 7 * i) for i in range(1, 10)]
        parts = [F.lpad(F.hex(left[i].bitwiseAND(127) + F.when(left[i + 1] > 0, 128).otherwise(0)), 2, "0") for i in range(9)]
        return F.concat(parts[0], *[F.when(left[i] > 0, parts[i]).otherwise("") for i in range(1, 9)])

    def text_field(tag, value):
        return F.concat(F.lit(tag), varint(F.octet_length(value)), F.hex(value.cast("binary")))

    numbers = [("08", F.col("comment_id")), ("10", F.col("user_id")), ("48", F.col("user_id") % 11), ("58", F.col("comment_id") % 3), ("68", F.lit(5).cast("long"))]
    body = F.concat(*[F.concat(F.lit(tag), varint(value)) for tag, value in numbers], text_field("3A", F.col("content_id")), text_field("62", F.col("comment_id").cast("string")))
    return A.comments_time(spark, sf_dir).withColumn("segment", F.concat(F.lit("0A"), varint(F.length(body) / 2), body))


@query("SELECT 'element' AS kind, event_id AS overlay_id, CAST(event_id // 200 AS VARCHAR) AS file, event_type AS text FROM events UNION ALL SELECT DISTINCT 'damage', NULL, CAST(event_id // 200 AS VARCHAR), 'cut value' FROM events WHERE event_id // 200 % 7 = 3")
def segment_files(spark, sf_dir):
    """Binary files of up to 200 elements, of which some have a cut one more at their end: all whole elements are read, and each
    damaged file stands in the quarantine with its bytes."""
    key = F.expr("comment_id DIV 200")
    lists = event_segments(spark, sf_dir).groupBy(key.alias("key")).agg(F.array_join(F.collect_list("segment"), "").alias("hex"))
    cut = F.when(F.col("key") % 7 == 3, "0A40").otherwise("")
    path = shared_dir(spark, "segment-files")
    files.write_named(lists.select(F.col("key").cast("string").alias("name"), F.unhex(F.concat("hex", cut)).alias("value")), path, ".bin")
    good, bad = normalize.split_segments(normalize.read_segments(spark, path))
    name = F.regexp_extract("path", r"([0-9]+)\.bin$", 1).alias("file")
    rows = good.select(F.lit("element").alias("kind"), "overlay_id", name, "text")
    return rows.unionByName(bad.filter("damaged IS NOT NULL").select(F.lit("damage").alias("kind"), F.lit(None).cast("long").alias("overlay_id"), name, F.col("damage").alias("text")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS seen_at, o_custkey AS like_count, CAST(o_orderkey AS VARCHAR) AS content_id, CASE WHEN o_orderkey % 3 <> 0 THEN left('said ' || o_orderstatus || repeat(' x', CAST(o_orderkey % 300 AS INTEGER)), 500) END AS body FROM orders")
def parse_history_card(spark, sf_dir):
    rows = A.contents(spark, sf_dir)
    said = F.when(F.col("content_id") % 3 != 0, F.concat(F.lit("said\n"), "status", F.repeat(F.lit(" x"), (F.col("content_id") % 300).cast("int")))).otherwise("y")
    card = F.concat(F.date_format("published_at", "yyyy/M/d H:m:s"), F.lit(" "), F.col("owner_id").cast("string"), F.lit("\n"), said, F.lit("\nhttps://x/av"), F.col("content_id").cast("string"))
    when, likes, content = normalize.parse_history_card(card)
    return rows.select(F.col("content_id").alias("id"), F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("seen_at"), likes.alias("like_count"), content.alias("content_id"), normalize.history_text(card).alias("body"))


@query("SELECT 'search:' || n_name || ':1-' || n_regionkey + 1 AS uri, 'search' AS kind, n_name AS value, CAST(unnest(generate_series(1, n_regionkey + 1)) AS INTEGER) AS page FROM nation")
def parse_seed_uri(spark, sf_dir):
    uri = F.concat(F.lit("search:"), F.col("n_name"), F.lit(":1-"), (F.col("n_regionkey") + 1).cast("string"))
    return normalize.parse_seed_uri(A.table(spark, sf_dir, "nation").select(uri.alias("uri")))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey END AS user_id FROM customer")
def parse_id_seed(spark, sf_dir):
    key = F.col("user_id")
    text = key.cast("string")
    seed = F.when(key % 4 == 0, text).when(key % 4 == 1, F.concat(F.lit('{"mid":'), text, F.lit("}"))).when(key % 4 == 2, F.concat(F.lit('{"uid":"'), text, F.lit('"}'))).otherwise(F.concat(F.lit("x"), text))
    return A.users(spark, sf_dir).select(key.alias("row_id"), normalize.parse_id_seed(seed).alias("user_id"))


@query("SELECT user_id FROM (SELECT unnest([c_custkey, c_nationkey]) AS user_id FROM customer) WHERE user_id > 0")
def split_ids(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select(F.concat((F.col("c_custkey")).cast("string"), F.lit(", \n"), F.col("c_nationkey").cast("string")).alias("ids"))
    return normalize.split_ids(rows, "ids")


@query(f"WITH {USERS} SELECT verify_type AS source, count(*) AS n, count(*) FILTER (user_id % 10 = 7) AS unreadable, CASE WHEN verify_type = 0 THEN 'OBJECT<level: VARIANT, mid: BIGINT, name: STRING>' ELSE 'OBJECT<extra: OBJECT<a: BIGINT>, level: BIGINT, mid: BIGINT, name: STRING>' END AS schema FROM users GROUP BY 1")
def payload_drift(spark, sf_dir):
    """Two sources of profiles: one writes some levels as text, the other has a field more; some payloads are cut."""
    key, first = F.col("user_id"), F.col("verify_type") == 0
    level = F.when(first & (key % 2 == 0), F.concat(F.lit('"'), F.col("level").cast("string"), F.lit('"'))).otherwise(F.col("level").cast("string"))
    body = F.concat(F.lit('{"mid": '), key.cast("string"), F.lit(', "name": "n", "level": '), level, F.when(first, "").otherwise(', "extra": {"a": 1}'), F.when(key % 10 == 7, "").otherwise("}"))
    rows = A.users(spark, sf_dir).select(F.col("verify_type").alias("source"), body.alias("payload"))
    return normalize.schema_drift(rows, "payload", ["source"])

"""Values worked out by hand from the rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import features, graph, keyed, registry, scoring, similarity, timeseries
from tidewatch.sources import normalize


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "wanted"), [("@alice hi [doge]  there\n", "hi there"), ("[doge]", None), ("　全角　空白 ", "全角 空白")])
def test_clean(spark, text, wanted):
    assert one(spark, X.clean_comment(F.col("t")), t=text) == wanted


def test_preprocess(spark):
    assert one(spark, X.preprocess(F.col("t")), t="a b [x] @bob c") == "abc"


@pytest.mark.parametrize(("text", "wanted"), [("1,234", 1234), ("", 0), ("1.2万", 12)])
def test_parse_count(spark, text, wanted):
    assert one(spark, X.parse_count(F.col("t")), t=text) == wanted


NAMES = {"bili_abcde": True, "bili_abcd": False, "用户12345": True, "123456": True, "12345": False, "abc12345": True, "MiXeD2024": False, "asdfgh": True, "ab_123": True, "": True, "bili_中文字符名": True}


@pytest.mark.parametrize("name", NAMES)
def test_garbled(spark, name):
    assert one(spark, X.garbled_name(F.col("n")), n=name) is NAMES[name]


@pytest.mark.parametrize(("number", "year"), [(999_999, 2010), (1_000_000, 2011), (1_199_999_999, 2024), (1_200_000_000, 2025)])
def test_year(spark, number, year):
    assert one(spark, features.id_year(F.col("i")), i=number) == year


@pytest.mark.parametrize(("days", "cc", "wanted"), [(29, 5, 0.9), (29, 4, 0.7), (90, 20, 0.6), (365, 5, 0.10), (1825, 1, 0.02)])
def test_account_age(spark, days, cc, wanted):
    raw = (datetime.date(2024, 2, 1) - datetime.timedelta(days)).isoformat()
    assert one(spark, features.account_age(F.col("r"), F.col("i"), F.col("l"), F.col("cc"), "2024-02-01"), r=raw, i=1, l=3, cc=cc) == pytest.approx(wanted)


@pytest.mark.parametrize(("follower", "following", "wanted"), [(49, 501, 0.9), (99, 301, 0.7), (199, 201, 0.4), (200, 201, 0.0)])
def test_follow_ratio(spark, follower, following, wanted):
    assert one(spark, features.follow_ratio(F.col("a"), F.col("b"), F.lit(True)), a=follower, b=following) == wanted


@pytest.mark.parametrize(("level", "cc", "wanted"), [(0, 2, 0.4), (3, 10, 0.3), (9, 5, 0.3)])
def test_level(spark, level, cc, wanted):
    assert one(spark, features.level_score(F.col("l"), F.col("cc")), l=level, cc=cc) == pytest.approx(wanted)


def test_avatar_verify(spark):
    score = features.avatar_verify(F.col("a"), F.col("v"), F.col("p"))
    assert one(spark, score, a="", v=-1, p=True) == 1.0
    assert one(spark, score, a="x/noface.jpg", v=0, p=True) == 0.5
    assert one(spark, score, a="", v=-1, p=False) == 0.3


def test_skeleton_without_profile(spark):
    hits = features.skeleton_hits(F.lit(None).cast("string"), F.col("n"), F.lit(None).cast("long"), F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"))
    assert one(spark, hits, n="alice") == 2


def test_signature(spark):
    score = features.signature_score(F.col("s"), F.col("p"), ["aa", "bb"], ["cc", "dd"], ["ee"])
    assert one(spark, score, s="aa bb cc dd ee", p=True) == pytest.approx(0.90)
    assert [one(spark, score, s=s, p=p) for s, p in (("x", False), ("", True), ("abc", True))] == [0.0, 0.05, 0.10]


@pytest.mark.parametrize(("soft", "total", "hard", "wanted"), [(2, 4, 0, 0.9), (3, 10, 0, 0.85), (2, 10, 0, 0.7), (1, 10, 0, 0.5), (0, 3, 0, 0.0), (1, 10, 1, 1.0)])
def test_spam(spark, soft, total, hard, wanted):
    texts = ["soft"] * soft + ["plain"] * (total - soft)
    texts[-1] = "hard" if hard else texts[-1]
    rows = spark.createDataFrame([(1, 1, t) for t in texts], "content_id long, user_id long, text string")
    assert features.spam_lexicon(rows, ["hard"], ["soft"]).first()["f15"] == wanted


def comments_at(spark, seconds, users=None):
    rows = [(1, users[i] if users else 1, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "content_id long, user_id long, created_at timestamp")


@pytest.mark.parametrize(("seconds", "wanted"), [([0, 60, 120, 180], 0.9), ([0, 60, 180], 0.6), ([0, 0, 0], 0.0), ([0, 5], 0.0)])
def test_regularity(spark, seconds, wanted):
    assert timeseries.time_regularity(comments_at(spark, seconds)).first()["f16"] == wanted


def test_burst(spark):
    seconds = [600 * i for i in range(9)] + [5400 + i for i in range(10)] + [5700]
    users = list(range(9)) + list(range(100, 110)) + [109]
    scores = {r["user_id"]: r["score"] for r in timeseries.burst_scores(comments_at(spark, seconds, users)).collect()}
    assert scores == {u: 1.0 for u in range(100, 110)}
    assert timeseries.burst_scores(comments_at(spark, [0, 600], [1, 2])).count() == 0


def test_registration_batches(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = spark.createDataFrame([(n, day(n)) for n in range(1, 10)] + [(100 + i, day(20)) for i in range(11)], "user_id long, day date")
    assert {(r["user_id"], r["score"]) for r in timeseries.registration_batches(rows).collect()} == {(100 + i, 1.0) for i in range(11)}


def test_timeline(spark):
    rows = timeseries.timeline(comments_at(spark, [43230, 45000 - 1, 45000])).collect()
    assert {(r["bin_start"], r["n"]) for r in rows} == {("2024-01-01 12:00", 2), ("2024-01-01 12:30", 1)}


def test_gap(spark):
    row = timeseries.inactivity_gap(comments_at(spark, [86400 * d for d in (0, 2, 39)])).first()
    assert (row["gap_days"], row["sudden"]) == (37, True)


def features_row(spark, **given):
    values = {f: 0.0 for f in scoring.WEIGHTS} | given
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{f} double" for f in values))


@pytest.mark.parametrize(("given", "score", "band"), [({"f12": 0.6}, 38.8, "medium"), ({"f12": 0.6, "f4": 0.5}, 57.8, "medium"), ({"f12": 0.6, "f4": 0.5, "f15": 1.0}, 81.8, "high")])
def test_score(spark, given, score, band):
    row = scoring.with_scores(features_row(spark, **given)).first()
    assert (row["score"], row["risk"]) == (score, band)


def test_weights_add_up():
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1)


def test_distribution(spark):
    rows = spark.createDataFrame([(1, s) for s in (0.0, 19.9, 20.0, 60.0, 100.0)], "content_id long, score double")
    assert [r["n"] for r in scoring.score_distribution(rows, "content_id").orderBy("bucket").collect()] == [2, 1, 0, 1, 1]


def test_fusion(spark):
    scored = spark.createDataFrame([(1, 80.0), (2, 80.0)], "user_id long, score double")
    first = spark.createDataFrame([(1, 2, 90.0), (2, 0, 90.0)], "user_id long, type_id int, confidence double")
    rows = {r["user_id"]: r for r in scoring.fuse_first(scored, first).collect()}
    assert (rows[1]["fused"], rows[2]["fused"]) == (82.5, 80.0) and rows[2]["review_note"] and not rows[1]["review_note"]
    deep = spark.createDataFrame([(1, 1, 100.0)], "user_id long, type_id int, confidence double")
    row = scoring.fuse_second(scored.filter("user_id = 1"), first, deep).first()
    assert (row["fused"], row["fused_risk"]) == (87.5, "high")


@pytest.mark.parametrize(("reply", "n"), [('```json\n{"results":[{"mid":7,"type_id":2}]}\n```', 1), ('{"mid":7}', 1), ("oops", 0), ('[{"mid":1},{"mid":2},{"type_id":3}]', 2)])
def test_parse_verdicts(spark, reply, n):
    assert scoring.parse_verdicts(spark.createDataFrame([(1, reply)], "doc long, reply string"), "doc").count() == n


def test_registry_merge(spark):
    schema = "user_id long, user_name string, avatar string, score double, added_by string, reasons array<struct<type:string,content_id:string,score:double>>, sources array<string>, notes string"
    old = spark.createDataFrame([(1, "", "", 50.0, "auto", [("e", "c", 50.0)], ["A"], "")], schema)
    new = spark.createDataFrame([(1, "", "x", 40.0, "manual", [("m", "c", 40.0)], ["B"], "n")], schema)
    row = registry.merge(old, new).first()
    assert (row["score"], row["risk"], row["added_by"], row["sources"], len(row["reasons"]), row["user_name"]) == (50.0, "medium", "manual", ["A", "B"], 2, "UID1")
    again = registry.merge(registry.merge(old, new).drop("risk"), new).first()
    assert (again["score"], again["sources"]) == (50.0, ["A", "B"])


def test_pending(spark):
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "user_id long")
    assert {r["user_id"] for r in keyed.pending(ids(1, 2, 3, 4), ids(1), ids(1, 2), "user_id").collect()} == {3, 4}


@pytest.mark.parametrize("partitions", [1, 7])
def test_components(spark, partitions):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 5)] + [(i, i + 1) for i in range(10, 60)], "a long, b long").repartition(partitions)
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert roots[3] == 1 and roots[5] == 4 and roots[60] == 10 and len(roots) == 56


def union_find(edges):
    """The smallest node that each node is connected with."""
    root = {}

    def top(n):
        root.setdefault(n, n)
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {n: top(n) for n in root}


@pytest.mark.parametrize("held", [10, 300, 1_000_000])
def test_components_like_union_find(spark, held):
    """A path, a star, random edges, repeated and self edges and nulls, with tasks that hold few nodes."""
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(400)] + [(1000, 1001 + i) for i in range(400)] + [tuple(rng.choices(range(2000, 2600), k=2)) for _ in range(350)] + [(7, 7), (5000, 5000), (7, 8)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 9000), (9001, None)], "a long, b long").repartition(5)
    assert {r["node"]: r["root"] for r in graph.components(frame, held).collect()} == union_find(edges)


def test_components_of_a_long_path_and_a_large_star(spark):
    path = spark.range(100_000).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    star = spark.range(200_000).select((F.col("id") + 500_000).alias("a"), F.lit(400_000).cast("long").alias("b"))
    found = graph.components(path.unionByName(star).repartition(8, F.xxhash64("a")), 20_000).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {r["root"]: r["n"] for r in found} == {0: 100_001, 400_000: 200_001}


def test_components_of_orders(spark):
    from tidewatch.plans.analysis import components_orders

    sf_dir = "/root/testdata/sf0.001"
    edges = [(r["l_orderkey"], -1 - r["l_suppkey"]) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()]
    assert {r["node"]: r["root"] for r in components_orders(spark, sf_dir).collect()} == union_find(edges)


def test_ratio_pairs(spark):
    rows = spark.createDataFrame([("abcd", "bcde", 0.75), ("abcde", "abxde", 0.8)], "a string, b string, w double")
    assert all(r["x"] == pytest.approx(r["w"]) for r in rows.select(similarity.ratio("a", "b").alias("x"), "w").collect())


def test_overlay_xml(spark):
    xml = '<i><d p="1.5,1,25,16777215,1700000000,0,abcd1234,99">hi</d><d p="1,1,25,1,1,0">short</d></i>'
    rows = normalize.parse_overlay_xml(spark.createDataFrame([("c", xml)], "content_id string, xml string")).collect()
    assert [(r["progress_ms"], r["overlay_id"], r["text"]) for r in rows] == [(1500, 99, "hi")]


def test_history_card(spark):
    when, likes, _ = normalize.parse_history_card(F.col("t"))
    frame = spark.createDataFrame([("2025/9/11 18:07:46 1",)], "t string").select(F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("w"), likes.alias("l"))
    assert tuple(frame.first()) == ("2025-09-11 18:07:46", 1)


def test_sentiment(spark):
    rows = spark.createDataFrame([(1, 1, t) for t in ("good", "good", "good", "plain")] + [(1, 2, "good")] * 2, "content_id long, user_id long, text string")
    scores = {r["user_id"]: r["f7"] for r in features.sentiment_extreme(rows, ["good"], ["bad"]).collect()}
    assert scores == {1: 0.5, 2: 0.0}


def test_replayed_upsert(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k long, v string, seq long")
    once = keyed.upsert(rows.limit(0), rows, ["k"])
    twice = keyed.upsert(once, rows, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "b", 2), (2, "c", 3)]


def test_joined_edges_take_little_memory():
    """A million edges of half a million nodes: as few numbers as a task holds at once, and no objects."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    edges = [pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 500_000, 10_000)), pa.array(-1 - rng.integers(0, 500, 10_000))], ["a", "b"]) for _ in range(100)]
    tracemalloc.start()
    found = sum(batch.num_rows for batch in graph.contraction(200_000)(iter(edges)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 400_000 and peak < 40_000_000, peak

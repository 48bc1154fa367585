"""Filter audit, chat formatting and bisector k-means: against plain loops, round trips, and odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import bisector_means, chat_format, filter_audit

# 11: filter audit

AUDITED = "doc_id long, text string, source string"
MARKS = "doc_id long, quality int, toxic int"


def plain_audit(rows, marks):
    """{(part, order, step): counts} by applying the filters one after the other, part by part."""
    good, toxic = ({d for d, *m in marks if d is not None and m[k] == 1} for k in (0, 1))
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    judged = []
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text), d is not None and d > first[text]), strict=True) if bad}
        judged.append((d, source or "", fails))
    out = {}
    for part in {p for _, p, _ in judged}:
        own, removals = [r for r in judged if r[1] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[2]]
                left = [r for r in left if c not in r[2]]
                removals[c] += len(gone)
                failing = [r for r in own if c in r[2]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[2] == {c} for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removals[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "delta#", "e", "ü", "日本", "50%", "|"] + [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 49, 50, 51, 200]))) for _ in range(40)] + ["", " \t\x0b\x0c\r\n", "A" * 100, "one " * 60, " ".join(f"u{i}" for i in range(60)), "x y z " * 20]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(300)]
    return rows + [(None, texts[0], "a"), (None, "", None), (7, rows[7][1], rows[7][2]), (7, texts[1], "b"), (400, None, None), (401, "Z" * 300_000, "long")]


@pytest.mark.parametrize("most_bytes", [filter_audit.MOST_BYTES, 0])
def test_audit_like_a_loop(spark, most_bytes):
    rows = audit_rows()
    marks = [(i, i % 3 % 2, i % 2) for i in range(0, 300, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1), (401, 1, None)]
    docs = spark.createDataFrame(rows, AUDITED).repartition(5).withColumns({c: F.lit("x") for c in ("part", "mask", "SAME", "quality", "n", "first_id")})
    found = filter_audit.filter_audit(docs, spark.createDataFrame(marks, MARKS).withColumn("text", F.lit(1)), most_bytes).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found} == plain_audit(rows, marks)
    assert len(found) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], AUDITED)
    assert filter_audit.filter_audit(none, spark.createDataFrame([], MARKS)).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None)], AUDITED), spark.createDataFrame([], MARKS)).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and all(r["kept"] == ("A" not in r["filter_order"][: r["step"]]) for r in one)


def test_sketch_clears_unique_texts_only(spark):
    """No repeated text is cleared, whichever tasks hold its rows, and nearly all unique ones are."""
    rows = spark.range(200_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("text_hash"), (F.col("id") % 10 == 0).alias("again")).repartition(7)
    n_cells = filter_audit.CELLS * 200_000
    tested = rows.select("again", filter_audit.repeat_test(rows, n_cells)("text_hash").alias("maybe")).groupBy("again").agg(F.avg(F.col("maybe").cast("int")).alias("share"))
    share = {r["again"]: r["share"] for r in tested.collect()}
    assert share[True] == 1 and share[False] < 0.02


# 12: chat formatting

TURNS = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> </s", "[[INST]", "[ROLE] x [/ROLE] y</s>", "\\", "<", "[", "", " ", "a </s", r"<\/s>", "é日本\n[/INST", "[/INST] ", " [/INST]"]


def chat_rows():
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool </s>[ROLE]", None]), rng.choice([*TRICKY, None]) if rng.random() < 0.7 else "".join(rng.choices(["[", "<", "\\", "/", "INST]", "ROLE]", "s>", " ", "x"], k=12))) for c in range(60) for t in range(rng.randint(1, 9))]
    return rows + [(None, 0, "user", "a null id"), (None, None, "assistant", "first"), (3, 0, "user", "same turn"), (3, 0, "user", "same turn"), (99, 0, "assistant", "z" * 300_000), *[(100, t, ["user", "assistant"][t % 2], f"turn {t} [INST]") for t in range(3_000)]]


def plain_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1], r[2].encode()))
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_come_back(spark):
    rows = chat_rows()
    turns = spark.createDataFrame(rows, TURNS).repartition(6).withColumns({c: F.lit("x") for c in ("piece", "header", "CONTENT", "n_turns")})
    formatted = chat_format.format_chats(turns)
    found = {r["conv_id"]: tuple(r[1:]) for r in chat_format.digests(formatted).collect()}
    assert {k: v[:4] for k, v in found.items()} == plain_chats(rows)
    lengths = {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert lengths == {k: v[4] for k, v in found.items()}


def test_template_and_mask(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "say </s>"), (1, 2, "assistant", "</s>"), (2, 0, "assistant", "é")]
    found = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(rows, TURNS).coalesce(1)).groupBy("conv_id").agg(F.concat_ws("", F.collect_list("formatted")).alias("text"), F.flatten(F.collect_list("loss_spans")).alias("spans")).collect()}
    assert found[1]["text"] == r"[ROLE] system [/ROLE] be brief</s>[INST] say <\/s> [/INST]<\/s></s>" and found[2]["text"] == "é</s>"
    assert [(s["start"], s["end"]) for s in found[2]["spans"]] == [(0, 2)]


def test_chats_of_nothing(spark):
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_text_between_turns_is_an_error():
    with pytest.raises(ValueError):
        list(chat_format.turns_of("[INST] a [/INST]stray"))


# 13: bisector k-means

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def plain_means(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, c, d in found if c == n) for n in range(k)}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("first", [1.0, 200_000.0])
def test_means_like_a_loop(spark, first):
    """Also with components beyond 64-bit products."""
    rng = np.random.default_rng(13)
    rows = [(i, (rng.normal(size=64) + i % 5).tolist()) for i in range(150)]
    for _, vector in rows[:9]:
        vector[0] *= first
    rows += [(None, rows[0][1]), (3, rows[4][1]), (3, rows[3][1]), (200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [None] * 64), (204, [float("inf")] * 64), (205, [-0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("cluster", "HASH", "vector", "totals")})
    assert sorted((tuple(r) for r in bisector_means.cluster(df).collect()), key=str) == plain_means(rows)


def test_ties_go_to_the_smaller_number():
    """Vectors on bisectors, and equal centroids."""
    points = [[x, y] for x in range(-3, 4) for y in range(-3, 4)]
    centroids = [[2, 0], [0, 2], [-2, 0], [0, -2], [0, 2], [1, 1], [3, 3], [2, 0]]
    winner, distance = bisector_means.Bisectors(centroids).nearest(np.array(points))
    wanted = [min(((px - x) ** 2 + (py - y) ** 2, n) for n, (x, y) in enumerate(centroids)) for px, py in points]
    assert list(zip(distance.tolist(), winner.tolist(), strict=True)) == wanted


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [1.5] * 64), (2, [1.5] * 64)]
    assert sorted((tuple(r) for r in bisector_means.cluster(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == plain_means(rows)
    empty = bisector_means.cluster(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

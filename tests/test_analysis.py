"""The analysis of all contents against a plain recomputation from its features, and those against clusters by all pairs."""

import difflib

from tidewatch.operators import similarity
from tidewatch.plans import analysis
from tidewatch.sources import adapters as A

SF_DIR = "/root/testdata/sf0.001"
KEYS = ("content_id", "user_id")
#: The rules of the survey, written down once more.
WEIGHTS = {"f1": 8, "f2": 6, "f3": 13, "f4": 8, "f5": 11, "f6": 11, "f7": 2, "f8": 6, "f12": 23, "f14": 3, "f15": 4, "f16": 2, "f18": 3}


def plain_shares(spark):
    """f5 of each content and user: share of comments in clusters of three or more, by the ratio of all pairs."""
    comments = analysis.with_times(spark, SF_DIR)
    bodies = [(r["content_id"], r["comment_id"], r["body"]) for r in similarity.bodies(comments).orderBy("comment_id").collect()]
    root = {i: i for _, i, _ in bodies}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (content, i, a) in enumerate(bodies):
        for other, j, b in bodies[k + 1 :]:
            if content == other and top(i) != top(j) and min(len(a), len(b)) * 1.25 >= 0.75 * max(len(a), len(b)):
                matcher = difflib.SequenceMatcher(None, a, b)
                if matcher.quick_ratio() >= 0.75 and matcher.ratio() >= 0.75:
                    low, high = sorted((top(i), top(j)))
                    root[high] = low
    sizes = {}
    for i in root:
        sizes[top(i)] = sizes.get(top(i), 0) + 1
    hits = {}
    for r in comments.select(*KEYS, "comment_id").collect():
        own = hits.setdefault((r["content_id"], r["user_id"]), [0, 0])
        own[0] += r["comment_id"] in root and sizes[top(r["comment_id"])] >= 3
        own[1] += 1
    return {k: n / all_ for k, (n, all_) in hits.items()}


def plain_score(f):
    fifths = round(f["f12"] * 5)
    bonus = {5: 0.35, 4: 0.30, 3: 0.25, 2: 0.20}.get(fifths, 0.0)
    bonus += 0.15 * (f["f12"] >= 0.5 and f["f4"] >= 0.25) + 0.2 * (f["f14"] >= 1) + 0.2 * (f["f15"] >= 1) + 0.15 * (f["f18"] >= 0.5)
    return 100 * min(1.0, sum(f[name] * w / 100 for name, w in WEIGHTS.items()) + bonus)


def test_features_and_scores_of_the_analysis(spark):
    rows = {(r["content_id"], r["user_id"]): r for r in analysis.user_features_with_clusters(spark, SF_DIR).collect()}
    shares = plain_shares(spark)
    assert shares.keys() == rows.keys() and any(shares.values())
    assert all(abs(rows[k]["f5"] - v) < 1e-12 for k, v in shares.items())
    found = {r["content_id"]: r for r in analysis.analyze_all(spark, SF_DIR).collect()}
    assert found.keys() == {c for c, _ in rows}
    for content, r in found.items():
        scores = {u: plain_score(f) for (c, u), f in rows.items() if c == content}
        assert r["total_users"] == len(scores) and abs(r["avg_score"] - sum(scores.values()) / len(scores)) < 0.11
        near = lambda limit, s=scores: sum(abs(v - limit) < 0.06 for v in s.values())  # noqa: E731  rounding may go either way
        assert abs(r["high"] - sum(v >= 60 for v in scores.values())) <= near(60)
        assert abs(r["low"] - sum(v < 30 for v in scores.values())) <= near(30) and r["high"] + r["medium"] + r["low"] == len(scores)
        best = sorted(scores, key=lambda u: (-round(scores[u], 1), u))[:20]
        assert [s["rank"] for s in r["suspects"]] == list(range(1, len(best) + 1))
        for s, u in zip(r["suspects"], best, strict=True):
            assert abs(s["score"] - scores[s["user_id"]]) < 0.051 and abs(s["score"] - scores[u]) < 0.11


def test_report_documents_hold_the_analysis(spark):
    wanted = {r["content_id"]: r for r in analysis.analyze_all(spark, SF_DIR).collect()}
    for r in analysis.report_document(spark, SF_DIR).collect():
        own = wanted[r["content_id"]]
        assert all(r[c] == own[c] for c in ("total_users", "high", "medium", "low", "avg_score", "n_clusters", "summary", "suspects"))
        assert [e["user_id"] for e in r["export"] or []][:20] == [s["user_id"] for s in own["suspects"] if s["score"] >= 70]
    assert A.comments_text(spark, SF_DIR).count()

"""Similar comments, clusters, dedup and digests against plain loops over all pairs."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import similarity

COMMENTS = "content_id string, comment_id long, user_id long, text string, seq long"


def comments_of(spark, texts):
    return spark.createDataFrame([("c", i, 1, t, i) for i, t in enumerate(texts)], COMMENTS)


def edited(rng, base, edits):
    own = list(base)
    for at in rng.sample(range(len(base)), edits):
        own[at] = rng.choice("ABCDEFGHIJ")
    return "".join(own)


def short_comments(seed=1):
    """Two contents of short comments: edits of common texts, chains of edits, repeated and random texts."""
    rng, rows = random.Random(seed), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choice(letters) for _ in range(60))
    chain = "".join(rng.choice(letters) for _ in range(40))
    for content in ("x", "y"):
        texts = [base] + [edited(rng, base, 8) for _ in range(39)]
        own = chain
        for _ in range(8):
            texts.append(own)
            own = edited(rng, own, 6)
        texts += ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 30))) for _ in range(30)] + [base, chain, "ok", "", None, base[:30]]
        rng.shuffle(texts)
        for text in texts:
            rows.append((content, len(rows), len(rows) % 7, text, len(rows)))
    return rows


def texts_in_order(rows):
    """The first comment of each text that is long enough to compare, by content."""
    out = {}
    for content, id_, _, text, _ in rows:
        if text and len(text) >= similarity.MIN_LENGTH:
            out.setdefault(content, {}).setdefault(text, id_)
    return {content: [(i, t) for t, i in texts.items()] for content, texts in out.items()}


def all_pairs(rows, threshold):
    found = {}
    for content, reps in texts_in_order(rows).items():
        for i in range(len(reps)):
            for j in range(i + 1, len(reps)):
                value = difflib.SequenceMatcher(None, reps[i][1], reps[j][1]).ratio()
                if value >= threshold:
                    found[content, reps[i][0], reps[j][0]] = value
    return found


def clusters(rows, threshold, least):
    """The cluster of each comment in a cluster of ``least`` or more."""
    first = {(content, text): i for content, reps in texts_in_order(rows).items() for i, text in reps}
    root = {i: i for i in first.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in all_pairs(rows, threshold):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    own = {id_: find(first[content, text]) for content, id_, _, text, _ in rows if (content, text) in first}
    sizes = {c: sum(v == c for v in own.values()) for c in own.values()}
    return {i: (c, sizes[c]) for i, c in own.items() if sizes[c] >= least}


@pytest.mark.parametrize("block", [7, 1_024])
def test_similar_pairs_are_all_pairs(spark, block):
    rows = short_comments()
    found = {(r["content_id"], r["a"], r["b"]): r["ratio"] for r in similarity.similar_pairs(spark.createDataFrame(rows, COMMENTS), block=block).collect()}
    wanted = all_pairs(rows, 0.75)
    assert len(wanted) > 800 and found.keys() == wanted.keys() and all(found[k] == pytest.approx(v) for k, v in wanted.items())


def test_clusters_participation_and_details(spark):
    rows = short_comments(2)
    frame = spark.createDataFrame(rows, COMMENTS)
    members = similarity.cluster_members(frame)
    wanted = clusters(rows, 0.75, 3)
    assert {r["comment_id"]: (r["cluster_id"], r["size"]) for r in members.collect()} == wanted
    shares = {(r["content_id"], r["user_id"]): r["f5"] for r in similarity.participation(frame, members).collect()}
    for content, user in {(r[0], r[2]) for r in rows}:
        own = [r[1] for r in rows if (r[0], r[2]) == (content, user)]
        assert shares[content, user] == pytest.approx(sum(i in wanted for i in own) / len(own))
    details = similarity.cluster_details(frame, members, top=2, most=5).collect()
    by_id = {r[1]: r for r in rows}
    for content in ("x", "y"):
        sizes = {c: n for i, (c, n) in wanted.items() if by_id[i][0] == content}
        best = sorted(sizes, key=lambda c: (-sizes[c], c))[:2]
        own = sorted((r["cluster_rank"], r["member_rank"], r["comment_id"], r["user_id"], r["text"]) for r in details if r["content_id"] == content)
        assert own == [(k, m, i, by_id[i][2], by_id[i][3]) for k, c in enumerate(best, 1) for m, i in enumerate(sorted(i for i, v in wanted.items() if v[0] == c)[:5], 1)]


def test_dedup_removes_what_resembles_a_kept_text(spark):
    rows = short_comments(3)
    wanted = {i for _, i, _, t, _ in rows if not t or len(t) < similarity.MIN_LENGTH}
    pairs = all_pairs(rows, 0.80)
    for content, reps in texts_in_order(rows).items():
        kept = []
        for i, _ in reps:
            if not any((content, k, i) in pairs for k in kept):
                kept.append(i)
        wanted |= set(kept)
    found = [r["comment_id"] for r in similarity.near_dup_dedup(spark.createDataFrame(rows, COMMENTS)).collect()]
    assert sorted(found) == sorted(wanted)


def test_a_removed_text_removes_nothing(spark):
    rows = [("c", i, 1, t, i) for i, t in enumerate(["a" * 20, "a" * 16 + "b" * 4, "a" * 12 + "b" * 8])]
    assert set(all_pairs(rows, 0.80)) == {("c", 0, 1), ("c", 1, 2)}
    assert sorted(r["comment_id"] for r in similarity.near_dup_dedup(spark.createDataFrame(rows, COMMENTS)).collect()) == [0, 2]


@pytest.mark.parametrize(("length", "signs"), [(150, 3000), (198, 26), (205, 26), (210, 3000), (300, 3000), (300, 60), (480, 3000), (480, 26), (1500, 40)])
def test_pairs_of_any_length_are_found(spark, length, signs):
    """Edited copies at and around the threshold, of texts of large and small alphabets; ratios by all pairs."""
    rng, rows = random.Random(length + signs), []
    weights = [1 / (k + 1) for k in range(signs)]
    text = lambda n: rng.choices(range(signs), weights if signs < 100 else None, k=n)
    for share in (0.0, 0.04, 0.08, 0.12, 0.16, 0.2, 0.24, 0.28):
        base = text(length)
        for own in (base, list(base)):
            for at in rng.sample(range(length), int(share * length)) if own is not base else ():
                own[at] = text(1)[0]
            cut = rng.randint(0, 8)
            rows.append(("c", len(rows), 1, "".join(chr(0x4E00 + c) for c in own[cut:]), len(rows)))
    rows.append(("c", len(rows), 1, chr(0x4E00) * length, len(rows)))
    rows.append(("c", len(rows), 1, chr(0x4E00) * (length - 9) + "x", len(rows)))
    wanted = all_pairs(rows, 0.75)
    found = {(r["content_id"], r["a"], r["b"]): r["ratio"] for r in similarity.similar_pairs(spark.createDataFrame(rows, COMMENTS)).collect()}
    assert wanted and found == pytest.approx(wanted)


def test_bounds_keep_all_pairs_of_documents(spark):
    """All pairs of the smallest table's documents by the ratio alone."""
    from tidewatch.sources.adapters import comments_text

    docs = comments_text(spark, "/root/testdata/sf0.001")
    bodies = {(r["content_id"], r["rep"]): r["body"] for r in similarity.representatives(similarity.bodies(docs)).collect() if len(r["body"]) < 4_000}
    found = {(r["content_id"], r["a"], r["b"]) for r in similarity.similar_pairs(docs).collect()}
    fast = lambda a, b: min(len(a), len(b)) * 1.25 >= 0.75 * max(len(a), len(b)) and difflib.SequenceMatcher(None, a, b).quick_ratio() >= 0.75 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.75
    wanted = {(c, i, j) for (c, i), a in bodies.items() for (d, j), b in bodies.items() if c == d and i < j and fast(a, b)}
    assert {p for p in found if (p[0], p[1]) in bodies and (p[0], p[2]) in bodies} == wanted


def test_ratio_ends_early_only_below_the_threshold():
    rng = random.Random(1)
    for _ in range(1_500):
        signs, length = rng.choice([3, 5, 30, 2000]), rng.choice([1, 5, 40, 150, 230, 400])
        a = [chr(97 + rng.randrange(signs)) for _ in range(length)]
        b = list(a)
        for _ in range(rng.randint(0, length // 2)):
            b[rng.randrange(length)] = chr(97 + rng.randrange(signs))
        a, b = "".join(a[rng.randint(0, length // 6) :]), "".join(b)
        wanted = difflib.SequenceMatcher(None, a, b).ratio()
        assert similarity.ratio_from(a, b, 0.75) == (wanted if wanted >= 0.75 else None)


def test_bags_of_very_long_texts_do_not_overflow():
    bags, _ = similarity.character_bags(["x" * 40_000, "y" * 3_000_000])
    assert bags.sum(1).tolist() == [40_000, 3_000_000]


def test_long_chains_are_settled_in_order(spark):
    """A chain of 100,000 in which every other one goes, beside random pairs, as a loop does it."""
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100_000)] + sorted({tuple(sorted(rng.sample(range(200_000, 200_400), 2))) for _ in range(900)})
    gone = set()
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if a not in gone:
            gone.add(b)
    pairs = spark.createDataFrame([(a, b, b) for a, b in edges], "earlier long, later long, seq long").repartition(6)
    assert {r["node"] for r in similarity.kept_in_order(pairs).collect()} == gone


def test_whole_texts_are_compared(spark):
    head, one, other = ("".join(chr(97 + (i * i * k + i // 7) % 26) for i in range(n)) for k, n in ((1, 600), (3, 900), (5, 900)))
    rows = comments_of(spark, [head + one, head + other, "ok", "ok", None, head + one])
    assert sorted(r["comment_id"] for r in similarity.near_dup_dedup(rows).collect()) == [0, 1, 2, 3, 4]
    shared = "the same opening of two hundred characters ".replace(" ", "") * 8
    assert similarity.templating(comments_of(spark, [shared + one, shared + other])).count() == 0


def test_templating_like_a_loop(spark):
    rows = short_comments(4)
    found = {(r["content_id"], r["user_id"]): (r["n_pairs"], r["mean_ratio"], r["templated"], r["examples"]) for r in similarity.templating(spark.createDataFrame(rows, COMMENTS)).collect()}
    wanted = {}
    for key in {(r[0], r[2]) for r in rows}:
        texts = [r[3] for r in rows if (r[0], r[2]) == key and r[3] and len(r[3]) >= similarity.MIN_LENGTH]
        pairs = [(texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, min(i + 10, len(texts)))]
        near = [(v, a[:50] + " / " + b[:50]) for a, b in pairs if (v := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.60]
        if near:
            mean = sum(v for v, _ in near) / len(near)
            wanted[key] = (len(near), pytest.approx(round(mean, 6), abs=2e-6), mean >= 0.70, [t for _, t in near[:2]])
    assert found.keys() == wanted.keys() and all(found[k] == wanted[k] for k in wanted)


def test_digest_like_a_loop(spark):
    rows = short_comments(5)
    frame = spark.createDataFrame(rows, COMMENTS)
    found = {r["user_id"]: r for r in similarity.comment_digest(frame, ["a"], ["b"]).collect()}
    kept = {r["comment_id"] for r in similarity.near_dup_dedup(frame).collect()}
    for user in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == user]
        lengths = [len(r[3]) for r in own if r[3] is not None]
        r = found[user]
        assert (r["n"], r["n_kept"]) == (len(own), sum(o[1] in kept for o in own))
        assert r["avg_length"] == pytest.approx(round(sum(lengths) / len(lengths), 1), abs=0.051)
        assert r["examples"] == [None if o[3] is None else o[3][:50] for o in own[:3]]
        assert r["n_unique"] == len({None if o[3] is None else o[3].strip() for o in own})


def test_empty_comments(spark):
    none = spark.createDataFrame([], COMMENTS)
    for df in (similarity.similar_pairs(none), similarity.cluster_members(none), similarity.near_dup_dedup(none), similarity.templating(none)):
        assert df.agg(F.count("*")).first()[0] == 0


def test_no_text_is_written_for_each_block_it_meets(spark):
    """Texts are shuffled and written as often at 4 blocks as at 32."""
    rng = random.Random(4)
    rows = [("c", i, 1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), i) for i in range(320)]
    reps = similarity.representatives(similarity.bodies(spark.createDataFrame(rows, COMMENTS))).localCheckpoint()
    written = []
    for block in (80, 10):
        before = sum(s.shuffleWriteBytes() for s in stages(spark))
        assert similarity.similar_pairs(reps, reps=reps, block=block).count() == 0
        written.append(sum(s.shuffleWriteBytes() for s in stages(spark)) - before)
    assert written[1] < 2 * written[0]


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(k) for k in range(found.size())]


def test_pairs_of_a_cell_are_dealt_in_lots(spark, monkeypatch):
    """The copies of one text, which lie in one cell, are checked by many tasks."""
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150))
    rows = [("c", i, 1, edited(rng, base, 12), i) for i in range(40)]
    monkeypatch.setattr(similarity, "CHECKED", 6_000)
    before = {s.stageId() for s in stages(spark)}
    found = {(r["a"], r["b"]): r["ratio"] for r in similarity.similar_pairs(spark.createDataFrame(rows, COMMENTS)).collect()}
    wanted = all_pairs(rows, 0.75)
    assert len(wanted) > 300 and found == pytest.approx({k[1:]: v for k, v in wanted.items()})
    most = [task.taskMetrics().get().shuffleReadMetrics().recordsRead() for s in stages(spark) if s.stageId() not in before for task in tasks(spark, s) if task.taskMetrics().isDefined()]
    assert sum(n > 10 for n in most) > 8


def tasks(spark, stage):
    found = spark.sparkContext._jsc.sc().statusStore().taskList(stage.stageId(), stage.attemptId(), 10_000)
    return [found.apply(k) for k in range(found.size())]


def test_subsequences_of_many_pairs_at_once():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc\u4e00d") for _ in range(n)) for n in (1, 5, 63, 64, 65, 127, 128, 129, 200, 300)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    wanted = [similarity.common_subsequence(texts[y], similarity.places_of(texts[x]), len(texts[x])) for x, y in zip(i, j, strict=True)]
    assert similarity.common_subsequences(texts, texts, i, j).tolist() == wanted


def test_ratios_at_a_threshold_are_those_of_the_library(spark):
    """Bounds and early ends lose no ratio at the threshold, and texts that differ are not compared to their end."""
    rng, rows = random.Random(8), []
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    for k in range(120):
        first = "".join(rng.choice(words) for _ in range(rng.choice([2, 20, 60, 120])))
        second = edited(rng, first, rng.randint(0, len(first) // 2)) if k % 3 else "".join(rng.choice(words) for _ in range(40))
        rows.append((k, first, second))
    frame = spark.createDataFrame(rows, "k long, a string, b string").withColumn("ratio", similarity.ratio_at(0.6)("a", "b"))
    found = {r["k"]: r["ratio"] for r in frame.collect()}
    wanted = {k: difflib.SequenceMatcher(None, a, b).ratio() for k, a, b in rows}
    assert found == {k: v if v >= 0.6 else None for k, v in wanted.items()} and 20 < sum(v >= 0.6 for v in wanted.values()) < 100


def test_templates_are_compared_by_many_tasks(spark):
    rows = [("c", i, i % 40, f"a text of user {i % 40} and no other", i) for i in range(400)]
    frame = similarity.templating(spark.createDataFrame(rows, COMMENTS))
    assert "REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString() and frame.count() == 40


def texts_around_seeds(rng, t):
    """Texts whose rare characters stand far apart, and copies that differ in the midst between those, so that what matches hangs on
    them on either side; others that are cut, turned, swapped or changed anywhere."""
    syllables = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([10, 40]))]
    between, texts = rng.choice([4, 9, 14, 20, 40]), []
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))[:n]
    for _ in range(5):
        parts = [text(rng.randint(between // 2, between * 3 // 2)) for _ in range(rng.randint(220, 700) // between)]
        base = "".join(p + rng.choice("XYZQ,.!;") for p in parts)
        texts.append(base)
        for k in range(4):
            share = rng.uniform(0.5, 1.1) * (1 - t)
            own = list(base)
            if k == 0:
                changed = [p[: int(len(p) * (1 - share) / 2)] + "k" * int(len(p) * share) + p[-int(len(p) * (1 - share) / 2) :] for p in parts]
                own = [p + base[sum(len(x) + 1 for x in parts[:i]) + len(parts[i])] for i, p in enumerate(changed)]
            elif k == 1:
                for at in rng.sample(range(len(own)), int(share * len(own))):
                    own[at] = rng.choice("abcX")
            elif k == 2:
                own = own[int(2 * share * len(own)) :] + list(text(rng.randint(0, 30)))
            else:
                at = rng.randrange(len(own))
                own = own[at:] + own[:at]
            texts.append("".join(own))
    texts = list(dict.fromkeys(t for t in texts if t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(12))
def test_runs_at_seeds_lose_no_pair(seed):
    """All pairs of the library, in one block or in two of which each has parts."""
    rng = random.Random(seed)
    t = rng.choice([0.6, 0.75, 0.8, 0.9])
    texts = texts_around_seeds(rng, t)
    wanted = {(i, j): r for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= t}
    whole = similarity.Texts(texts, np.arange(len(texts)))
    assert {(int(a), int(b)): r for a, b, r in similarity.similar(whole, whole, t)} == pytest.approx(wanted)
    rows = np.arange(len(texts))
    blocks, found = [whole.some(rows[:9]), whole.some(rows[9:])], []
    for i, earlier in enumerate(blocks):
        for j, later in enumerate(blocks):
            for part in range(2):
                own = later.some(np.arange(part, len(later.texts), 2))
                found += [(int(a), int(b)) for a, b, _ in similarity.similar(earlier, own, t, None if i == j else i < j)]
    assert sorted(found) == sorted(wanted)


def test_unlike_texts_are_not_compared(monkeypatch):
    """Of 400 texts of one language the copies are found without any step that takes each text with each other one."""
    rng = random.Random(9)
    syllables = ["".join(rng.choice("aeionrsthl") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    sentence = lambda: rng.choice("TAOWB") + "".join(rng.choice(syllables) for _ in range(rng.randint(6, 20))) + "."
    texts = ["".join(sentence() for _ in range(40)) for _ in range(400)]
    texts += [edited(rng, texts[k], 20) for k in range(5)]
    checked, ratio = [], similarity.ratio_from
    monkeypatch.setattr(similarity.Block, "matrix", None)
    monkeypatch.setattr(similarity, "ratio_from", lambda *pair: checked.append(pair) or ratio(*pair))
    whole = similarity.Texts(texts, np.arange(len(texts)))
    wanted = {(k, 400 + k) for k in range(5) if difflib.SequenceMatcher(None, texts[k], texts[400 + k]).ratio() >= 0.75}
    assert len(wanted) >= 3 and {(int(a), int(b)) for a, b, _ in similarity.similar(whole, whole, 0.75)} == wanted
    assert len(checked) < 200


@pytest.mark.parametrize("together", [1 << 18, 0])
def test_longest_blocks_are_those_of_the_library(monkeypatch, together):
    monkeypatch.setattr(similarity, "MATCHED", together)
    rng = random.Random(10)
    for _ in range(400):
        signs, length = rng.choice([3, 5, 30, 2000]), rng.choice([0, 1, 5, 40, 199, 200, 400, 900])
        a = [chr(97 + min(int(rng.expovariate(4 / signs)), signs)) for _ in range(length)]
        b = list(a)
        for _ in range(rng.randint(0, length // 3)):
            b[rng.randrange(length)] = chr(97 + rng.randrange(signs))
        a, b = "".join(a[rng.randint(0, length // 6) :]), "".join(b)
        wanted = difflib.SequenceMatcher(None, a, b).ratio()
        assert similarity.ratio_from(a, b, 0.4) == (wanted if wanted >= 0.4 else None)

"""Near duplicates against all pairs with a full alignment; stars, chains, large groups, boilerplate and odd rows."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, SF_DIR, docs_of
from tidewatch.llm import neardup
from tidewatch.llm.common import Workspace, words_of


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_classes(rows, threshold=0.8, align=longest_common):
    """Smallest id of each text's component, by alignments of all words: of all pairs of short texts, whether or not they share
    sketches, and of pairs of longer ones that share SHARED."""
    words = {i: words_of((t or "").encode()) for i, t in rows}
    sketches = {i: neardup.text_sketches(neardup.word_hashes(w)) for i, w in words.items()}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    text = dict(rows)
    for a, b in combinations(sorted(words), 2):
        if words[a] == words[b]:
            same = bool(words[a]) or (text[a] or "") == (text[b] or "")
        elif not words[a] or not words[b] or min(len(words[a]), len(words[b])) > 60 and neardup.shared_sketches(sketches[a], sketches[b]) < neardup.SHARED:
            same = False
        else:
            common = align(words[a], words[b])
            same = common / (len(words[a]) + len(words[b]) - common) >= threshold - 1e-12
        if same:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in words}


def edited(rng, base, edits):
    own = list(base)
    for at in rng.sample(range(len(base)), edits):
        own[at] = f"n{rng.randint(0, 10**6)}"
    return own


def near_copies(seed=3, groups=12, size=9):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((3, 30, 90)))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 999)}"] * rng.randint(0, 2)
                own = own or ["w"]
            rows.append((len(rows), " ".join(own)))
    return rows


def chain_and_boilerplate(seed=8):
    """Each text is an edit of the one before; others share a passage of 60 words and nothing else."""
    rng = random.Random(seed)
    own = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(25):
        rows.append((len(rows), " ".join(own)))
        own = edited(rng, own, 8)
    passage = [f"p{i}" for i in range(60)]
    for _ in range(40):
        rows.append((len(rows), " ".join(passage + [f"u{rng.randint(0, 10**6)}" for _ in range(60)])))
    return rows


def loose_families(seed=11):
    """Families of edits of a text that is not among them; most pairs of a family are below the threshold, so that hubs
    leave several components."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"w{g}-{i}" for i in range(100)]
        for _ in range(30):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randint(3, 9)))))
    return rows


def short_families(seed=21):
    """Edits of short texts of all lengths around the bounds of the further k-mers, from a small vocabulary."""
    rng, rows = random.Random(seed), []
    for n in (1, 2, 4, 5, 8, 9, 12, 13, 15, 16, 20, 40, 58, 60, 61, 74, 76):
        base = [f"w{rng.randint(0, 60)}" for _ in range(n)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 1 + n // 9)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 99)}"] * rng.randint(0, 1)
                own = own or ["w"]
            rows.append((len(rows), " ".join(own)))
    return rows


def classes_of(spark, rows):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}


@pytest.mark.parametrize("rows", [near_copies(), chain_and_boilerplate(), loose_families(), short_families()], ids=["groups", "chain and boilerplate", "loose families", "short families"])
def test_like_brute_force(spark, rows):
    assert classes_of(spark, rows) == brute_classes(rows)


def test_all_documents_like_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]

    def share(a, b):
        x, y = neardup.word_hashes(a), neardup.word_hashes(b)
        found = neardup.similarity(x, y, 0.5)
        return round(found * (len(a) + len(b)) / (1 + found))

    wanted = brute_classes(rows, align=share)
    assert classes_of(spark, rows) == wanted and len(set(wanted.values())) < len(rows)


@pytest.mark.parametrize(("n", "edits"), [(4, 0), (5, 0), (9, 1), (10, 1), (12, 1), (15, 1), (20, 2), (30, 3), (48, 5), (60, 6)])
def test_candidates_of_short_texts(n, edits):
    """Share of candidates among pairs with words replaced, or one word put in, at the threshold of similarity."""
    rng, found, pairs = random.Random(n), 0, 0
    for _ in range(300):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
        at = rng.randint(0, n)
        other = edited(rng, base, edits) if edits else base[:at] + ["new"] + base[at:]
        hashes = [neardup.word_hashes([w.encode() for w in t]) for t in (base, other)]
        assert neardup.similarity(*hashes, 0.8) >= 0.8 - 1e-9
        pairs += 1
        found += neardup.shared_sketches(*map(neardup.text_sketches, hashes)) >= neardup.SHARED
    assert found / pairs >= 0.99


def test_candidates_find_similar_pairs():
    """Share of pairs with a share of words replaced that have SHARED equal sketches."""
    rng = random.Random(6)
    for edits, least in ((6, 0.999), (12, 0.98), (16, 0.95)):
        found = 0
        for _ in range(300):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(160)]
            both = [neardup.sketches(neardup.kmers(neardup.word_hashes([w.encode() for w in t]))) for t in (base, edited(rng, base, edits))]
            found += (both[0] == both[1]).sum() >= neardup.SHARED
        assert found / 300 >= least


def test_a_large_group_of_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"n{rng.randint(0, 10**6)}"] + base[60:])) for i in range(600)] + [(1000 + i, " ".join(base)) for i in range(300)]
    found = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r["class_id"] for r in found} == {0} and {r["class_size"] for r in found} == {900}
    assert sum(r["is_first"] for r in found) == 1


def test_a_star_of_copies_that_resemble_only_their_original(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(250)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 20))) for i in range(1, 3_001)]
    words = {i: neardup.word_hashes(words_of(t.encode())) for i, t in rows}
    some = rng.sample(range(1, 3_001), 200)
    assert all(neardup.similarity(words[0], w, 0.8) for w in words.values())
    assert not any(neardup.similarity(words[a], words[b], 0.8) for a, b in combinations(some, 2))
    found = classes_of(spark, rows)
    assert sum(c == 0 for c in found.values()) >= 0.998 * len(rows)
    sketches = {i: neardup.sketches(neardup.kmers(w)) for i, w in words.items()}
    assert all(found[i] == 0 for i in words if (sketches[i] == sketches[0]).sum() >= neardup.SHARED)


def test_pairs_across_components_are_all_pairs(spark):
    rng, kept, n = random.Random(5), {}, neardup.SKETCHES
    for i in range(90):
        common = rng.sample(range(1, 50), 3)
        kept[b"%03d" % i] = ([rng.randint(1, 2) if k in (2, 7, 11) else common[k % 3] * 100 + k for k in range(n)], rng.randint(80, 120), b"%03d" % rng.randint(0, 60))
    contents = spark.createDataFrame([(node, size, sketch) for node, (sketch, size, _) in kept.items()], "node binary, n int, sketch array<long>")
    roots = spark.createDataFrame([(node, root) for node, (_, _, root) in kept.items()], "node binary, root binary")
    space = Workspace(spark)
    rows = neardup.mixed_set_rows(neardup.set_rows(contents, space), roots, space)
    wanted = set()
    for a, b in combinations(sorted(kept), 2):
        (s, x, r), (t, y, q) = kept[a], kept[b]
        if r != q and sum(u == v for u, v in zip(s, t, strict=True)) >= neardup.SHARED and min(x, y) >= 0.8 * max(x, y):
            wanted.add((a, b))
    for block in (7, 1_000):
        found = set()
        cells = {}
        for r in neardup.candidate_rows(rows, contents, 0.8, block).collect():
            cells.setdefault((r["sketch_no"], r["key"], r["i"], r["j"]), []).append(r)
        for own in cells.values():
            cell = neardup.Cell(pa.Table.from_pylist([{c: r[c] for c in ("sketch_no", "key", "i", "j", "own", "n", "node", "root", "sketch")} for r in own]), 0.8)
            pairs = [tuple(sorted((bytes(own[p]["node"]), bytes(own[q]["node"])))) for x, y in cell.candidates() for p, q in zip(x.tolist(), y.tolist(), strict=True)]
            assert not found & set(pairs) and len(pairs) == len(set(pairs))
            found |= set(pairs)
        assert len(wanted) > 100 and found == wanted


def test_odd_rows(spark):
    found = neardup.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(found) == len(ODD)
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert classes[1] == classes[2] == 1 and classes[3] == 3 and classes[5] == 5
    kept = neardup.drop_near_duplicates(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, ODD).columns and kept.count() == len(ODD) - 2
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_null_ids_with_many_texts(spark):
    rng = random.Random(7)
    texts = [" ".join(edited(rng, [f"w{g}-{i}" for i in range(60)], 2)) for g in range(20) for _ in range(4)]
    named = brute_classes(list(enumerate(texts)))
    for id_ in (None,):
        found = neardup.near_duplicates(docs_of(spark, [(id_, t) for t in texts])).collect()
        assert len(found) == 80 and {r["class_id"] for r in found} == {id_}
        assert sorted(r["class_size"] for r in found) == sorted(list(named.values()).count(c) for c in named.values())
        assert neardup.drop_near_duplicates(docs_of(spark, [(id_, t) for t in texts])).count() == 20


def test_very_long_texts_and_columns_that_differ_in_case(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(50_000)]
    rows = [(0, " ".join(base)), (1, " ".join(edited(rng, base, 2_000))), (2, " ".join(edited(rng, base, 15_000)))]
    assert classes_of(spark, rows) == {0: 0, 1: 0, 2: 2}
    clash = docs_of(spark, rows, extra=False).withColumns({"NODE": F.lit(1), "Class_Id": F.lit(2), "KEY": F.lit(3)})
    assert neardup.drop_near_duplicates(clash).columns == clash.columns


def test_alignment_in_a_band():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(0, 6)]
        common = longest_common(a, b)
        wanted = common / (len(a) + len(b) - common)
        found = neardup.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.7)
        assert found == pytest.approx(wanted if wanted >= 0.7 - 1e-12 else 0.0)

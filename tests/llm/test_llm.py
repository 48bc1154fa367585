"""Corpus operators: against brute force, exact round trips, held-out accuracy, and odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import assert_same, connect
from tidewatch.llm import byte_bpe, decontaminate, licenses, lm_score, nearest, queries, token_files, toxicity, url_filter, warc
from tidewatch.llm.common import words_of

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
#: Null id, null, empty and wordless texts, a repeated row, a very long text without spaces, odd white space.
ODD = [(1, None), (2, ""), (3, "!!! ???"), (None, "a null id"), (5, "twice the same"), (5, "twice the same"), (6, "x" * 200_000), (7, "a \t b\x1c\u3000c  \n\n d "), (8, "ÉCOLE Straße 日本 don't")]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("n_words", "score", "row", "id", "node", "ids")}) if extra else df


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR)


# 2: cross-entropy difference


def plain_losses(rows, targets, every=None, mu=lm_score.MU, alpha=lm_score.ALPHA):
    """Mean losses of each row (or of ``every`` n-th) under both models, its own counts taken out of those of all rows."""
    words = [(i, words_of((t or "").encode())) for i, t in rows]
    n_words = len({w for _, own in words for w in own})

    def counts(texts):
        single, pairs = Counter(), Counter()
        for own in filter(None, texts):
            single.update([*own, "<end>"])
            pairs.update(zip(["<start>", *own], [*own, "<end>"], strict=True))
        return single, pairs

    models = counts([w for i, w in words if i in targets]), counts([w for _, w in words])
    sizes = [sum(n for w, n in single.items() if w != "<end>") for single, _ in models]
    out = []
    for i, own in words[::every]:
        less, losses = counts([own]), []
        for (single, pairs), scale, minus in ((models[0], 1.0, i in targets), (models[1], sizes[0] / sizes[1] if sizes[0] else 1.0, 1)):
            loss = 0.0
            for before, w in zip(["<start>", *own[:-1]], own, strict=True) if own else ():
                last = "<end>" if before == "<start>" else before
                word, context, pair = single[w] - minus * less[0][w], single[last] - minus * less[0][last], pairs[before, w] - minus * less[1][before, w]
                total = sum(single.values()) - minus * sum(less[0].values())
                loss -= np.log((scale * pair + mu * (scale * word + alpha) / (scale * total + alpha * (n_words + 2))) / (scale * context + mu))
            losses.append(loss / len(own) if own else None)
        out.append(losses)
    return out


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20, 1), (5, 3, 0), (5, 3, 256)])
def test_lm_score_like_plain_counts(spark, sizes):
    """One shard, several with several buckets, and several with keys as rows."""
    rows = [(i, t) for i, t in enumerate(["a b c a b", "a b a", "c c c d", "d a b", "x y z", "", None, "a a a a", "a b a"])]
    scored = lm_score.cross_entropy_difference(docs_of(spark, rows), spark.createDataFrame([(0,), (1,), (99,), (None,)], "t long"), shard_tokens=sizes[0], bucket_keys=sizes[1], least_keys=sizes[2])
    found = {r["doc_id"]: r for r in scored.collect()}
    assert len(found) == len(rows)
    for (i, _), (target, background) in zip(rows, plain_losses(rows, {0, 1}), strict=True):
        if target is None:
            assert found[i]["score"] is None and found[i]["n_tokens"] == 0
        else:
            assert (found[i]["target_loss"], found[i]["background_loss"]) == pytest.approx((target, background), abs=1e-9)


def test_lm_score_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    found = {r["doc_id"]: (r["target_loss"], r["background_loss"]) for r in queries.op2_lm_score(spark, SF_DIR).collect()}
    for (i, _), wanted in zip(rows[::20], plain_losses(rows, set(good), 20), strict=True):
        assert found[i] == pytest.approx(wanted, abs=1e-9)


def test_lm_score_of_documents_by_key_rows(spark):
    """The same scores whether keys come packed by bucket or as rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").select("doc_id")
    score = lambda least: {r["doc_id"]: (r["target_loss"], r["background_loss"]) for r in lm_score.cross_entropy_difference(docs, good, shard_tokens=20_000, bucket_keys=50_000, least_keys=least).collect()}
    assert score(0) == score(1 << 40)


def test_lm_score_does_not_remember_targets(spark):
    """Target documents that were counted score as those of their kind that were not."""
    rng, rows = random.Random(12), []
    for i in range(400):
        kind = i % 2
        rows.append((i, " ".join(f"w{min(rng.randint(0, 200), rng.randint(0, 200)) + 100 * kind}" for _ in range(60))))
    targets = spark.createDataFrame([(i,) for i in range(0, 400, 4)], "t long")
    found = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(docs_of(spark, rows), targets).collect()}
    counted, left_out, other = ([found[i] for i in range(400) if i % 4 == k or (k == 1 and i % 2)] for k in (0, 2, 1))
    above = lambda a, b: np.mean([x > y for x in a for y in b])
    assert 0.4 < above(counted, left_out) < 0.6 and above(other, left_out) > 0.99


def test_lm_score_of_a_very_long_text(spark):
    rng = random.Random(13)
    rows = [(0, " ".join(f"w{rng.randint(0, 999)}" for _ in range(50_000))), (1, "w1 w2"), (2, None)]
    clash = docs_of(spark, rows).withColumns({"SHARD": F.lit(1), "Words": F.lit(2)})
    found = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(clash, spark.createDataFrame([(1,)], "t long"), shard_tokens=1000).collect()}
    assert found[0]["n_tokens"] == 50_000 and found[0]["score"] is not None and found[2]["score"] is None


def test_lm_score_of_odd_rows(spark):
    none = spark.createDataFrame([], "t long")
    assert lm_score.cross_entropy_difference(docs_of(spark, ODD), none).count() == len(ODD)
    assert lm_score.cross_entropy_difference(docs_of(spark, []), none).count() == 0


# 3: WARC


def test_warc_round_trip(spark):
    html = [None, "", "same", "same", "y" * 700_000, "é\r\n\r\nWARC/1.1\r\n", "same", "y" * 700_000]
    pages = spark.createDataFrame([(i if i else None, f"http://x/{i}", h) for i, h in enumerate(html)] + [(3, "http://x/3", "same")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "digest", "data", "refers_to")})
    found = warc.archived(pages).collect()
    assert len(found) == 9
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    for r in found:
        h = html[r["id"] or 0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), digest(h))
    kinds = {r["id"]: (r["record_type"], r["refers_to"]) for r in found}
    assert kinds[1] == ("response", None) and kinds[None] == ("revisit", 1)
    assert kinds[2] == ("response", None) and kinds[3] == kinds[6] == ("revisit", 2) and kinds[7] == ("revisit", 4)
    assert len({r["record_id"] for r in found}) == len(found)
    assert {r["record_type"] for r in warc.archived(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.archived(pages.limit(0)).count() == 0


def test_chunks_carry_digests(spark):
    rows = spark.createDataFrame([(1, "u", "z" * 600_000), (2, "v", "é" * 10), (None, None, None)], "id long, uri string, payload string").withColumn("payload", F.col("payload").cast("binary"))
    chunks = warc.chunk_table(rows).orderBy("id", "chunk_no").collect()
    for payload, own in ((b"z" * 600_000, [c for c in chunks if c["id"] == 1]), ("é".encode() * 10, [c for c in chunks if c["id"] == 2]), (b"", [c for c in chunks if c["id"] is None])):
        data = b""
        for c in own:
            assert len(c["data"]) <= warc.CHUNK_BYTES
            data += bytes(c["data"])
            assert c["digest_so_far"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and c["bytes_so_far"] == len(data)
        assert data == payload and [c["last"] for c in own] == [False] * (len(own) - 1) + [True]
    assert len(chunks) == 5 and "data" not in warc.chunk_table(rows, with_data=False).columns


def test_a_large_payload_in_small_batches(spark):
    html = ["".join(chr(97 + i % 26) for i in range(9_000_000)), "other", "other"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("DATA", F.lit(1))
    found = {r["id"]: r for r in warc.archived(pages).collect()}
    assert found[0]["payload_bytes"] == 9_000_000 and found[2]["refers_to"] == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


# 4: nearest neighbours


def exact_nearest(ids, vectors, query, k):
    score = (vectors * vectors[query]).sum(1)
    rest = [i for i in range(len(ids)) if ids[i] != ids[query]]
    return [ids[i] for i in sorted(rest, key=lambda i: (-score[i], ids[i]))[:k]]


def test_nearest_recall(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in queries.op4_nearest(spark, SF_DIR).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    hits = sum(len(set(exact_nearest(ids, vectors, q, 20)) & set(found[ids[q]])) for q in asked)
    assert hits >= 0.9 * 20 * len(asked)


def recall(spark, df, asked, k=20):
    """Recall of the operator against brute force, for a table of vectors with the ids 0, 1, ..."""
    rows = df.orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in nearest.largest_inner_products(df, df.filter(F.col("vec_id").isin(asked)), k=k).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(set(exact_nearest(ids, vectors, q, k)) & found[q]) for q in asked) / (k * len(asked))


def test_nearest_recall_over_many_lists_and_units(spark, monkeypatch):
    monkeypatch.setattr(nearest, "UNIT_ROWS", 400)
    monkeypatch.setattr(nearest, "CHUNK_QUERIES", 30)
    rng = np.random.default_rng(2)
    scattered = rng.standard_normal((3000, 32)) * rng.uniform(0.8, 1.2, (3000, 1))
    gathered = np.repeat(rng.standard_normal((30, 32)) * 3, 100, 0) + rng.standard_normal((3000, 32)) * 0.5
    for vectors in (scattered, gathered):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
        assert recall(spark, df, list(range(0, 3000, 40))) >= 0.9


def index_of(vectors, n_lists):
    index = nearest.ListIndex(vectors[:: max(1, len(vectors) // 2000)], float(np.sqrt((vectors**2).sum(1).max())), n_lists)
    points = index.rows(vectors)
    distance = index.distances(points)
    lists = distance.argmin(1)
    off = distance.min(1) + (points**2).sum(1)
    index.measured(*[np.bincount(lists, w, n_lists) for w in (np.ones(len(vectors)), off, off**2)])
    return index, lists


@pytest.mark.parametrize(("gathered", "most_rows", "most_components"), [(False, 0.8, 0.6), (True, 0.1, 0.1)])
def test_adaptive_scan_reads_a_part_of_rows_and_components(gathered, most_rows, most_components):
    """40 lists: recall, and the shares of rows compared and of components read."""
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((6000, 64))
    if gathered:
        vectors = np.repeat(rng.standard_normal((60, 64)), 100, 0) + 0.3 * vectors
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index, lists = index_of(vectors, 40)
    ids, asked = np.arange(6000), rng.permutation(6000)[:60]
    near = np.isin(lists, np.unique(lists[asked])[:20])
    radius = nearest.first_radius(index, ids[near], vectors[near], asked, vectors[asked], 20)
    if gathered:
        radius = nearest.first_radius(index, ids, vectors, asked, vectors[asked], 20)
    found, rows, components = nearest.scan_unit(index, lists, ids, vectors, asked, vectors[asked], radius, 20, nearest.EPSILON, nearest.LOSS)
    hits = sum(len(set(exact_nearest(ids, vectors, q, 20)) & set(found[1][found[0] == q])) for q in asked)
    assert hits >= 0.9 * 20 * len(asked) and rows <= most_rows and components <= most_components


def test_nearest_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "list", "score")})
    found = nearest.largest_inner_products(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 7, 0.5)]
    assert nearest.largest_inner_products(df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_norms_and_widths_that_differ_much(spark):
    """Rows whose norms spread widely, and clusters of very different widths: an estimate by a normal distribution fails there."""
    rng = np.random.default_rng(5)
    each = rng.standard_normal((4000, 32))
    spread = each / np.linalg.norm(each, axis=1, keepdims=True) * rng.lognormal(0, 1, (4000, 1))
    widths = np.repeat(rng.standard_normal((40, 32)), 100, 0) + each * np.exp(rng.normal(-1, 1, (4000, 1)))
    for vectors in (spread, widths, rng.standard_cauchy((4000, 32))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        assert recall(spark, df, list(range(0, 4000, 40))) >= 0.99


def test_nearest_with_many_copies(spark):
    df = spark.range(9000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id"), F.rand(1))).alias("embedding"))
    found = nearest.largest_inner_products(df, df.filter("vec_id = 300")).orderBy("rank").collect()
    assert len(found) == 20 and all(r["score"] >= 1 - 1e-12 for r in found)


# 5: licenses


def test_license_labels(spark):
    rows = ODD + [(20, "CC BY-NC cc by nc\nUnder the MIT License."), (21, "permission IS hereby granted, free of charge, to any person obtaining a copy of this program"), (22, "mit license under the"), (23, "This work is licensed under the GNU General Public License, version 3.")]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert (found[20]["n_base"], found[20]["first_word"], found[20]["last_word"], found[20]["base_labels"], found[20]["score"]) == (3, 0, 6, "cc-by-nc,mit", 1.0)
    assert found[21]["labels"] == "mit" and found[21]["base_labels"] == "" and 0.8 <= found[21]["score"] < 1
    assert (found[22]["n_base"], found[22]["first_word"]) == (0, None)
    assert "gpl-3" in found[23]["labels"]
    assert (found[1]["n_words"], found[2]["labels"], found[3]["n_words"], found[6]["n_words"]) == (0, "", 0, 1)
    assert licenses.scan_licenses(docs_of(spark, rows)).count() == len(rows)
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def brute_notices(text):
    """Labels of all templates that some window meets."""
    words, found = [w.decode() for w in words_of(text.encode())], set()
    for template, label in licenses.TEMPLATES:
        own, step = set(template.split()), licenses.step_of(template)
        for i in range(0, max(len(words) - step, 1), step):
            if len(own & set(words[i : i + 2 * step])) >= licenses.THRESHOLD * len(own) - 1e-9:
                found.add(label)
    return found


def test_license_join_is_exact(spark):
    """Random windows against all templates: the filters lose no pair."""
    rng = random.Random(4)
    pool = sorted({w for t, _ in licenses.TEMPLATES for w in t.split()}) + ["zz", "yy"]
    rows = []
    for i in range(300):
        words = rng.choice(licenses.TEMPLATES)[0].split()
        rows.append((i, " ".join(rng.choices(pool[-30:], k=rng.randint(0, 150)) + rng.sample(words, rng.randint(len(words) // 2, len(words))) + rng.choices(pool, k=4))))
    found = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    bases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, text in rows:
        assert found[i] == brute_notices(text) | {label for phrase, label in bases.items() if f" {phrase} " in f" {text} "}


@pytest.mark.parametrize("n", [32, 33, 128, 129, 200, 700])
def test_license_templates_of_any_length(spark, n):
    """A body of so many words among others is found wherever it begins, with one word in ten replaced; with three it is not."""
    rng = random.Random(n)
    body = [f"t{rng.randint(0, 400)}" for _ in range(n)]
    rows = []
    for share, before in ((0.1, 0), (0.1, 37), (0.1, 3 * n), (0.3, 11)):
        own = list(body)
        for at in rng.sample(range(n), int(share * len(set(body)))):
            own[at] = "zz"
        rows.append((len(rows), " ".join(["x"] * before + own + ["y"] * n)))
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, rows), templates=[(" ".join(body), "body"), ("some other notice", "other")]).collect()}
    for i, text in rows:
        own, step, words = set(body), licenses.step_of(" ".join(body)), text.split()
        best = max(len(own & set(words[k : k + 2 * step])) / len(own) for k in range(0, max(len(words) - step, 1), step))
        assert (found[i]["labels"], found[i]["score"]) == (("body", pytest.approx(best)) if best >= 0.8 - 1e-9 else ("", 0.0))
    assert [found[i]["labels"] for i in range(3)] == ["body"] * 3


def test_license_notices_as_usually_wrapped(spark):
    """Notices broken at 80 columns and at 40, and behind comment signs, in the middle of other text."""
    import textwrap

    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = []
    for text in (bsd, gpl):
        for width, sign in ((80, ""), (40, "# "), (72, " * ")):
            notice = "\n".join(sign + line for line in textwrap.wrap(text, width))
            rows.append((len(rows), "Some words stand before.\n" * 20 + notice + "\nand after. " * 50))
    rows.append((len(rows), "nothing of that kind " * 50_000))
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs_of(spark, rows).withColumn("WORDS", F.lit(1))).collect()}
    assert [found[i] for i in range(7)] == ["bsd"] * 3 + ["gpl"] * 3 + [""]


# 6: token files


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    values = np.concatenate([[0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], rng.integers(0, 2**32, 999) >> rng.integers(0, 32, 999)]).astype("<u4")
    for n in (0, 1, 2, 3, 4, 5, len(values)):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = ODD + [(100 - i, t) for i, t in enumerate(["The end.", "İstanbul ΣΑΣ", "<|endoftext|> it's 12%", "naïve, ﬁ ß"])]
    found = token_files.token_file_digests(docs_of(spark, rows), WORDS, 1).collect()
    assert len(found) == len(rows)
    texts, start = dict(rows), 0
    for r in sorted(found, key=lambda r: r["start"]):
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_files.token_file_digests(docs_of(spark, []), WORDS, 1).count() == 0


# 7: URL filter


def test_url_rules(spark):
    urls = [(1, "HTTP://A.Example.COM/en/7?x#y"), (2, "x://net/de/8"), (3, None), (4, "nothing"), (5, "http://b.example.net/de/81"), (6, "http://notexample.com/en/7"), (7, "http://x.org"), (8, "http://spam.org/a/?utm_source=b#c"), (9, "https://www.spam.org/a"), (9, "https://www.spam.org/a"), (10, "http://spam.org/a/b")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "key", "block")})
    listed = spark.createDataFrame([("spam.org/a",), (None,), ("spam.org/a",)], "u string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()}
    assert found[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[2] == ("net", "/de/8", "net/de/", "allow") and found[5][2:] == ("example.net/de/8", "block") and found[6][2:] == ("com/en/", "block")
    assert found[3] == found[4] == ("", "", None, "allow") and found[7][3] == "allow"
    assert found[8][3] == found[9][3] == "block" and found[10][3] == "allow"
    assert url_filter.filter_urls(pages, listed).count() == len(urls)
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0), rules=[]).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("url"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    rows = url_filter.filter_urls(pages.withColumns({"Host": F.lit(1), "URL_": F.lit("x"), "BLOCK": F.lit(2)}), listed, []).collect()
    assert all(r["listed"] == (r["page_id"] < 2000) and (r["maybe"] or not r["listed"]) for r in rows)
    assert len(rows) == 4000 and sum(r["maybe"] for r in rows) < 2200
    long = spark.createDataFrame([(None, "http://h/" + "x" * 200_000), (None, "http://h/1")], "page_id long, url string")
    assert sorted((len(r["path"]), r["listed"]) for r in url_filter.filter_urls(long, listed, []).collect()) == [(2, True), (200_001, False)]


# 8: decontamination


def brute_hits(text, items):
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, body in items:
        for window in decontaminate.windows_of(words_of((body or "").encode())):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item) if item is not None else "")
    return len(words), len(hit), found


def test_decontamination_like_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e f g".split())
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 5, 13, 14, 20))))) for i in range(12)] + [(50, None), (51, ""), (None, "q q q"), (10, "h h h")]
    rows = ODD + [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60))) + (" " + rng.choice(items)[1] if rng.random() < 0.5 and rng.choice(items)[1] else "") + " q Q q") for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    for most in (1 << 20, 60):
        found = decontaminate.judged(decontaminate.find_benchmark_spans(docs_of(spark, rows), bench, max_block_bytes=most)).collect()
        assert len(found) == len(rows)
        by_id = {r["doc_id"]: r for r in found}
        for i, text in rows:
            n, hit, items_hit = brute_hits(text, items)
            r = by_id[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items_hit), decontaminate.items_digest(list(items_hit)), hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == sum(not r["contaminated"] for r in found)
    assert decontaminate.find_benchmark_spans(docs_of(spark, ODD), bench.limit(0)).agg(F.sum(F.size("items"))).first()[0] == 0
    assert decontaminate.find_benchmark_spans(docs_of(spark, []), bench).count() == 0


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(15)
    words = [f"w{rng.randint(0, 50)}" for _ in range(50_000)]
    items = [(1, " ".join(words[31_000:31_020])), (2, " ".join(words[49_987:])), (3, "never there " * 8), (4, " ".join(words[31_000:31_020]))]
    clash = docs_of(spark, [(1, " ".join(words)), (1, None)]).withColumns({"SPANS": F.lit(1), "Items": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 200):
        found = sorted(decontaminate.find_benchmark_spans(clash, bench, max_block_bytes=most).collect(), key=lambda r: r["n_words"])
        assert found[0]["n_words"] == 0 and found[1]["n_words"] == 50_000 and found[1]["items"] == ["1", "2", "4"]
        assert [(s["start"], s["end"]) for s in found[1]["spans"]] == [(31_000, 31_020), (49_987, 50_000)]


def test_search_tables_are_small():
    rng = random.Random(16)
    items = [(str(i), [b"%d" % rng.randint(0, 20_000) for _ in range(60)]) for i in range(4_000)]
    size = sum(len(b" ".join(words)) for _, words in items)
    search = decontaminate.WindowSearch(items)
    table = search.tables[0]
    held = sum(a.nbytes for a in (search.numbers, table.keys, table.starts, table.order, table.items, table.item_ends)) + len(table.shifts) + sum(60 + len(w) for w in search.words)
    assert held < 9 * size


# 9: toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    counts = found.groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in counts}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.toxicity(docs_of(spark, ODD), known).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0
    kept = toxicity.drop_toxic(docs_of(spark, ODD), labels)
    assert kept.columns == docs_of(spark, ODD).columns


def test_label_model_finds_rates():
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(n_voters=6, prior=0.2)
    truth = rng.random(200_000) < 0.2
    toxic, clean = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.8]), np.array([0.05, 0.1, 0.02, 0.2, 0.01, 0.1])
    votes = (rng.random((len(truth), 6)) < np.where(truth[:, None], toxic, clean)).astype(float)
    votes[:, 5] = np.where(rng.random(len(truth)) < 0.9, votes[:, 1], votes[:, 5])  # a near copy of the second voter
    toxicity.fit_label_model(model, len(truth), votes.sum(0), votes.T @ votes)
    assert np.abs(model.rates[[0, 2, 3, 4], 0] - toxic[[0, 2, 3, 4]]).max() < 0.06
    assert np.abs(model.rates[[0, 2, 3, 4], 1] - clean[[0, 2, 3, 4]]).max() < 0.06
    assert model.correlations[1, 5] > 0.2 and model.trust[1] < model.trust[0]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.96


def test_classifier_learns_the_posterior():
    """On rows of few terms, the classifier separates what the label model does, and its score is the plain formula."""
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel(terms=[b"t%d " % i for i in range(8)], prior=0.3)
    model.voter_of, model.n_voters = toxicity.deal_voters([(t, 10, 0) for t in model.terms])
    rows = [sorted(rng.choice(8, rng.integers(*((4, 8) if i % 10 < 3 else (0, 2))), replace=False).tolist()) for i in range(600)]
    votes = np.array([model.votes(r) for r in rows])
    toxicity.fit_label_model(model, len(rows), votes.sum(0), votes.T @ votes)
    toxicity.fit_classifier(model, rows)
    posterior = model.posterior(votes)
    scores = np.array([model.score(r) for r in rows])
    for r, score in zip(rows[:50], scores, strict=False):
        assert score == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(model.weights[i] for i in r)))))
    high, low = scores[posterior > 0.5], scores[posterior <= 0.5]
    assert len(high) and len(low) and np.mean(high[:, None] > low[None, :]) > 0.9
    # The optimum of the same weighted loss by plain, slow gradient steps.
    counts = Counter(map(tuple, rows))
    distinct = list(counts)
    x = np.array([[i in r for i in range(len(model.weights))] for r in distinct], float)
    goal = model.posterior(np.array([model.votes(list(r)) for r in distinct]))
    weight = np.array([counts[r] for r in distinct], float)
    weight *= goal / (weight * goal).sum() + (1 - goal) / (weight * (1 - goal)).sum()
    loss = lambda w, b: -(weight * (goal * np.log(1e-12 + 1 / (1 + np.exp(-(x @ w + b)))) + (1 - goal) * np.log(1e-12 + 1 / (1 + np.exp(x @ w + b))))).sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - goal)
        w, b = w - 0.3 * x.T @ error, b - 0.3 * error.sum()
    assert loss(model.weights, model.bias) <= 1.05 * loss(w, b) + 0.01


def test_toxicity_of_a_very_long_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, "calm words here " * 5 + (f"vileword{i % 3} " * 3 if i % 2 else "")) for i in range(200)] + [(1_000, "calm words here " * 20_000 + "vileword1 vileword2"), (1_001, "calm words here " * 20_000)]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs_of(spark, rows).withColumns({"Held_Out": F.lit(1), "SCORE": F.lit(2)}).drop("score"), labels).collect()}
    assert found[1_000] >= found[1_001] and len(found) == 202


# 10: byte-level BPE


def test_bpe_like_tiktoken(spark):
    import tiktoken

    ranks = byte_bpe.load_ranks(BPE)
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = byte_bpe.RankedMerges(ranks, public_tokenizers.PATTERN), random.Random(6)
    alphabet = "aAbé \n\t'sd.,1½ΣIİß\u3000\x1cć日\u200b\u00a0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t or "" for _, t in ODD] + ["ab" * 4000 + "a" * 3000]
    for text in texts:
        ids = coder.encode(text)
        assert ids == wanted.encode_ordinary(text) and coder.decode(ids) == text.encode()
    found = byte_bpe.digests(docs_of(spark, ODD), BPE, public_tokenizers.PATTERN).collect()
    assert len(found) == len(ODD)
    given = dict(ODD)
    for r in found:
        ids = wanted.encode_ordinary(given[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.digests(docs_of(spark, []), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_all_documents(spark):
    import tiktoken

    d = "/root/testdata/sf0.01"
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BPE), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = queries.op10_byte_bpe(spark, d).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = wanted.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_files_of_all_documents(spark):
    from tokenizers import Tokenizer

    d, tokenizer, start = "/root/testdata/sf0.01", Tokenizer.from_file(WORDS), 0
    found = {r["doc_id"]: r for r in queries.op6_token_files(spark, d).collect()}
    for row in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        r = found[row["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_coders_of_a_very_long_text(spark):
    rows = [(1, "word, and more; " * 20_000), (None, "ab" * 50_000)]
    clash = docs_of(spark, rows, extra=False).withColumns({"IDS": F.lit(1), "Start": F.lit(2), "N_TOKENS": F.lit(3)})
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in byte_bpe.digests(clash, BPE, public_tokenizers.PATTERN).collect()}
    assert decoded == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert {r["doc_id"]: r["start"] for r in token_files.token_file_digests(clash, WORDS, 1).collect()}[None] == 0


def test_bpe_columns(spark):
    coded = byte_bpe.decode_column(byte_bpe.encode_column(docs_of(spark, ODD), BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert coded.columns == [c for c in docs_of(spark, ODD).columns if c != "ids"] + ["ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in coded.collect())


# the pipeline


def test_pipeline_like_its_parts(spark):
    from tests.llm.test_neardup import brute_classes

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op9_toxicity(spark, SF_DIR).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if not predicted[r["doc_id"]])
    classes = brute_classes(rows)
    kept = [(i, t) for i, t in rows if classes[i] == i]
    clean = {i for i, t in kept if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*brute_hits(t, benchmark))}
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert found == clean


def test_pipeline_of_odd_rows(spark):
    full = docs_of(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    for docs in (full, full.limit(0)):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            columns = rows.columns
            rows = stage(spark, rows, SF_DIR)
            assert rows.columns == columns or "ids_sha256" in rows.columns
        assert rows.count() == (len(ODD) - 2 if docs is full else 0)

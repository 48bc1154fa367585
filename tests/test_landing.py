"""Damaged and odd landed files: what can be read is read, the rest is set aside."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import files, landed, normalize


def number(value):
    out = b""
    while value >= 0x80:
        out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
    return out + bytes([value])


def element(i, text="hi"):
    body = b"".join(number(f << 3) + number(v) for f, v in ((1, i), (2, i % 1000), (8, 1_700_000_000))) + b"\x3a" + number(len(text.encode())) + text.encode()
    return b"\x0a" + number(len(body)) + body


def test_one_cut_segment_among_a_thousand(spark, tmp_path):
    for i in range(1_000):
        data = element(i, f"text {i}") + element(10_000 + i)
        (tmp_path / f"{i}.bin").write_bytes(data[:-3] if i == 77 else data)
    good, bad = normalize.split_segments(normalize.read_segments(spark, f"file://{tmp_path}"))
    rows = good.collect()
    assert sum(r["overlay_id"] < 10_000 for r in rows) == 1_000 and len(rows) == 2_000  # what is left of the cut element too
    (one,) = bad.filter("damaged IS NOT NULL").collect()
    assert one["path"].endswith("/77.bin") and one["damage"] == "cut value" and bytes(one["damaged"]) == (tmp_path / "77.bin").read_bytes()


@pytest.mark.parametrize(
    ("data", "n", "reasons"),
    [
        (element(5), 1, []),
        (b"", 0, []),
        (b"\xff" * 20, 0, ["cut number"]),
        (element(5) + b"\x0b\x01", 1, ["wire type 3"]),
        (b"\x0a\x04\x08\x05\x3d\x00" + element(6), 2, ["wire type 5"]),
        (b"\x0a\x06\x08\x05\x3a\x02\xff\xfe", 1, ["bytes of text"]),
        (b"\x0a\x04\x3a\x02ab" + b"\x0a\x02\x38\x07", 1, []),
        (b"\x10\x07" + element(9), 1, []),
        (b"\x0a\x0b\x08" + b"\xff" * 9 + b"\x01", 0, ["size of overlay_id"]),
    ],
)
def test_damaged_segments(data, n, reasons):
    rows, damage = normalize.segment_elements(data)
    assert len(rows) == n and [r for _, r in damage] == reasons


def test_no_bytes_end_the_decoder(spark):
    rng = random.Random(5)
    whole = b"".join(element(i, "é" * (i % 9)) for i in range(40))
    rows = []
    for i in range(300):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append((str(i), bytes(data[: rng.randint(0, len(data))])))
    decoded = normalize.decode_segments(spark.createDataFrame([*rows, ("none", None)], "path string, content binary"))
    assert decoded.filter("damage IS NULL").count() > 1_000 and decoded.filter("damage IS NOT NULL").count() > 10


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ('x window.__INITIAL_STATE__={"a":"}</script>","b":1};(function', '{"a":"}</script>","b":1}'),
        (r'window.__INITIAL_STATE__ = {"a":"\"}","b":{"c":"\\"}} rest }', r'{"a":"\"}","b":{"c":"\\"}}'),
        ("window.__INITIAL_STATE__={};", "{}"),
        ('window.__INITIAL_STATE__={"a":1', None),
        ("window.__INITIAL_STATE__=null", None),
        ("no state", None),
        (None, None),
    ],
)
def test_state_objects_end_at_their_own_brace(html, wanted):
    assert normalize.balanced_object(html) == wanted


def test_bad_lines_are_set_aside_with_their_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, lines in (("a", ['{"k": 1}', '{"k": 2']), ("b", ['{"k": 3}', "no json", '{"k": 4}'])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))
    good, bad = files.split_corrupt(spark, f"file://{tmp_path}/in", "k long")
    for _ in range(2):
        files.quarantine(bad, f"file://{tmp_path}/aside")
    assert sorted(r["k"] for r in good.collect()) == [1, 3, 4]
    aside = spark.read.parquet(f"file://{tmp_path}/aside").groupBy("line", F.regexp_extract("file", r"(\w)\.json$", 1).alias("f")).count().collect()
    assert {(r["line"], r["f"], r["count"]) for r in aside} == {('{"k": 2', "a", 2), ("no json", "b", 2)}


def rows_read(frame):
    """The rows that the scan of a frame gives, from the metrics of its plan, and the rows of the result."""
    n = len(frame.collect())
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.length())]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans), n


def test_lookups_by_other_columns_skip_most_row_groups(spark, tmp_path):
    n, path = 40_000, f"file://{tmp_path}/store"
    rows = spark.range(n).select("id", (F.col("id") % 997).alias("content_id"), (F.xxhash64("id") % 500).alias("user_id"), F.timestamp_seconds(F.abs(F.xxhash64("id", F.lit(1))) % 1_000_000).alias("created_at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    files.write_bucketed(rows, path, "content_id", 4, near=["user_id", "created_at"], bloom=("id",), block_bytes=60_000)
    conditions = {
        "user": (F.col("user_id") == 77, 0.35),
        "time": ((F.col("created_at") >= F.timestamp_seconds(F.lit(500_000))) & (F.col("created_at") < F.timestamp_seconds(F.lit(510_000))), 0.35),
        "both": ((F.col("user_id") == 77) & (F.col("created_at") < F.timestamp_seconds(F.lit(100_000))), 0.15),
        "id": (F.col("id") == 12_345, 0.1),
    }
    for name, (condition, most) in conditions.items():
        read, found = rows_read(files.lookup_indexed(spark, path, condition))
        assert found == rows.filter(condition).count() and read <= most * n, (name, read)
    assert rows_read(spark.read.parquet(path).filter(F.col("text") == "x"))[1] == 0


def test_z_order_of_nulls_and_constants(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else i, 5) for i in range(50)], "k long, a long, b int")
    files.write_bucketed(rows, f"file://{tmp_path}/s", "k", 2, near=["a", "b"])
    assert files.read_bucketed(spark, f"file://{tmp_path}/s").count() == 50
    files.write_bucketed(rows.limit(0), f"file://{tmp_path}/none", "k", 2, near=["a", "b"])


# landed files as a data source


def values_of(data, piece=16):
    return list(landed.elements(io.BytesIO(data), piece))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('[{"a": 1}, {"a": "]}"}, 12, "x\\"y", null, [1, [2]]]', ['{"a": 1}', '{"a": "]}"}', "12", '"x\\"y"', "null", "[1, [2]]"]),
        ('{"code": 0, "n": {"comments": [1]}, "replies": [{"b": "é日"}]}', ['{"b": "é日"}']),
        ('{"a": 1}', []),
        ("{}", []),
        (" [ ] ", []),
        ("", []),
    ],
)
@pytest.mark.parametrize("piece", [1, 3, 1_000])
def test_elements_in_pieces(text, wanted, piece):
    assert values_of(text.encode(), piece) == [(v, None) for v in wanted]


@pytest.mark.parametrize(("text", "n"), [('[1, 2, {"a": ', 2), ("[1 2]", 1), ("nothing", 0), ('[1, "x', 1), ("[1,", 1)])
def test_broken_arrays_end_with_a_reason(text, n):
    found = values_of(text.encode())
    assert [e for _, e in found[:n]] == [None] * n and len(found) == n + 1 and found[n][1]


def test_a_large_array_is_read_in_bounded_memory():
    import tracemalloc

    class Endless:
        """An array of 200 MB that is made while it is read."""

        def __init__(self):
            self.left = 200

        def read(self, n):
            if not self.left:
                return b""
            self.left -= 1
            body = b",".join([b'{"text": "%s"}' % (b"x" * 980)] * 1_000)
            return (b"[" if self.left == 199 else b",") + body + (b"]" if not self.left else b"")

    tracemalloc.start()
    assert sum(1 for _ in landed.elements(Endless())) == 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_landed_format(spark, tmp_path):
    landed.register(spark)
    for key in ("7", "8", "9"):
        (tmp_path / f"{key}_comments.json").write_text('[{"k": %s}, {"k": 1%s}]' % (key, key))
    (tmp_path / "5_x.json").write_text('{"replies": [{"k": 5}, {"k"')
    (tmp_path / "_hidden.json").write_text("[1]")
    rows = spark.read.format("landed").load(f"file://{tmp_path}")
    assert sorted((r["key"], r["n"], r["value"]) for r in rows.filter("error IS NULL").collect()) == sorted([(k, n, '{"k": %s%s}' % ("1" * n, k)) for k in "789" for n in (0, 1)] + [("5", 0, '{"k": 5}')])
    assert [r["key"] for r in rows.filter("error IS NOT NULL").collect()] == ["5"]
    one = spark.read.format("landed").load(f"file://{tmp_path}").filter("key IN ('7', '9') AND n = 0")
    assert sorted(r["key"] for r in one.collect()) == ["7", "9"] and one.rdd.getNumPartitions() == 2


def test_landed_batches_commit_or_leave_nothing(spark, tmp_path):
    landed.register(spark)
    rows = spark.range(50).select(F.to_json(F.struct("id")).alias("value")).repartition(4)
    save = lambda frame: frame.write.format("landed").mode("append").save(f"file://{tmp_path}")
    save(rows)
    back = spark.read.format("landed").load(f"file://{tmp_path}")
    assert sorted(back.select(F.get_json_object("value", "$.id").cast("int")).toPandas().iloc[:, 0]) == list(range(50))
    with pytest.raises(Exception, match="broken"):
        save(rows.select(F.when(F.col("value").contains("49"), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("value")).alias("value")))
    assert back.count() == 50 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_landed_stream_goes_on_after_a_restart(spark, tmp_path):
    landed.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("landed").option("files_per_batch", 1).load(f"file://{tmp_path}/in")
        query = stream.select("key", "value").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="0 seconds").start()
        try:
            for _ in range(3):
                query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["key"], r["value"]) for r in spark.read.schema("key string, value string").parquet(f"file://{tmp_path}/out").collect())

    (tmp_path / "in" / "1.json").write_text("[1, 2]")
    assert run() == [("1", "1"), ("1", "2")]
    (tmp_path / "in" / "2.json").write_text("[3]")
    (tmp_path / "in" / "3.json").write_text("[4]")
    assert run() == [("1", "1"), ("1", "2"), ("2", "3"), ("3", "4")]


def test_comment_files_of_all_forms(spark, tmp_path):
    forms = {"BV1": '[{"rpid": 1, "content": "a", "ctime": 60}, {"rpid": 2, "message": "b", "like_count": 3}]', "BV2": '{"comments": [{"rpid": 3, "root": 1, "mid": 9}]}', "BV3": '{"page": {"n": 1}, "replies": [{"rpid": 4}]}', "BV4": '[{"rpid": 5}, {"rpid"'}
    for name, text in forms.items():
        (tmp_path / f"{name}_comments.json").write_text(text)
    found = {r["comment_id"]: r for r in files.read_comments(spark, f"file://{tmp_path}").collect()}
    assert sorted(found) == [1, 2, 3, 4, 5] and [found[i]["text"] for i in (1, 2, 3)] == ["a", "b", None]
    assert (found[2]["like_count"], found[3]["root_id"], found[3]["user_id"], found[4]["root_id"]) == (3, 1, 9, 0)


def test_profiles_of_odd_payloads(spark):
    texts = ['{"mid": "7", "name": "a", "level": "x", "follower": 12.0, "new": {"k": [1]}}', '{"mid": 8, "face": null, "sign": 5, "level": 4}', "no json", None, "[1]", '{"mid": {"a": 1}}']
    rows = [tuple(r) for r in normalize.normalize_user(spark.createDataFrame([(t,) for t in texts], "data string")).select("user_id", "name", "avatar", "sign", "level", "follower", "post_count").collect()]
    none = (None, None, "", "", 0, 0, -1)
    assert rows == [(7, "a", "", "", 0, 12, -1), (8, None, "", "5", 4, 0, -1), none, none, none, none]
    kept = normalize.normalize_user(spark.createDataFrame([(texts[0],)], "data string"), keep=True)
    assert kept.select(F.try_variant_get("payload", "$.new.k[0]", "int")).first()[0] == 1


def test_segments_hold_numbers_of_any_size(spark, tmp_path):
    """Ids beyond three bytes of seven bits, and texts beyond 127 bytes."""
    from tidewatch.plans.landing import decode_overlay_segments, segment_files

    ids = [0, 127, 128, 2**21 - 1, 2**21, 6_000_000, 2**35, 2**62]
    rows = [(i, k + 2**21, "click" if k % 2 else "view" * 50, 1.5) for k, i in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("user_id"))
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    found = decode_overlay_segments(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, found)) == sorted((i, u, t, u % 11, i % 3, str(i), 5) for i, u, t, _ in rows)
    found = segment_files(spark, f"file://{tmp_path}").filter("kind = 'element'").collect()
    assert sorted((r["overlay_id"], r["file"], r["text"]) for r in found) == sorted((i, str(i // 200), t) for i, _, t, _ in rows)


def test_more_tasks_than_buckets_write_a_store(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.col("id") % 97).alias("k"), F.xxhash64("id").alias("user_id"))
    files.write_bucketed(rows, f"file://{tmp_path}/s", "k", 2, near=["user_id", "id"])
    assert len(list((tmp_path / "s").glob("bucket=*/*.parquet"))) > 4 and files.read_bucketed(spark, f"file://{tmp_path}/s").count() == 20_000


def test_only_the_state_of_a_page_goes_to_python(spark):
    state = 'window.__INITIAL_STATE__={"a":"}","b":{}}'
    pages = [("x" * 100_000 + state + "; rest", '{"a":"}","b":{}}'), ("window.__INITIAL_STATE__=null " + state, '{"a":"}","b":{}}'), ("no state", None), (None, None)]
    frame = spark.createDataFrame(pages, "html string, wanted string")
    rows = frame.select(normalize.initial_state("html").alias("found"), "wanted")
    assert all(r["found"] == r["wanted"] for r in rows.collect())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(window.__INITIAL_STATE__" in plan and "substr" in plan


def test_named_files_are_read_by_a_fixed_number_of_tasks(spark, tmp_path):
    """Tasks do not grow with files, writers are more than the one split the rows come from, and every file's name is its key."""
    for folders in (0, 16):
        path = f"file://{tmp_path}/{folders}"
        rows = spark.range(0, 400, 1, 1).select(F.to_json(F.struct(F.col("id").alias("owner_mid"))).alias("value"), F.concat(F.lit("BV"), F.col("id").cast("string")).alias("name"))
        files.write_named(rows, path, folders=folders)
        assert len(list((tmp_path / str(folders)).rglob("BV*.json"))) == 400
        found = files.read_contents(spark, path)
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(map(tuple, found.select("content_id", "owner_id").collect())) == sorted((f"BV{i}", i) for i in range(400))


def test_objects_of_files_as_sparks_reader_gives_them(spark, tmp_path):
    texts = {
        "plain.json": b'{"a": 1, "b": "x"}', "wrong.json": b'{"a": "no", "b": "x"}', "many.json": b'[{"a": 1}, {"a": "no", "b": "y"}, {"a": 3}]', "none.json": b"[]", "bad.json": b'{"a": 1, ', "text.json": b"hello",
        "empty.json": b"", "blank.json": b" \n\t ", "two.json": b'{"a": 1}\n{"a": 2}', "mark.json": b'\xef\xbb\xbf{"a": 5}', "wide.json": '{"b": "中"}'.encode("utf-16"), "null.json": b"null", "number.json": b"3",
        "packed.json.gz": gzip.compress(b'{"a": 6}'), "_hidden.json": b'{"a": 7}', ".hidden.json": b'{"a": 8}', "other/deep.json": b'{"a": 9}',
    }
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    wanted = spark.read.schema("a long, b string").option("multiLine", True).json(f"file://{tmp_path}").select("a", "b", "_metadata.file_name")
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert key(files.read_objects(spark, f"file://{tmp_path}", "a long, b string")) == key(wanted)
    assert key(files.read_objects(spark, f"{tmp_path}/plain.json", "a long, b string")) == ["(1, 'x', 'plain.json')"]
    (tmp_path / "a b%20.json").write_bytes(b'{"a": 10}')
    assert files.read_objects(spark, str(tmp_path), "a long").filter("a = 10").first()["file_name"] == "a b%20.json"  # the name itself
    (tmp_path / "day=3").mkdir()
    (tmp_path / "plain.json").rename(tmp_path / "day=3" / "plain.json")
    assert files.read_objects(spark, str(tmp_path), "a long, b string").filter("file_name = 'plain.json'").count() == 1

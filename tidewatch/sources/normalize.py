"""Landed payloads (JSON, XML, HTML, binary segments) to rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.storage import written

CONTENT = (
    "bvid string, aid long, title string, pic string, owner struct<mid:long,name:string>, stat struct<view:long,reply:long,`like`:long>, "
    "tags array<struct<tag_name:string>>, source string"
)
MEMBER = "struct<mid:long,uname:string,level_info:struct<current_level:int>,vip:struct<vipStatus:int>>"
REPLY = f"rpid:long,root:long,parent:long,ctime:long,`like`:long,rcount:long,content:struct<message:string>,member:{MEMBER}"


def unwrap_envelope(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """code, data (null unless the code is 0) and the kind of error."""
    code = F.get_json_object(text, "$.code").try_cast("int")
    kind = (
        F.when(code == 0, None).when(code == -101, "not logged in").when(code == -404, "not found").when(code == -412, "blocked").when(code == -352, "risk control").when(code.isNull(), "unreadable").otherwise("other")
    )
    return payloads.withColumn("code", code).withColumn("data", F.when(code == 0, F.get_json_object(text, "$.data"))).withColumn("error", kind)


def normalize_content(payloads: DataFrame, text: str = "data") -> DataFrame:
    v = F.from_json(text, CONTENT)
    return payloads.select(v.alias("v")).select(
        F.col("v.bvid").alias("content_id"),
        F.col("v.aid").alias("aid"),
        F.col("v.title").alias("title"),
        F.col("v.owner.mid").alias("owner_id"),
        F.col("v.owner.name").alias("owner_name"),
        F.coalesce("v.stat.view", F.lit(0)).alias("view_count"),
        F.coalesce("v.stat.reply", F.lit(0)).alias("reply_count"),
        F.coalesce("v.stat.like", F.lit(0)).alias("like_count"),
        F.regexp_replace("v.pic", "^http:", "https:").alias("pic"),
        F.transform(F.coalesce("v.tags", F.array().cast("array<struct<tag_name:string>>")), lambda t: t["tag_name"]).alias("tags"),
        F.coalesce(F.nullif(F.col("v.source"), F.lit("")), F.lit("hot")).alias("source"),
    )


def normalize_comments(payloads: DataFrame, text: str = "data", root: Column | None = None) -> DataFrame:
    """Rows of a reply page; for pages of sub-replies ``root`` gives the defaults of root and parent."""
    replies = F.from_json(text, f"replies array<struct<{REPLY}>>")["replies"]
    rows = payloads.select((root if root is not None else F.lit(0).cast("long")).alias("given"), F.explode(replies).alias("r"))
    return rows.select(
        F.col("r.rpid").alias("comment_id"),
        F.coalesce("r.root", "given").alias("root_id"),
        F.coalesce("r.parent", "r.root", "given").alias("parent_id"),
        F.col("r.content.message").alias("text"),
        F.timestamp_seconds("r.ctime").alias("created_at"),
        F.coalesce("r.like", F.lit(0)).alias("like_count"),
        F.coalesce("r.rcount", F.lit(0)).alias("reply_count"),
        F.col("r.member.mid").alias("user_id"),
        F.col("r.member.uname").alias("user_name"),
        F.coalesce("r.member.level_info.current_level", F.lit(0)).alias("level"),
        F.coalesce("r.member.vip.vipStatus", F.lit(0)).alias("vip_status"),
    )


def parsed(payloads: DataFrame, text: str) -> DataFrame:
    """The payloads with ``v``, their JSON as a variant, parsed once; null where it is no JSON."""
    return payloads.withColumn("v", F.try_parse_json(text))


def field(path: str, kind: str = "string") -> Column:
    """A field of the parsed payload in the wanted type; null if it is missing, null or of a type that does not fit."""
    return F.try_variant_get("v", f"$.{path}", kind)


def normalize_user(payloads: DataFrame, text: str = "data", keep: bool = False) -> DataFrame:
    """Profile rows; with ``keep``, the whole payload stays beside them as a variant, unknown fields included."""
    none, empty = F.lit(0), F.lit("")
    return parsed(payloads, text).select(
        field("mid", "long").alias("user_id"),
        field("name").alias("name"),
        F.coalesce(field("face"), empty).alias("avatar"),
        F.coalesce(field("sign"), empty).alias("sign"),
        F.coalesce(field("level", "int"), none).alias("level"),
        F.coalesce(field("follower", "long"), none).alias("follower"),
        F.coalesce(field("following", "long"), none).alias("following"),
        F.coalesce(field("post_count", "long"), F.lit(-1)).alias("post_count"),
        *([F.col("v").alias("payload")] if keep else []),
    )


def schema_drift(payloads: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """For each source (``keys``) the number of payloads, of those that are no JSON, and the schema that all others have
    together, in which a field of clashing types is a VARIANT; sources whose schemas differ have drifted apart."""
    rows = parsed(payloads, text).groupBy(*keys)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull() & F.col(text).isNotNull()).alias("unreadable"), F.schema_of_variant_agg("v").alias("schema"))


def normalize_posts(payloads: DataFrame, text: str = "data", archive_first: bool = False) -> DataFrame:
    """Post text from the module's text or description; reposts carry an origin, a type or (in the variant) a label."""
    plain = F.coalesce(field("modules.module_dynamic.text"), field("modules.module_dynamic.desc.text"))
    body = F.coalesce(F.nullif(field("modules.module_dynamic.major.archive.title"), F.lit("")), plain) if archive_first else plain
    kind, origin = F.coalesce(field("type"), F.lit("")), field("orig", "variant")
    is_repost = F.coalesce(field("action").contains("转发"), F.lit(False)) if archive_first else kind.contains("FORWARD") | (origin.isNotNull() & ~F.coalesce(F.is_variant_null(origin), F.lit(False)))
    return parsed(payloads, text).select(field("id_str").alias("post_id"), field("mid", "long").alias("user_id"), F.coalesce(body, F.lit("")).alias("text"), is_repost.alias("is_repost"), kind.alias("post_type"))


def normalize_listing(payloads: DataFrame, text: str = "data") -> DataFrame:
    """Rows of a creator's listing; the first row's author names the owner."""
    rows = F.from_json(text, "list struct<vlist:array<struct<aid:long,bvid:string,author:string,mid:long,title:string,created:long,play:long,length:string>>>")["list"]["vlist"]
    return payloads.select(rows.alias("rows")).select(F.get("rows", F.lit(0))["author"].alias("owner_name"), F.explode("rows").alias("v")).select(
        F.col("v.mid").alias("owner_id"), "owner_name", F.col("v.aid").alias("aid"), F.col("v.bvid").alias("content_id"), F.col("v.title").alias("title"), F.timestamp_seconds("v.created").alias("created_at"), F.coalesce("v.play", F.lit(0)).alias("play"),
        (F.split_part("v.length", F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part("v.length", F.lit(":"), F.lit(2)).try_cast("int")).alias("duration_s"),
    )


def page_state(html: Column, pattern: str = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*(?:\(function|</script>|\z)") -> Column:
    """The state object that a page embeds, up to what may follow it: a function, the script's end or the text's; null without one."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


STATE_START = re.compile(r"window\.__INITIAL_STATE__\s*=\s*(?=\{)")
STATE_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def balanced_object(text: str | None) -> str | None:
    """The state object that a page embeds, to the brace that closes it; braces inside strings do not count. None without
    one, or if it does not end."""
    start = STATE_START.search(text or "")
    if start is None:
        return None
    depth = 0
    for part in STATE_PART.finditer(text, start.end()):
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if part[0] == "}" and not depth:
            return text[start.end() : part.end()]
    return None


@F.pandas_udf(T.StringType())
def state_objects(html: pd.Series) -> pd.Series:
    """``balanced_object`` of each page."""
    return html.map(balanced_object)


def initial_state(html: Column | str) -> Column:
    """``balanced_object`` of each page; what stands before its first state, and pages without one, do not go to Python."""
    page = F.col(html) if isinstance(html, str) else html
    at = F.locate("window.__INITIAL_STATE__", page)
    return state_objects(F.when(at > 0, F.substr(page, at)))


STATE_USER = "name string, face string, sign string, level int, sex string, birthday string, archive_count long, follower long, vip struct<status:int>, official struct<type:int,title:string>"


def state_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but the html, and the profile in the state that the page embeds; rows without a name are left out."""
    state = F.from_json(initial_state(html), f"up struct<{STATE_USER.replace(', ', ',').replace(' ', ':')}>")["up"]
    rows = pages.withColumn("_u", state).filter("_u.name <> ''")
    none, empty = F.lit(0), F.lit("")
    return rows.select(
        *[c for c in pages.columns if c != html],
        F.col("_u.name").alias("name"),
        F.coalesce("_u.face", empty).alias("avatar"),
        F.coalesce("_u.sign", empty).alias("sign"),
        F.coalesce("_u.level", none).alias("level"),
        F.coalesce("_u.sex", empty).alias("sex"),
        F.coalesce("_u.birthday", empty).alias("birthday"),
        F.coalesce("_u.follower", none).alias("follower"),
        F.lit(0).cast("long").alias("following"),
        F.coalesce("_u.vip.status", none).alias("vip_status"),
        F.col("_u.official.type").alias("official_type"),
        F.coalesce("_u.official.title", empty).alias("official_title"),
        F.lit(0).cast("long").alias("post_count"),
        F.coalesce("_u.archive_count", none).alias("upload_count"),
    )


def page_fields(html: Column) -> tuple[Column, Column]:
    """Sign (after the last full stop of the description) and level (of a class name) of a profile page."""
    description = F.regexp_extract(html, r"<meta name=\"description\" content=\"([^\"]*)\"", 1)
    sign = F.nullif(F.trim(F.regexp_extract(description, r"([^。]*)$", 1)), F.lit(""))
    return sign, F.regexp_extract(html, r"user_level_(\d+)", 1).try_cast("int")


def link_id(url: Column) -> Column:
    """The content id in a link."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"(BV[a-zA-Z0-9]{10})", r"av(\d+)", r"oid=(\d+)")])


def parse_overlay_xml(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Timed comments of an overlay file; elements with fewer than seven attributes or unreadable numbers are left out.
    Rows without an id get the hash of their content as id."""
    pattern = r"(?s)<d\b[^>]*?\bp=\"([^\"]*)\"[^>]*>(.*?)</d>"
    both = F.arrays_zip(F.regexp_extract_all(xml, F.lit(pattern), 1).alias("p"), F.regexp_extract_all(xml, F.lit(pattern), 2).alias("text"))
    rows = files.select("content_id", F.explode(both).alias("d")).select("content_id", F.split("d.p", ",").alias("p"), F.col("d.text").alias("text")).filter(F.size("p") >= 7)
    at = lambda i: F.get("p", F.lit(i))
    out = rows.select(
        F.coalesce(at(7).try_cast("long"), F.xxhash64("p", "text")).alias("overlay_id"),
        "content_id",
        "text",
        F.floor(at(0).try_cast("double") * 1000).cast("long").alias("progress_ms"),
        at(1).try_cast("int").alias("mode"),
        at(2).try_cast("int").alias("font_size"),
        at(3).try_cast("long").alias("color"),
        F.timestamp_seconds(at(4).try_cast("long")).alias("sent_at"),
        at(6).alias("sender_hash"),
    )
    return out.filter("progress_ms IS NOT NULL AND mode IS NOT NULL")


def parse_history_card(text: Column) -> tuple[Column, Column, Column]:
    """Time and like count of a card's head line, and its content id."""
    head = r"(\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})\s+(\d+)"
    when = F.try_to_timestamp(F.regexp_extract(text, head, 1), F.lit("yyyy/M/d H:m:s"))
    content = F.coalesce(F.nullif(F.regexp_extract(text, r"av(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"oid=(\d+)", 1), F.lit("")))
    return when, F.regexp_extract(text, head, 2).try_cast("long"), content


def history_text(text: Column, most: int = 500) -> Column:
    """What a history card says beside its head and its links, cut; null below two characters."""
    body = F.regexp_replace(text, r"(?m)^.*\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\s+\d+.*$|https?://\S+", "")
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(body) >= 2, F.substring(body, 1, most))


def parse_seed_uri(seeds: DataFrame, uri: str = "uri") -> DataFrame:
    """kind, value and page of seeds like ``hot``, ``bvid:x``, ``search:word:1-3``; a page range gives a row for each page."""
    kind, value, pages = (F.split_part(uri, F.lit(":"), F.lit(i)) for i in (1, 2, 3))
    first = F.coalesce(F.regexp_extract(pages, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    last = F.coalesce(F.regexp_extract(pages, r"-(\d+)$", 1).try_cast("int"), first)
    return seeds.select(uri, kind.alias("kind"), value.alias("value"), F.explode(F.sequence(first, F.greatest(first, last))).alias("page"))


def parse_id_seed(text: Column) -> Column:
    """A user id from JSON ({mid} or {uid}) or bare digits; else null."""
    is_json = F.trim(text).startswith("{")
    return F.when(is_json, F.coalesce(F.get_json_object(text, "$.mid"), F.get_json_object(text, "$.uid")).try_cast("long")).otherwise(F.trim(text).try_cast("long"))


def split_ids(rows: DataFrame, text: str) -> DataFrame:
    """Positive ids of a list divided by commas, spaces or line ends."""
    return rows.select(F.explode(F.split(text, r"[,\s]+")).alias("part")).select(F.col("part").try_cast("long").alias("user_id")).filter("user_id > 0")


OVERLAY_SEGMENT = "path string, overlay_id long, progress_ms int, mode int, font_size int, color long, sender_hash string, text string, sent_s long, weight int, action string, pool int, id_text string, attributes int"
#: Field numbers of an overlay element in a segment.
SEGMENT_FIELDS = {1: "overlay_id", 2: "progress_ms", 3: "mode", 4: "font_size", 5: "color", 6: "sender_hash", 7: "text", 8: "sent_s", 9: "weight", 10: "action", 11: "pool", 12: "id_text", 13: "attributes"}
SEGMENT_TEXTS, SEGMENT_LONGS = {"sender_hash", "text", "action", "id_text"}, {"overlay_id", "color", "sent_s"}


Damage = tuple[int, str]


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and where the next byte is; an IndexError if the bytes end within it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def fields(data: bytes, damage: list[Damage], base: int = 0) -> Iterator[tuple[int, int | bytes, int]]:
    """Field number, value (varint or length-delimited) and place of what can be read of a message. Reading ends at the
    first damage, whose place (from ``base``) and reason are added to the list; the part of a cut value is given."""
    at = 0
    while at < len(data):
        began = at
        try:
            key, at = varint(data, at)
            kind = key & 7
            if kind == 0:
                value, at = varint(data, at)
            elif kind == 2:
                size, at = varint(data, at)
                value, at = data[at : at + size], at + size
            else:
                damage.append((base + began, f"wire type {kind}"))
                return
        except IndexError:
            damage.append((base + began, "cut number"))
            return
        if at > len(data):
            damage.append((base + began, "cut value"))
        yield key >> 3, value, base + min(at, len(data)) - (len(value) if kind == 2 else 0)


def segment_elements(content: bytes) -> tuple[list[dict], list[Damage]]:
    """The overlay elements of a segment (repeated messages in field 1), and what is damaged in it. Bytes that are no UTF-8
    are replaced, fields of another kind than theirs are left out."""
    damage: list[Damage] = []
    rows = []
    for number, element, place in fields(content, damage):
        if number != 1 or not isinstance(element, bytes):
            continue
        row = {}
        for n, value, at in fields(element, damage, place):
            name = SEGMENT_FIELDS.get(n)
            if name is None or isinstance(value, bytes) != (name in SEGMENT_TEXTS):
                continue
            if isinstance(value, bytes):
                text = value.decode(errors="replace")
                if "\ufffd" in text and text.encode() != value:
                    damage.append((at, f"bytes of {name}"))
                row[name] = text
            elif value < 1 << (63 if name in SEGMENT_LONGS else 31):
                row[name] = value
            else:
                damage.append((at, f"size of {name}"))
        if row:
            rows.append(row)
    return rows, sorted(damage)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary segment files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_segments(files: DataFrame) -> DataFrame:
    """Of segment files (path, content) all that can be read: rows of elements, and for each damage a row with ``damage_at``
    (byte), ``damage`` (reason) and ``damaged`` (the file's bytes, in its first such row)."""
    names = [c.split()[0] for c in OVERLAY_SEGMENT.split(", ")]
    more = ["damage_at", "damage", "damaged"]

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found, damage = segment_elements(content or b"")
                rows += [{"path": path} | row for row in found]
                rows += [{"path": path, "damage_at": at, "damage": reason, "damaged": None if k else content} for k, (at, reason) in enumerate(damage)]
            yield pd.DataFrame(rows, columns=names + more, dtype=object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, f"{OVERLAY_SEGMENT}, damage_at long, damage string, damaged binary")


def decode_overlay_segments(files: DataFrame) -> DataFrame:
    """Timed comments of binary segment files (path, content), also of damaged ones as far as they can be read."""
    return decode_segments(files).filter("damage IS NULL").drop("damage_at", "damage", "damaged")


def split_segments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements, and the quarantine (path, damage_at, damage, damaged) of segment files, which are decoded once."""
    decoded = written(decode_segments(files), "decoded-segments")
    good = decoded.filter("damage IS NULL").drop("damage_at", "damage", "damaged")
    return good, decoded.filter("damage IS NOT NULL").select("path", "damage_at", "damage", "damaged")

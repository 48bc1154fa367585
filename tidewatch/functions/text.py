"""Column functions on comment texts and names. ``(?U)`` makes \\s, \\w and \\d cover all of Unicode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the platform's data: the sign of users who never wrote one, and the mark of a missing picture.
DEFAULT_SIGN = "这个人没有填简介啊~~~"
NO_AVATAR = "noface"
#: Names that follow the keyboard, as prefixes.
KEYBOARD_WALKS = "asdfgh|qwerty|zxcvbn|qazwsx"


def clean_comment(text: Column) -> Column:
    """Without mentions and bracketed stickers, white space collapsed; null where nothing is left."""
    out = F.regexp_replace(text, r"(?U)@\S+\s*", "")
    out = F.regexp_replace(out, r"\[[^\]]*\]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(out != "", out)


def preprocess(text: Column) -> Column:
    """For similarity: without stickers, mentions and any white space."""
    out = F.regexp_replace(text, r"\[[^\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)@\S+", ""), r"(?U)\s+", "")


def strip_html(html: Column) -> Column:
    """Without tags and stickers, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\[[^\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def truncate(text: Column, limit: int = 2000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def parse_count(text: Column) -> Column:
    """The digits of a displayed count; 0 without any."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast("long"), F.lit(0))


def dedup_key(title: Column, text: Column, n: int = 50) -> Column:
    """The title, or the first characters of the text where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), F.substring(text, 1, n))


def any_hit(text: Column, terms: list[str]) -> Column:
    """Some term occurs in the text."""
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.coalesce(text.contains(t), F.lit(False)) for t in terms])


def distinct_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def garbled_name(name: Column) -> Column:
    """Empty, untouched default, digits only, mostly digits without a word, a keyboard walk, or short letters and a long number."""
    n = F.greatest(F.length(name), F.lit(1))
    digits = F.length(F.regexp_replace(name, r"[^0-9]", ""))
    letters = F.length(F.regexp_extract(name, r"^([a-zA-Z]+)[0-9]{4,}$", 1))
    tail_share = (n - letters) / n
    return (
        F.coalesce(name == "", F.lit(True))
        | name.rlike(r"(?iU)^bili_\w{5,}$")
        | name.rlike(r"(?U)^用户\d{5,}$")
        | name.rlike(r"(?U)^\d{6,}$")
        | (name.rlike(r"^[a-zA-Z0-9_]{6,}$") & (digits / n > 0.35) & ~name.rlike(r"[a-zA-Z]{3}"))
        | name.rlike(rf"(?i)^(?:{KEYBOARD_WALKS})[a-z]*$")
        | ((letters > 0) & (((tail_share >= 0.60) & (letters <= 3)) | ((tail_share >= 0.50) & (letters <= 4))))
    )


def edit_similarity(a: Column, b: Column, limit: int = 2000) -> Column:
    """1 - edit distance / longer length of the first ``limit`` characters; equal texts 1, one empty text 0."""
    left, right = F.substring(F.coalesce(a, F.lit("")), 1, limit), F.substring(F.coalesce(b, F.lit("")), 1, limit)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, 1.0).when(F.least(F.length(left), F.length(right)) == 0, 0.0).otherwise(1 - F.levenshtein(left, right) / longest)


def topic_runs(text: Column) -> Column:
    """Runs of CJK characters or of ASCII letters and digits, two characters at least."""
    return F.regexp_extract_all(text, F.lit(r"([一-鿿]{2,}|[a-zA-Z0-9]{2,})"), 1)


def repair_percent(text: Column) -> Column:
    """A share of over 100 % that was scaled twice, as in 8500%, divided by 100; one such share in a text."""
    seen = F.regexp_extract(text, r"([0-9]{3,})%", 1)
    value = seen.try_cast("double")
    return F.when(value > 100, F.replace(text, F.concat(seen, F.lit("%")), F.concat(F.round(value / 100).cast("long").cast("string"), F.lit("%")))).otherwise(text)


#: Labels of a profile text and of its digest.
LEVEL, FANS, UPLOADS, AVATAR, WITHOUT, WITH_AVATAR, CUT_MARK, NO_PROFILE = "等级=Lv", "粉丝", "投稿", "头像", "无", "有头像", "...(截断)", "（无用户画像数据）"


def profile_digest(profile: Column, limit: int = 200) -> Column:
    """Level, followers, uploads and avatar of a profile text in one line; else the text, cut."""

    def part(pattern: str, label: str) -> Column:
        found = F.regexp_extract(profile, pattern, 1)
        return F.when(found != "", F.concat(F.lit(label), found))

    avatar = F.when(profile.contains(AVATAR) & ~profile.contains(WITHOUT), WITH_AVATAR)
    line = F.concat_ws(" | ", part(r"(?iU)Level?\s*[:：]?\s*(\d+)", LEVEL), part(rf"(?U){FANS}\s*[:：]?\s*(\d+)", f"{FANS}="), part(rf"(?U){UPLOADS}\s*[:：]?\s*(\d+)", f"{UPLOADS}="), avatar)
    best = F.when(line != "", line).otherwise(profile)
    cut = F.when(F.length(best) > limit, F.concat(F.substring(best, 1, limit), F.lit(CUT_MARK))).otherwise(best)
    return F.when(F.coalesce(profile, F.lit("")) == "", NO_PROFILE).otherwise(cut)


def profile_line(avatar: Column, posts: Column, uploads: Column, sign: Column) -> Column:
    """avatar yes/no | posts n or ? | uploads n or ? | sign, for a reviewer."""

    def number(value: Column) -> Column:
        return F.when(value >= 0, value.cast("string")).otherwise("?")

    no_avatar = (F.coalesce(avatar, F.lit("")) == "") | avatar.contains(NO_AVATAR)
    shown = F.when(F.coalesce(sign, F.lit("")) == "", "empty").when(sign == DEFAULT_SIGN, "default").otherwise(F.substring(sign, 1, 30))
    return F.concat_ws(
        " | ",
        F.when(no_avatar, "avatar no").otherwise("avatar yes"),
        F.concat(F.lit("posts "), number(posts)),
        F.concat(F.lit("uploads "), number(uploads)),
        F.concat(F.lit("sign "), shown),
    )

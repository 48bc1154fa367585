"""The account registry: an accumulating table, one row for each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.keyed import page
from tidewatch.operators.scoring import WEIGHTS, risk

REASON = "array<struct<type:string,content_id:string,score:double>>"

#: Times of a registry row, and which of two stays; nulls give way.
TIMES = {"added_at": F.least, "updated_at": F.greatest}


def merge(old: DataFrame, delta: DataFrame) -> DataFrame:
    """One upsert: highest score, risk by score, manual before auto, reasons appended, sources united, empty fields filled,
    notes appended. Both have user_id, user_name, avatar, score, added_by, reasons, sources, notes; one row for each user.
    Where they have times, ``added_at`` is the earliest and ``updated_at`` the latest of both."""
    new = delta.select("user_id", *[F.col(c).alias(f"new_{c}") for c in delta.columns if c != "user_id"])
    rows = old.join(new, "user_id", "full_outer")

    def filled(name: str):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(F.col(f"new_{name}"), F.lit("")))

    score = F.greatest("score", "new_score")
    no_reasons, no_sources = F.array().cast(delta.schema["reasons"].dataType), F.array().cast("array<string>")
    notes = F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.nullif(F.col("new_notes"), F.lit("")))
    manual = F.coalesce((F.col("added_by") == "manual") | (F.col("new_added_by") == "manual"), F.coalesce("added_by", "new_added_by") == "manual")
    held = {name: [F.col(c) for c in (name, f"new_{name}") if c in rows.columns] for name in TIMES}
    times = [(TIMES[name](*columns) if len(columns) > 1 else columns[0]).alias(name) for name, columns in held.items() if columns]
    return rows.select(
        "user_id",
        F.coalesce(filled("user_name"), F.concat(F.lit("UID"), F.col("user_id").cast("string"))).alias("user_name"),
        F.coalesce(filled("avatar"), F.lit("")).alias("avatar"),
        score.alias("score"),
        risk(score).alias("risk"),
        F.when(manual, "manual").otherwise("auto").alias("added_by"),
        F.concat(F.coalesce("reasons", no_reasons), F.coalesce("new_reasons", no_reasons)).alias("reasons"),
        F.array_union(F.coalesce("sources", no_sources), F.coalesce("new_sources", no_sources)).alias("sources"),
        notes.alias("notes"),
        *times,
    )


def collected(scored: DataFrame, limit: float = 70, added_by: str = "auto", at: str | None = None) -> DataFrame:
    """The delta of an analysis: one row for each user at or above the limit, with a reason for each content; where the rows
    have features, a reason's type names the three largest. With ``at``, the column of the time of an analysis, reasons
    have that as ``recorded_at``, and the row was added with the first and updated with the last of them."""
    known = [f for f in WEIGHTS if f in scored.columns]
    if known:
        entries = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f), F.lit(0.0))).alias("minus"), F.lit(f).alias("name")) for f in known]))
        best = F.filter(F.slice(entries, 1, 3), lambda e: -e["minus"] > 0.3)
        scored = scored.withColumn("kind", F.concat_ws(": ", F.lit("engine"), F.nullif(F.array_join(F.transform(best, lambda e: e["name"]), ", "), F.lit(""))))
    else:
        scored = scored.withColumn("kind", F.lit("engine"))
    kind = REASON.replace(">>", ",recorded_at:timestamp>>") if at else REASON
    recorded = [F.col(at).cast("timestamp").alias("recorded_at")] if at else []
    reason = F.struct(F.col("kind").alias("type"), F.col("content_id").cast("string").alias("content_id"), F.col("score").cast("double").alias("score"), *recorded)
    rows = scored.filter(F.col("score") >= limit)
    times = [pick(F.col(at).cast("timestamp")).alias(name) for name, pick in (("added_at", F.min), ("updated_at", F.max))] if at else []
    return rows.groupBy("user_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(reason)).alias("reasons"), F.array_sort(F.collect_set(F.col("content_id").cast("string"))).alias("sources"), *times).select(
        "user_id", F.lit("").alias("user_name"), F.lit("").alias("avatar"), F.col("score").cast("double").alias("score"), F.lit(added_by).alias("added_by"), F.expr(f"CAST(reasons AS {kind})").alias("reasons"), "sources", F.lit("").alias("notes"), *(TIMES if at else ())
    )


def listing(registry: DataFrame, risk_is: str | None = None, added_by: str | None = None, search: str | None = None) -> DataFrame:
    """Filtered rows; ``search`` is part of the id or of the name, whatever its case."""
    if risk_is:
        registry = registry.filter(F.col("risk") == risk_is)
    if added_by:
        registry = registry.filter(F.col("added_by") == added_by)
    if search:
        registry = registry.filter(F.col("user_id").cast("string").contains(search) | F.lower("user_name").contains(search.lower()))
    return registry


def listing_page(registry: DataFrame, number: int, size: int, by: str = "score", descending: bool = True) -> DataFrame:
    """A page of the rows by score, time (``updated_at``) or number of reasons, either way, ties by id; with total and total_pages."""
    column = {"score": F.col("score"), "time": F.col("updated_at") if "updated_at" in registry.columns else None, "reasons": F.size("reasons")}[by]
    return page(registry, [column.desc() if descending else column.asc(), F.col("user_id")], number, size)


def stats(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("added_by") == "auto").alias("auto"),
        F.count_if(F.col("added_by") == "manual").alias("manual"),
        F.count_if(F.col("risk") == "high").alias("high"),
        F.count_if(F.col("risk") == "medium").alias("medium"),
        F.count_if(F.col("risk") == "low").alias("low"),
        F.round(F.avg("score"), 1).alias("avg_score"),
    )


def remove(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("user_id"), "user_id", "left_anti")


def removed_count(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: how many registry rows the ids of ``gone`` remove, and how many stay."""
    marked = registry.select("user_id").join(gone.select("user_id").distinct().withColumn("hit", F.lit(True)), "user_id", "left")
    return marked.agg(F.count("hit").alias("removed"), (F.count("*") - F.count("hit")).alias("kept"))


def with_notes(registry: DataFrame, user_id: int, notes: str) -> DataFrame:
    return registry.withColumn("notes", F.when(F.col("user_id") == user_id, notes).otherwise(F.col("notes")))


def fill_avatars(registry: DataFrame, comments: DataFrame) -> DataFrame:
    """Empty avatars from the first comment that shows one."""
    seen = comments.filter("avatar <> ''").groupBy("user_id").agg(F.min_by("avatar", "seq").alias("seen"))
    return registry.join(seen, "user_id", "left").withColumn("avatar", F.coalesce(F.nullif(F.col("avatar"), F.lit("")), "seen", F.lit(""))).drop("seen")


def reason_text(added_by: Column, score: Column) -> Column:
    """What a registry row says where no reason was given."""
    return F.when(added_by == "manual", "added by hand").otherwise(F.format_string("score %.1f in the analysis", score))


def exported(registry: DataFrame) -> DataFrame:
    """Flat rows for CSV or JSON: counts in place of the nested columns."""
    return registry.select("user_id", "user_name", "score", "risk", "added_by", F.size("reasons").cast("long").alias("reasons_count"), F.size("sources").cast("long").alias("sources_count"))

"""Weighted score, bonuses, risk bands, statistics, rankings and the fusion with verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each feature; they add up to 1.
WEIGHTS = {
    "f1": 0.08,
    "f2": 0.06,
    "f3": 0.13,
    "f4": 0.08,
    "f5": 0.11,
    "f6": 0.11,
    "f7": 0.02,
    "f8": 0.06,
    "f12": 0.23,
    "f14": 0.03,
    "f15": 0.04,
    "f16": 0.02,
    "f18": 0.03,
}
HIGH, MEDIUM = 60, 30


@dataclass(frozen=True)
class ScoringConfig:
    """Weights of the features and lower bounds of the bands."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    high: float = HIGH
    medium: float = MEDIUM


def risk(score: Column, config: ScoringConfig = ScoringConfig()) -> Column:
    return F.when(score >= config.high, "high").when(score >= config.medium, "medium").otherwise("low")


def weighted(config: ScoringConfig = ScoringConfig()) -> Column:
    return sum((F.coalesce(F.col(name), F.lit(0.0)) * weight for name, weight in config.weights.items()), F.lit(0.0))


def bonuses() -> list[tuple[str, Column]]:
    """Name and size of each bonus; the skeleton feature counts in fifths, so it is compared as an integer."""
    fifths = F.round(F.col("f12") * 5).cast("int")
    return [
        ("empty account", F.when(fifths >= 5, 0.35).when(fifths == 4, 0.30).when(fifths == 3, 0.25).when(fifths == 2, 0.20).otherwise(0.0)),
        ("empty account without picture", F.when((F.col("f12") >= 0.5) & (F.col("f4") >= 0.25), 0.15).otherwise(0.0)),
        ("post lexicon", F.when(F.col("f14") >= 1, 0.20).otherwise(0.0)),
        ("spam lexicon", F.when(F.col("f15") >= 1, 0.20).otherwise(0.0)),
        ("signature lexicon", F.when(F.col("f18") >= 0.5, 0.15).otherwise(0.0)),
    ]


def with_scores(features: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Adds score (0..100, one decimal), risk and signals (the bonuses that fired)."""
    parts = bonuses()
    total = F.least(F.lit(1.0), weighted(config) + sum((b for _, b in parts), F.lit(0.0)))
    signals = F.array_compact(F.array(*[F.when(b > 0, name) for name, b in parts]))
    out = features.withColumn("score", F.round(F.round(total * 100, 6), 1))
    return out.withColumn("risk", risk(F.col("score"), config)).withColumn("signals", signals)


def risk_statistics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Users, users by band and mean score (one decimal) of each key."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total_users"),
        F.count_if(F.col("score") >= HIGH).alias("high"),
        F.count_if((F.col("score") >= MEDIUM) & (F.col("score") < HIGH)).alias("medium"),
        F.count_if(F.col("score") < MEDIUM).alias("low"),
        F.round(F.avg("score"), 1).alias("avg_score"),
    )


def score_distribution(scored: DataFrame, key: str) -> DataFrame:
    """Users in [0,20) ... [80,100] of each key; buckets without any are 0."""
    bucket = F.least(F.lit(4), F.floor(F.col("score") / 20)).cast("int")
    counts = scored.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    spine = scored.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return spine.join(counts, [key, "bucket"], "left").select(key, "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(scored: DataFrame, key: str, *tie: str) -> DataFrame:
    """Rank by score inside each key, ties in order of arrival."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *tie)))


def top_features(scored: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The largest features of each row that are above 0.3, in percent; equal values by name. First the n, then the limit."""
    entries = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f), F.lit(0.0))).alias("minus"), F.lit(f).alias("name")) for f in WEIGHTS]))
    best = F.filter(F.slice(entries, 1, n), lambda e: -e["minus"] > 0.3)
    shown = scored.select(*keys, F.posexplode(best).alias("pos", "e"))
    return shown.select(*keys, (F.col("pos") + 1).cast("long").alias("rank"), F.col("e.name").alias("feature"), F.round(-F.col("e.minus") * 100, 1).alias("percent"))


def candidates(scored: DataFrame, limit: float = 20, most: int = 50) -> DataFrame:
    """The highest scores of each content for review."""
    rank = F.row_number().over(Window.partitionBy("content_id").orderBy(F.desc("score"), "seq"))
    return scored.filter(F.col("score") >= limit).withColumn("rank", rank).filter(F.col("rank") <= most)


def clamp_threshold(value: Column) -> Column:
    return F.greatest(F.lit(10), F.least(F.lit(70), value))


def batches(rows: DataFrame, size: int, *order: Column, most: int = 10) -> DataFrame:
    """The first ``most`` groups of ``size`` rows of each content, numbered; the limit keeps a task's rows few."""
    position = F.row_number().over(Window.partitionBy("content_id").orderBy(*order))
    numbered = rows.withColumn("position", position).filter(F.col("position") <= size * most)
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def shown_features(least: float = 0.3) -> Column:
    """The features that reach ``least``, largest first, as a line of names and percents."""
    entries = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f), F.lit(0.0))).alias("minus"), F.lit(f).alias("name")) for f in WEIGHTS]))
    kept = F.filter(entries, lambda e: -e["minus"] >= least)
    return F.array_join(F.transform(kept, lambda e: F.format_string("%s %d%%", e["name"], F.round(-e["minus"] * 100).cast("int"))), ", ")


def review_packets(scored: DataFrame, comments: DataFrame, profiles: DataFrame, size: int = 5, most: int = 10, n_comments: int = 3, cut: int = 100) -> DataFrame:
    """(content_id, batch, packet): a text for each group of candidates, with score, features, profile and first comments.

    ``profiles`` has user_id and line; comments are gathered for the candidates only."""
    chosen = batches(scored, size, F.desc("score"), F.col("user_id"), most=most).select("content_id", "user_id", "score", "position", "batch", shown_features().alias("shown"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    first = comments.join(chosen.select("user_id").distinct(), "user_id", "left_semi").withColumn("k", rank).filter(F.col("k") <= n_comments)
    said = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", F.substring(F.coalesce("text", F.lit("")), 1, cut).alias("text")))).alias("said"))
    rows = chosen.join(profiles.select("user_id", "line"), "user_id", "left").join(said, "user_id", "left")
    parts = F.concat_ws(
        "\n",
        F.format_string("user %d: score %.1f", "user_id", "score"),
        F.when(F.col("shown") != "", F.concat(F.lit("features: "), "shown")),
        F.concat(F.lit("profile: "), "line"),
        F.concat(F.lit("comments: "), F.array_join(F.transform("said", lambda x: x["text"]), " | ")),
    )
    lines = rows.groupBy("content_id", "batch").agg(F.array_sort(F.collect_list(F.struct("position", parts.alias("part")))).alias("parts"))
    return lines.select("content_id", "batch", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("packet"))


def merged_verdicts(report: DataFrame, verdicts: DataFrame, key: str = "user_id") -> DataFrame:
    """Report rows with the columns of newer verdicts (for many users or one); a verdict without a value keeps the old one."""
    new = verdicts.select(key, *[F.col(c).alias(f"new_{c}") for c in verdicts.columns if c != key])
    rows = report.join(new, key, "left")
    kept = [F.coalesce(f"new_{c}", c).alias(c) if c in verdicts.columns and c != key else F.col(c) for c in report.columns]
    added = [F.col(f"new_{c}").alias(c) for c in verdicts.columns if c not in report.columns]
    return rows.select(*kept, *added)


def unit(value: Column) -> Column:
    """Scores and confidences on one scale, 0..1."""
    return F.when(value > 1, value / 100).otherwise(value)


def fuse_first(scored: DataFrame, verdicts: DataFrame, rule_share: float = 0.75) -> DataFrame:
    """Engine score and a first verdict: a positive type moves the score, a negative one leaves it and asks for review."""
    rows = scored.join(verdicts, "user_id", "left")
    engine = unit(F.col("score"))
    positive = F.coalesce(F.col("type_id") > 0, F.lit(False))
    fused = F.when(positive, rule_share * engine + (1 - rule_share) * unit(F.col("confidence"))).otherwise(engine)
    note = F.when(F.col("type_id").isNotNull() & ~positive & (engine >= 0.5), "verdict differs from engine: review")
    out = rows.select(*scored.columns, "type_id", "confidence", F.round(fused * 100, 6).alias("fused"), note.alias("review_note"))
    return out.withColumn("fused_risk", risk(F.col("fused")))


def fuse_second(scored: DataFrame, first: DataFrame, deep: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Engine score, first and deep verdict; the deep verdict counts where its type is positive, its row is marked analysed.
    With ``history`` (user_id, n_history, last_at), each user's own goes with its row; without one there are 0 entries."""
    one = first.select("user_id", F.col("confidence").alias("confidence1"))
    two = deep.select("user_id", F.col("type_id").alias("deep_type"), F.col("confidence").alias("confidence2"))
    rows = scored.join(one, "user_id", "left").join(two, "user_id", "left")
    fused = 0.50 * unit(F.col("score")) + 0.25 * unit(F.coalesce("confidence1", F.lit(0.0))) + 0.25 * unit(F.coalesce("confidence2", F.lit(0.0)))
    out = rows.withColumn("deep_analysed", F.col("deep_type").isNotNull()).withColumn("fused", F.round(F.when(F.col("deep_type") > 0, fused).otherwise(unit(F.col("score"))) * 100, 6))
    out = out.withColumn("fused_risk", risk(F.col("fused")))
    return out if history is None else out.join(history, "user_id", "left").withColumn("n_history", F.coalesce("n_history", F.lit(0)).cast("long"))


def verdict_defaults(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict for every user: type 0, confidence 0 and a note where there is none."""
    rows = scored.select("user_id").join(verdicts, "user_id", "left")
    return rows.select("user_id", F.coalesce("type_id", F.lit(0)).alias("type_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("type_id").isNull(), "not analysed").otherwise("analysed").alias("status"))


VERDICT = "mid long, type_id int, type_name string, confidence double, reasoning string, deep_type_id int, deep_type_name string, deep_confidence double, deep_reasoning string, risk_confirmed boolean, key_evidence array<string>"
#: Names under which a deep verdict gives the fields of a plain one.
ALIASES = {"type_id": "deep_type_id", "type_name": "deep_type_name", "confidence": "deep_confidence", "reasoning": "deep_reasoning"}


def parse_verdicts(replies: DataFrame, key: str, text: str = "reply") -> DataFrame:
    """Rows of model replies: the whole text as JSON, a fenced block, or the outermost braces; an object with ``results``,
    one verdict, or an array. Rows without a user are left out; a reply that cannot be read gives none."""
    col = F.col(text)
    bodies = F.array(col, F.regexp_extract(col, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(col, r"(?s)(\{.*\})", 1), F.regexp_extract(col, r"(?s)(\[.*\])", 1))

    def read(body: Column) -> Column:
        held = F.from_json(body, f"results array<struct<{VERDICT.replace(' ', ':').replace(',:', ',')}>>")["results"]
        one = F.from_json(body, VERDICT)
        many = F.when(F.trim(body).startswith("["), F.from_json(body, f"array<struct<{VERDICT.replace(' ', ':').replace(',:', ',')}>>"))
        return F.coalesce(held, many, F.when(one["mid"].isNotNull(), F.array(one)))

    tried = F.filter(F.transform(bodies, read), lambda r: r.isNotNull() & (F.size(r) > 0))
    rows = replies.select(key, F.explode(F.get(tried, F.lit(0))).alias("v")).select(key, "v.*").filter("mid IS NOT NULL")
    rows = rows.withColumns({name: F.coalesce(deep, name) for name, deep in ALIASES.items()}).drop(*ALIASES.values())
    return rows.withColumns({"risk_confirmed": F.coalesce("risk_confirmed", F.lit(False)), "key_evidence": F.coalesce("key_evidence", F.array().cast("array<string>"))})

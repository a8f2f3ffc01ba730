"""Monthly histories of a topic and of one relation, with gap filling.

Gaps are filled by a generated month spine (``sequence`` + ``explode``): ``fill_months``
left-joins it to the monthly rows; the histories look months up in a per-key map of at most
one entry per calendar month - never by pairing rows with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotopic.functions.labels import month_label, month_start, month_tick, numbered_list
from cotopic.operators.topics import hit_counts, spread_join, state_rows
from cotopic.schema import MIN_COUNT, TOP_PER_MONTH


def _one_month():
    return F.expr("INTERVAL 1 MONTH")


def month_spine(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Every month start from the first to the last ``month`` of each key group."""
    bounds = df.where(F.col(month).isNotNull()).groupBy(*keys).agg(
        F.min(month).alias("_lo"), F.max(month).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", _one_month())).alias(month))


def fill_months(df: DataFrame, keys: list[str], fill: dict, month: str = "month",
                spine: DataFrame | None = None) -> DataFrame:
    """Left-join ``df`` onto its month spine and replace missing values by ``fill``."""
    spine = month_spine(df, keys, month) if spine is None else spine
    out = spine.join(df, [*keys, month], "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def monthly_articles(hits: DataFrame) -> DataFrame:
    """``topic, timestamp, articles``: hit articles per month, counting known archive URLs."""
    return hit_counts(hits, "timestamp").select("topic", "timestamp", F.col("archived").alias("articles"))


def monthly_mentions(hits: DataFrame, exclude_topic: bool = True) -> DataFrame:
    """``topic, timestamp, keyword, mentions`` (topic excluded from its own list)."""
    rows = state_rows(hits, "timestamp")
    if exclude_topic:
        rows = rows.where(F.col("keyword") != F.col("topic"))
    return rows.groupBy("topic", "timestamp", "keyword").agg(F.sum("n").alias("mentions"))


def monthly_top_keywords(hits: DataFrame, k: int = TOP_PER_MONTH) -> DataFrame:
    """``topic, timestamp, rank, keyword, mentions``: the k most mentioned keywords a month.

    Ties go to the keyword that sorts first. Spark plans the rank filter as a
    ``WindowGroupLimit`` before the shuffle, so no month group is collected whole.
    """
    w = Window.partitionBy("topic", "timestamp").orderBy(F.desc("mentions"), F.asc("keyword"))
    return (monthly_mentions(hits)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def topic_history(hits: DataFrame, k: int = TOP_PER_MONTH, sep: str = "<br>",
                  keep_topic_only_months: bool = False) -> DataFrame:
    """``topic, month, articles, top_label, month_label`` over a gap-free month range.

    Default (reference-exact): months whose hits mention no keyword besides the topic have
    no top list and are dropped before gap filling, so inside the range they come back with
    0 articles and at the edges they shorten it. ``keep_topic_only_months=True`` keeps them.

    One pipeline, no self join: a single aggregate per (topic, month, keyword) carries both
    the mentions and ``count(archive)``; every hit holds its topic, so the topic's own row
    counts the month's articles. Ranking puts that row first and keeps ``k + 1`` rows per
    month (a ``WindowGroupLimit`` before the shuffle). Months are then collected per topic
    - at most one entry per calendar month - and the spine is generated from their range
    and filled by map lookup.
    """
    rows = state_rows(hits, "timestamp").where(F.col("timestamp").isNotNull())
    per = rows.groupBy("topic", "timestamp", "keyword").agg(
        F.sum("n").alias("mentions"), F.sum("archived").alias("_arts"))
    own = F.col("keyword") == F.col("topic")
    w = Window.partitionBy("topic", "timestamp").orderBy(own.desc(), F.desc("mentions"), F.asc("keyword"))
    ranked = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    listed = F.when(~own, F.struct(F.col("rank"), F.col("keyword")))
    months = (ranked.groupBy("topic", "timestamp")
              .agg(F.max(F.when(own, F.col("_arts"))).alias("articles"),
                   F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["keyword"]).alias("top")))
    if not keep_topic_only_months:
        months = months.where(F.size("top") > 0)
    months = months.where(F.col("articles").isNotNull()).withColumn("month", month_start("timestamp"))
    entry = F.struct(F.col("articles"), F.col("top"))
    per_topic = months.where(F.col("month").isNotNull()).groupBy("topic").agg(
        F.map_from_entries(F.collect_list(F.struct("month", entry))).alias("_m"),
        F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    filled = per_topic.select("topic", "_m", F.explode(F.sequence("_lo", "_hi", _one_month())).alias("month"))
    hit = F.col("_m")[F.col("month")]
    return filled.select(
        "topic",
        month_tick("month").alias("month"),
        F.coalesce(hit["articles"], F.lit(0)).alias("articles"),
        numbered_list(F.when(F.size(hit["top"]) > 0, hit["top"]), sep).alias("top_label"),
        month_label("month").alias("month_label"),
    )


def relation_history(hits: DataFrame, rel: DataFrame | None = None, min_count: int = MIN_COUNT,
                     include_topic: bool = False) -> DataFrame:
    """``topic, keyword, month, articles, mentions`` for every keyword of the relation set.

    ``articles`` are the topic's hit articles of the month, ``mentions`` those of the
    keyword; the range is the topic's first to last hit month.

    One aggregate of the hits: mentions and articles per (topic, keyword, month), gathered to one row a keyword (a map of at most one
    entry per calendar month). The topic's own row holds its articles a month and is joined to its keywords, one row a topic; both sides read the
    same exchange. The months are generated last, so no row of a month without mentions is ever shuffled.
    """
    per = (state_rows(hits, "timestamp").groupBy("topic", "keyword", "timestamp")
           .agg(F.sum("n").alias("n"), F.sum("archived").alias("archived")).withColumn("month", month_start("timestamp")))
    entry = F.when(F.col("month").isNotNull(), F.struct("month", F.struct("n", "archived")))
    kw = per.groupBy("topic", "keyword").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_m"), F.sum("n").alias("_count"),
        F.max(F.col("keyword") == F.col("topic")).alias("_own"))
    # both sides keep all columns of the aggregate, so that Spark computes it once
    own = kw.where(F.col("_own") & (F.col("_count") > 0)).select("topic", F.col("_m").alias("_t"))
    own = own.withColumn("_months", F.map_keys("_t")).select(
        "topic", "_t", F.array_min("_months").alias("_lo"), F.array_max("_months").alias("_hi"))
    if rel is not None:
        kw = kw.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    else:
        kw = kw.where((F.col("_count") >= min_count) & (F.lit(include_topic) | ~F.col("_own")))
    filled = (spread_join(kw, own.where(F.col("_lo").isNotNull()), "topic", "keyword")
              .select("topic", "keyword", "_m", "_t", F.explode(F.sequence("_lo", "_hi", _one_month())).alias("month")))
    zero = F.lit(0).cast("long")
    return filled.select(
        "topic", "keyword", month_tick("month").alias("month"),
        F.coalesce(F.col("_t")[F.col("month")]["archived"], zero).alias("articles"),
        F.coalesce(F.col("_m")[F.col("month")]["n"], zero).alias("mentions"))


def ordered_history(history: DataFrame) -> DataFrame:
    """Presentation order of a history: by month within topic (and keyword), a global sort for output."""
    return history.orderBy(*[c for c in ("topic", "keyword", "month") if c in history.columns])


def history_peak(history: DataFrame, cols: list[str], keys: list[str] = ("topic",), headroom: float = 1.1) -> DataFrame:
    """Top of a chart: the largest value of ``cols`` per key, times ``headroom``."""
    peak = F.greatest(*[F.max(c) for c in cols]) if len(cols) > 1 else F.max(cols[0])
    return history.groupBy(*keys).agg((peak.cast("double") * F.lit(headroom)).alias("peak"))

"""Topic hits and the reports over them.

Every operator is lazy, DataFrame in / DataFrame out, and keeps a ``topic`` column, so one
plan serves one topic, a list of topics, a table of topics or all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotopic.functions.labels import yyyymm_label
from cotopic.schema import MIN_MENTIONS

Topics = str | Iterable[str] | DataFrame | None

BROADCAST_TOPICS = 100_000  # topics of a table that may be broadcast
LITERAL_TOPICS = 256
KEY_PARTS = 16  # parts of one key's rows in a join with one row a key (a power of two)


def mentions(news: DataFrame) -> DataFrame:
    """One row per (article, keyword) with a known mention count: ``id, keyword, n``."""
    return (news.select("id", F.explode("keywords").alias("keyword", "n"))
                .where(F.col("n").isNotNull()))


def topic_hits(news: DataFrame, topics: Topics, min_mentions: int = MIN_MENTIONS) -> DataFrame:
    """Articles mentioning a topic strictly more than ``min_mentions`` times.

    One row per (article, topic) with all article columns plus ``topic``.

    * ``str``: a single map lookup per article, a narrow filter.
    * list of strings: the article map is filtered to the listed topics and exploded (the
      list becomes literals in the plan: meant for a handful of topics; pass a DataFrame
      for large topic sets).
    * ``None``: every keyword of an article with enough mentions is a topic (all topics).
    * DataFrame with a ``topic`` column: up to ``BROADCAST_TOPICS`` topics (read first; a list up to ``LITERAL_TOPICS``) are broadcast
      and met inside the article's row, so no map is shuffled. Beyond that, slim (article id, topic) rows meet the table in a semi join, each article's
      topics are gathered again, and the article columns are joined once per article. Every
      topic is looked up in the article's own map, so articles that share an id keep their own.
    """
    if isinstance(topics, str):
        t = F.lit(topics)
        return news.where(F.col("keywords")[t] > min_mentions).withColumn("topic", t)
    if isinstance(topics, DataFrame):
        allowed = topics.select("topic").where(F.col("topic").isNotNull()).distinct()
        enough = F.map_filter("keywords", lambda k, v: v > min_mentions)
        few = [r["topic"] for r in allowed.limit(BROADCAST_TOPICS + 1).collect()]
        if len(few) <= LITERAL_TOPICS:
            return topic_hits(news, few, min_mentions)
        if len(few) <= BROADCAST_TOPICS:
            met = news.sparkSession.createDataFrame([(t,) for t in few], "topic string")
            return (news.select(*news.columns, F.explode(F.map_keys(enough)).alias("topic"))
                        .join(F.broadcast(met), "topic", "left_semi").select(*news.columns, "topic"))
        wanted = (news.select("id", F.explode(F.map_keys(enough)).alias("topic"))
                      .join(allowed, "topic", "left_semi")
                      .groupBy(F.col("id").alias("_id")).agg(F.collect_set("topic").alias("_topics")))
        return (news.join(wanted, F.col("id").eqNullSafe(F.col("_id")))
                    .select(*news.columns, F.explode("_topics").alias("topic"))
                    .where(F.col("keywords")[F.col("topic")] > min_mentions))
    if topics is None:
        keep = lambda k, v: v > min_mentions
    else:
        names = sorted(set(topics))
        keep = lambda k, v: (v > min_mentions) & k.isin(names)
    cols = [c for c in news.columns]
    return (news.select(*cols, F.explode(F.map_filter("keywords", keep)).alias("topic", "_topic_n"))
                .drop("_topic_n"))


def mention_rows(hits: DataFrame, *cols: str) -> DataFrame:
    """Hits exploded to one row per (article, topic, keyword) with a known count."""
    keep = ["topic", *cols]
    return (hits.select(*keep, F.explode("keywords").alias("keyword", "n"))
                .where(F.col("n").isNotNull()))


STATES = ["n", "tone_sum", "tone_n", "articles", "archived"]  # sums of a group of mentions
EXTREMES = ["first_archive", "last_archive"]


def state_rows(hits: DataFrame, *keys: str) -> DataFrame:
    """``topic, keyword, *keys`` with mergeable states: mentions ``n``, tone times mentions, mentions with a tone, articles, articles with
    an archive URL, and the smallest and largest URL.

    ``hits`` may be hits - each (hit, keyword) with a known count is the state of one article - or a table of states itself, say
    of many batches: every report sums whatever rows it gets. Columns a report does not use are pruned.
    """
    if "keywords" not in hits.columns:
        return hits.select("topic", "keyword", *keys, *STATES, *EXTREMES)
    tone = F.col("sentiment").cast("double")
    rows = mention_rows(hits, *dict.fromkeys([*keys, "sentiment", "archive"]))
    return rows.select("topic", "keyword", *keys, "n", (tone * F.col("n")).alias("tone_sum"),
                       F.when(tone.isNotNull(), F.col("n")).alias("tone_n"), F.lit(1).alias("articles"),
                       F.col("archive").isNotNull().cast("int").alias("archived"),
                       F.col("archive").alias("first_archive"), F.col("archive").alias("last_archive"))


def merge_states(rows: DataFrame, *keys: str) -> DataFrame:
    """State rows summed per ``topic, keyword, *keys``."""
    return rows.groupBy("topic", "keyword", *keys).agg(
        *[F.sum(c).alias(c) for c in STATES], F.min("first_archive").alias("first_archive"), F.max("last_archive").alias("last_archive"))


def hit_counts(hits: DataFrame, *keys: str) -> DataFrame:
    """``topic, *keys, articles, archived``: the topic's hits, and those with an archive URL. Every hit mentions its topic, so
    in a table of states these are the topic's own rows."""
    if "keywords" in hits.columns:
        return hits.groupBy("topic", *keys).agg(F.count(F.lit(1)).alias("articles"), F.count("archive").alias("archived"))
    own = hits.where(F.col("keyword") == F.col("topic"))
    return own.groupBy("topic", *keys).agg(F.sum("articles").alias("articles"), F.sum("archived").alias("archived"))


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with one row per ``key``, dealt by a hash of column ``by`` over ``KEY_PARTS`` parts: a key with a third of all rows is
    no single task's work, and the join keeps an equality where ``key`` is one constant."""
    part = F.xxhash64(by).bitwiseAND(F.lit(KEY_PARTS - 1).cast("long"))  # never null: no filter on it is pushed into ``rows``
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1)).cast("array<long>")))
    return rows.withColumn("_part", part).join(copies, [key, "_part"]).drop("_part")


def corpus_summary(news: DataFrame) -> DataFrame:
    """Number of articles (malformed rows included), first and last month."""
    return news.agg(
        F.count(F.lit(1)).alias("articles"),
        F.min("timestamp").alias("first_month"),
        F.max("timestamp").alias("last_month"),
    )


def topic_summary(hits: DataFrame) -> DataFrame:
    """Per topic: hit count, first month and its label."""
    per = hit_counts(hits, "timestamp").groupBy("topic")  # one row a month
    return (per.agg(F.sum("articles").alias("articles"), F.min("timestamp").alias("first_month"))
               .withColumn("first_label", yyyymm_label("first_month")))


def topic_sources(hits: DataFrame) -> DataFrame:
    """Hit articles per outlet (null outlet is a group) and their share in percent.

    The share window runs over the already aggregated (topic, source) rows: one small
    group per topic.
    """
    per = hit_counts(hits, "source").drop("archived")
    total = F.sum("articles").over(Window.partitionBy("topic"))
    return per.withColumn("pct", F.col("articles") * F.lit(100.0) / total)

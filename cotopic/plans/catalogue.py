"""The query catalogue: every report of the library over the corpora derived from the
driver tables. Each entry maps a ``Corpus`` to a DataFrame with stable, aliased columns.

Star corpus topic: ``red gear``; text corpus topic: ``the``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotopic.operators import (
    OUTLETS, match_outlet, corpus_summary, history_peak, keyword_weights, mentions, monthly_articles, monthly_mentions,
    monthly_top_keywords, neighbours, newest_articles, outlet_of, recommend, relation_articles, relation_exists,
    relation_history, relation_months, relation_nodes, relation_sources, relation_summary,
    relation_years, relations, relations_nested, sentiment_quantiles, sentiment_thresholds,
    topic_history, topic_hits, topic_sources, topic_summary, top_relations,
)
from cotopic.functions import outlet_host, topic_key
from cotopic.session import persisted, scratch_path
from cotopic.sources.fixtures import star_news, table, text_news
from cotopic.plans.report import relation_detail, stored_detail, topic_search
from cotopic.sources.layout import read_hits, write_search_layout
from cotopic.sources.news import (
    read_news, read_news_checked, read_relations_json, summary_from_statistics, write_news, write_relations_json,
)
from cotopic.sources.records import RecordStore
from cotopic.sources.store import STORED, RelationStore

# Query parameters.
STAR_TOPIC = "red gear"
TOPIC_LIST = ["red gear", "hot ring", "blue ring"]
TEXT_TOPIC = "the"
HISTORY_MIN_MENTIONS = 40  # so that the star corpus history has gaps at sf 0.01
SMALL_TOP = 20  # a top-N smaller than the neighbour set, so the cut is exercised
SEED = 42
GROWN_MONTH = 199501  # the month from which articles come to the record store later
NEWEST = 3
BROKEN = 97  # every so many articles also leave a broken line
DIGITS = 9  # doubles are reported rounded to this many decimals


class Corpus:
    """The corpora of one scale factor. Built lazily; a bench may pass materialized ones."""

    def __init__(self, spark: SparkSession, sf_dir: str, star: DataFrame | None = None,
                 text: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        if star is not None:
            self.__dict__["star"] = star
        if text is not None:
            self.__dict__["text"] = text

    @cached_property
    def star(self) -> DataFrame:
        return star_news(self.spark, self.sf_dir)

    @cached_property
    def text(self) -> DataFrame:
        return text_news(self.spark, self.sf_dir)

    @cached_property
    def records(self) -> RecordStore:
        """A record store that has grown with the star corpus: its first years and one topic, then the rest and two more topics."""
        files = scratch_path(self.spark, "growing-news")
        store = RecordStore(self.spark, scratch_path(self.spark, "record-store"))
        early = F.coalesce(F.col("timestamp") < GROWN_MONTH, F.lit(False))
        write_news(self.star.where(early), files, fmt="parquet")
        store.refresh(files, fmt="parquet", topics=TOPIC_LIST[:1])
        write_news(self.star.where(~early), files, fmt="parquet")
        store.refresh(files, fmt="parquet", topics=TOPIC_LIST)
        return store

    def hits(self, min_mentions: int = 4) -> DataFrame:
        return topic_hits(self.star, STAR_TOPIC, min_mentions)

    def rel(self) -> DataFrame:
        return relations(self.hits())


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to ``DIGITS`` decimals (stable comparison across engines)."""
    return df.select(*[F.round(F.col(f.name), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def q_corpus_summary(c: Corpus) -> DataFrame:
    return corpus_summary(c.star)


def q_read_status_partition(c: Corpus) -> DataFrame:
    root = scratch_path(c.spark, "news-json")
    write_news(c.star, root, status="success")
    write_news(c.text, root, status="failed")
    return read_news(c.spark, root, fmt="json", status="success").select("id", "timestamp")


def q_mentions(c: Corpus) -> DataFrame:
    return mentions(c.star)


def q_topic_hits(c: Corpus) -> DataFrame:
    return c.hits().select("id", "timestamp", "source")


def q_topic_hits_layout(c: Corpus) -> DataFrame:
    path = scratch_path(c.spark, "search-layout")
    write_search_layout(c.star, path)
    return read_hits(c.spark, path, STAR_TOPIC).select("id", "timestamp", "source")


def q_topic_summary(c: Corpus) -> DataFrame:
    return topic_summary(c.hits()).select("articles", "first_month", "first_label")


def q_topic_sources(c: Corpus) -> DataFrame:
    return rounded(topic_sources(c.hits()).select("source", "articles", "pct"))


def q_monthly_articles(c: Corpus) -> DataFrame:
    return monthly_articles(c.hits()).select("timestamp", "articles")


def q_monthly_mentions(c: Corpus) -> DataFrame:
    return monthly_mentions(c.hits()).select("timestamp", "keyword", "mentions")


def q_monthly_top_keywords(c: Corpus) -> DataFrame:
    return monthly_top_keywords(c.hits()).select("timestamp", F.col("rank").cast("long").alias("rank"), "keyword")


def q_topic_history(c: Corpus) -> DataFrame:
    return topic_history(c.hits(HISTORY_MIN_MENTIONS)).select("month", "articles", "top_label", "month_label")


def q_history_peak(c: Corpus) -> DataFrame:
    return rounded(history_peak(topic_history(c.hits()), ["articles"]).select("peak"))


def q_relations(c: Corpus) -> DataFrame:
    return rounded(c.rel().select("keyword", "count", "sentiment"))


def q_relation_months(c: Corpus) -> DataFrame:
    return relation_months(c.hits()).select("keyword", "timestamp", "mentions")


def q_relation_sources(c: Corpus) -> DataFrame:
    return rounded(relation_sources(c.hits()).select("keyword", "source", "articles", "pct"))


def q_relations_nested(c: Corpus) -> DataFrame:
    return relations_nested(c.hits()).select("keyword", "count", F.to_json("date").alias("months_json"))


def q_neighbours_top(c: Corpus) -> DataFrame:
    return top_relations(neighbours(c.rel()), SMALL_TOP).select("keyword", "count")


def q_sentiment_quantiles(c: Corpus) -> DataFrame:
    return rounded(sentiment_quantiles(neighbours(c.rel())).drop("topic"))


def q_sentiment_thresholds(c: Corpus) -> DataFrame:
    return rounded(sentiment_thresholds(neighbours(c.rel()), SMALL_TOP).drop("topic"))


def q_relation_nodes(c: Corpus) -> DataFrame:
    return rounded(relation_nodes(c.rel(), hits=c.hits()).select(
        "keyword", "count", "size", "band", "color", "label", "caption", "first_seen", "last_seen"))


def q_relation_years(c: Corpus) -> DataFrame:
    return relation_years(c.hits()).select("keyword", "year", "mentions")


def q_relation_exists(c: Corpus) -> DataFrame:
    vocabulary = mentions(c.star).select("keyword").distinct()
    return relation_exists(c.rel(), vocabulary).select("keyword", "present")


def q_relation_summary(c: Corpus) -> DataFrame:
    return rounded(relation_summary(c.rel()).select("keyword", "count", "sentiment", "gauge"))


def q_relation_history(c: Corpus) -> DataFrame:
    return relation_history(c.hits()).select("keyword", "month", "articles", "mentions")


def q_relation_articles(c: Corpus) -> DataFrame:
    return relation_articles(c.hits()).select(
        "keyword", "title", "capture_date", "host", "original_url", "outlet", "archive")


def q_outlet_match(c: Corpus) -> DataFrame:
    hosts = (c.star.select(outlet_host("archive").alias("host"))
             .unionByName(c.text.select(outlet_host("archive").alias("host")))
             .distinct())
    return hosts.withColumn("outlet", outlet_of("host"))


def q_recommend(c: Corpus) -> DataFrame:
    return recommend(c.rel(), seed=SEED).select("keyword")


def q_keyword_weights(c: Corpus) -> DataFrame:
    return keyword_weights(c.rel()).select("keyword", "count")


def q_topic_key(c: Corpus) -> DataFrame:
    return mentions(c.star).select("keyword").distinct().withColumn("topic_key", topic_key("keyword"))


def part_topics(c: Corpus) -> DataFrame:
    """A topic table: the part names."""
    return table(c.spark, c.sf_dir, "part").select(F.col("p_name").alias("topic")).distinct()


def q_relations_all_topics(c: Corpus) -> DataFrame:
    return rounded(relations(topic_hits(c.star, part_topics(c))).select("topic", "keyword", "count", "sentiment"))


def q_relation_store_roundtrip(c: Corpus) -> DataFrame:
    store = RelationStore(c.spark, scratch_path(c.spark, "relation-store"))
    store.get_or_compute(c.star, part_topics(c), fingerprint="1")
    return rounded(store.get_or_compute(c.star, part_topics(c), fingerprint="1").select(*STORED))


def q_text_relations(c: Corpus) -> DataFrame:
    return rounded(relations(topic_hits(c.text, TEXT_TOPIC)).select("keyword", "count", "sentiment"))


def q_text_relation_nodes(c: Corpus) -> DataFrame:
    hits = topic_hits(c.text, TEXT_TOPIC)
    return rounded(relation_nodes(relations(hits), hits=hits).select(
        "keyword", "count", "size", "band", "color", "label", "caption", "first_seen", "last_seen"))


def q_text_topic_history(c: Corpus) -> DataFrame:
    return topic_history(topic_hits(c.text, TEXT_TOPIC)).select("month", "articles", "top_label", "month_label")


def q_text_relation_articles(c: Corpus) -> DataFrame:
    return relation_articles(topic_hits(c.text, TEXT_TOPIC)).select(
        "keyword", "title", "capture_date", "host", "original_url", "outlet", "archive")


def q_text_sentiment_quantiles(c: Corpus) -> DataFrame:
    """All-neighbour quantiles of the text topic, by the distributed exact method."""
    neigh = neighbours(relations(topic_hits(c.text, TEXT_TOPIC)))
    return rounded(sentiment_quantiles(neigh, method="distributed").drop("topic"))


def q_relations_topic_list(c: Corpus) -> DataFrame:
    return rounded(relations(topic_hits(c.star, TOPIC_LIST)).select("topic", "keyword", "count", "sentiment"))


def q_outlet_match_table(c: Corpus) -> DataFrame:
    outlets = c.spark.createDataFrame(list(enumerate(OUTLETS)), "position int, token string")
    hosts = c.text.select(outlet_host("archive").alias("host")).distinct()
    return match_outlet(hosts, "host", outlets).select("host", "outlet")


def q_topic_history_default(c: Corpus) -> DataFrame:
    return topic_history(c.hits()).select("month", "articles", "top_label", "month_label")


def q_neighbours_top_default(c: Corpus) -> DataFrame:
    return top_relations(neighbours(c.rel())).select("keyword", "count")


def q_sentiment_thresholds_default(c: Corpus) -> DataFrame:
    return rounded(sentiment_thresholds(neighbours(c.rel())).drop("topic"))


def q_absent_topic(c: Corpus) -> DataFrame:
    """A search for a topic that no article has: no rows, the same columns."""
    return rounded(relations(topic_hits(c.star, "no such part")).select("keyword", "count", "sentiment"))


def q_relation_articles_all(c: Corpus) -> DataFrame:
    """Every article of every relation, copies included."""
    return relation_articles(c.hits(), dedup=False).select("keyword", "archive")


def q_history_peak_two(c: Corpus) -> DataFrame:
    return rounded(history_peak(relation_history(c.hits()), ["articles", "mentions"], ["keyword"]).select("keyword", "peak"))


def q_relation_exists_trimmed(c: Corpus) -> DataFrame:
    padded = mentions(c.star).select(F.concat(F.lit("  "), "keyword", F.lit(" ")).alias("keyword")).distinct()
    return relation_exists(c.rel(), padded).select("keyword", "present")


def q_relations_json_roundtrip(c: Corpus) -> DataFrame:
    """The stored record written as JSON and read back, with all fields of its maps."""
    path = scratch_path(c.spark, "relations-json")
    write_relations_json(relations_nested(c.hits()), path)
    back = read_relations_json(c.spark, path)

    def in_order(m):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return rounded(back.select("keyword", "count", "sentiment", in_order("date").alias("months"), in_order("source").alias("sources")))


def q_search_detail(c: Corpus) -> DataFrame:
    """A whole search and the follow-up of one relation."""
    detail = relation_detail(topic_search(c.star, STAR_TOPIC), "blue ring")
    articles = detail["articles"].groupBy("keyword").agg(F.countDistinct("archive").alias("articles"))
    return detail["summary"].join(articles, "keyword").select("keyword", "count", "articles")


def q_records_relations(c: Corpus) -> DataFrame:
    """The stored relation sets, all columns, summed from two batches of files and two of topics."""
    return rounded(c.records.relations(TOPIC_LIST))


def q_records_months(c: Corpus) -> DataFrame:
    return relation_months(c.records.states(STAR_TOPIC)).select("keyword", "timestamp", "mentions")


def q_records_sources(c: Corpus) -> DataFrame:
    return rounded(relation_sources(c.records.states(STAR_TOPIC)).select("keyword", "source", "articles", "pct"))


def q_records_history(c: Corpus) -> DataFrame:
    return relation_history(c.records.states(STAR_TOPIC)).select("keyword", "month", "articles", "mentions")


def q_records_years(c: Corpus) -> DataFrame:
    return relation_years(c.records.states(STAR_TOPIC)).select("keyword", "year", "mentions")


def q_records_topic_history(c: Corpus) -> DataFrame:
    return topic_history(c.records.states(STAR_TOPIC)).select("month", "articles", "top_label", "month_label")


def q_records_nodes(c: Corpus) -> DataFrame:
    return rounded(relation_nodes(c.records.relations(STAR_TOPIC)).select(
        "keyword", "count", "size", "band", "color", "label", "caption", "first_seen", "last_seen"))


def q_records_articles(c: Corpus) -> DataFrame:
    """Article lists of one relation from postings: no stored map is read."""
    one = neighbours(c.records.relations(STAR_TOPIC)).where(F.col("keyword") == TOPIC_LIST[2])
    return relation_articles(c.records.hits(STAR_TOPIC, [TOPIC_LIST[2]]), one).select(
        "keyword", "title", "capture_date", "host", "original_url", "outlet", "archive")


def q_records_detail(c: Corpus) -> DataFrame:
    """The follow-up of one relation from the record store; the same answer as ``search_detail``."""
    detail = stored_detail(c.records, STAR_TOPIC, f" {TOPIC_LIST[2]} ")
    articles = detail["articles"].groupBy("keyword").agg(F.countDistinct("archive").alias("articles"))
    return detail["summary"].join(articles, "keyword").select("keyword", "count", "articles")


def q_articles_newest(c: Corpus) -> DataFrame:
    return newest_articles(relation_articles(c.hits()), NEWEST).select("keyword", F.col("position").cast("long").alias("position"), "archive")


def q_relations_all_topics_top(c: Corpus) -> DataFrame:
    """The commonest neighbours of every topic: a limit a topic, not topics times vocabulary."""
    return top_relations(neighbours(relations(topic_hits(c.star, None))), NEWEST).select("topic", "keyword", "count")


def q_corpus_summary_statistics(c: Corpus) -> DataFrame:
    """The corpus summary from file statistics; no row is read."""
    path = scratch_path(c.spark, "statistics")
    c.star.write.parquet(path)
    return summary_from_statistics(c.spark, path)


def q_read_rejects(c: Corpus) -> DataFrame:
    """Articles and rejected lines of a directory with broken lines, one month a row."""
    root = scratch_path(c.spark, "broken-news")
    write_news(c.star, root)
    whole = F.to_json(F.struct("id", "timestamp"))
    broken = c.star.where(F.col("id") % BROKEN == 0).select(whole.alias("_l")).select(F.expr("substr(_l, 1, length(_l) - 1)").alias("value"))
    broken.write.mode("append").text(f"{root}/status=success")
    rows, rejects = read_news_checked(c.spark, root, scratch_path(c.spark, "checked-news"))
    per = rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("articles"))
    lost = (rejects.groupBy(F.regexp_extract("line", r'"timestamp":(\d+)', 1).cast("int").alias("_m"))
            .agg(F.count(F.lit(1)).alias("rejected")))
    return (per.join(lost, F.col("timestamp") == F.col("_m"), "left")
            .select("timestamp", "articles", F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected")))


def q_relations_scoped(c: Corpus) -> DataFrame:
    """Two reports of one kept relation set: its size beside each neighbour."""
    with persisted(c.rel()) as rel:
        n = rel.count()
        top = [(r["keyword"], r["count"], n) for r in top_relations(neighbours(rel), SMALL_TOP).collect()]
    return c.spark.createDataFrame(top, "keyword string, count long, relations long")


QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

HEADLINE = ["relations", "topic_history", "relation_nodes", "relations_all_topics"]

"""A corpus laid out for topic searches: an inverted list beside the articles.

A search on the corpus itself reads every article's keyword map, because a map value cannot be pushed into Parquet. Here slim
postings - keyword, mentions, article key - are sorted by keyword, so a topic's hits are one stretch of them (the keyword is a pushed filter, and
row groups of other keywords are skipped), and articles are fetched once by key, with the columns a report uses: only a report over
all neighbours reads keyword maps. Reports on chosen keywords get their counts from the postings of these.

Each mention is stored once more, as a difference of keys and a small count; articles are stored once, whatever the
number of topics they hit. A keyword that a third of all articles have spans many partitions (they are cut by keyword and key).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.schema import MIN_MENTIONS, NEWS

POSTINGS_DDL = "keyword string, n int, key long"
#: Sorted keys are stored as differences, sorted keywords by what they share with the one before.
POSTINGS_FORMAT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
ARTICLES_DDL = "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NEWS.fields)


def keyed_articles(news: DataFrame) -> DataFrame:
    """Articles with a ``key``: unique, ascending inside a file once written (write them before use: keys come from the writing tasks)."""
    return news.select(F.monotonically_increasing_id().alias("key"), *[F.col(f.name) for f in NEWS.fields])


def sorted_postings(articles: DataFrame) -> DataFrame:
    """``keyword, n, key`` of written ``keyed_articles``, sorted by keyword and key across partitions."""
    return (articles.select(F.explode("keywords").alias("keyword", "n"), "key").where(F.col("n").isNotNull())
            .select("keyword", F.col("n").cast("int").alias("n"), "key")
            .repartitionByRange("keyword", "key").sortWithinPartitions("keyword", "key"))


def write_search_layout(news: DataFrame, path: str) -> None:
    """Store ``articles`` and ``postings`` below ``path``. A path that exists is an error."""
    spark = news.sparkSession
    keyed_articles(news).write.option("compression", "zstd").parquet(f"{path}/articles")
    articles = spark.read.schema(ARTICLES_DDL).parquet(f"{path}/articles")
    sorted_postings(articles).write.options(**POSTINGS_FORMAT).parquet(f"{path}/postings")


def hits_by_key(postings: DataFrame, articles: DataFrame, topic: str, min_mentions: int = MIN_MENTIONS,
                keywords: Iterable[str] | None = None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The hits of ``topic`` as ``topic_hits`` gives them, from postings and the articles they name.

    With ``keywords`` the hits' maps hold the topic and these keywords alone, put together from their postings: no stored map is read.
    """
    columns = [f.name for f in NEWS.fields]
    if keywords is None:
        keys = postings.where((F.col("keyword") == topic) & (F.col("n") > min_mentions)).select(*by)
        return articles.join(keys, list(by)).select(*columns, F.lit(topic).alias("topic"))
    wanted = sorted({topic, *keywords})
    own = F.max(F.when(F.col("keyword") == topic, F.col("n"))) > min_mentions
    maps = (postings.where(F.col("keyword").isin(wanted)).groupBy(*by)
            .agg(F.map_from_entries(F.collect_list(F.struct("keyword", "n"))).alias("keywords"), own.alias("_hit")).where("_hit"))
    slim = articles.select(*by, *[c for c in columns if c != "keywords"])
    return slim.join(maps.drop("_hit"), list(by)).select(*columns, F.lit(topic).alias("topic"))


def read_hits(spark: SparkSession, path: str, topic: str, min_mentions: int = MIN_MENTIONS, keywords: Iterable[str] | None = None) -> DataFrame:
    """``hits_by_key`` on a stored layout. A topic without hits gives no rows."""
    postings = spark.read.schema(POSTINGS_DDL).parquet(f"{path}/postings")
    articles = spark.read.schema(ARTICLES_DDL).parquet(f"{path}/articles")
    return hits_by_key(postings, articles, topic, min_mentions, keywords)

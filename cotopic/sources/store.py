"""Relation store: computed relation sets kept as Parquet and served again.

Layout below ``root``::

    data/fp=<fingerprint>/batch=<id>/key_prefix=<2 hex>/part-*.parquet   relation rows + topic_key
    index/fp=<fingerprint>/part-*.parquet                     topic, topic_key, batch, relations

* ``fp`` hashes the corpus content and the two cut-offs, so a changed corpus or changed
  parameters never serve stale results (they land in a new ``fp`` folder).
* ``key_prefix`` (first two hex digits of the topic key) bounds the folder count at 256
  whatever the number of topics; rows are sorted by ``topic_key`` within files
  so Parquet min/max statistics skip row groups of other topics. The write is rebalanced
  by prefix: AQE coalesces small prefixes into few files and splits a prefix made heavy
  by one hot topic across several writers.
* Data of a batch becomes visible only once its index rows are written (a second job
  after the data job commits). A failed or repeated batch leaves unindexed data behind
  that readers ignore; of several committed batches of a topic - a retry after the commit, two callers at
  once - readers take the one of smallest id.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.functions.labels import topic_key
from cotopic.operators.relations import relations
from cotopic.operators.topics import EXTREMES, topic_hits
from cotopic.schema import MIN_COUNT, MIN_MENTIONS
from cotopic.session import scratch_path, scratch_scope
from cotopic.sources.news import materialize

STORED = ["topic", "keyword", "count", "sentiment", "articles", "first_archive", "last_archive"]
NUMBERED_ROWS = 250_000  # articles of one range when their URLs are put in order


def corpus_fingerprint(news: DataFrame, min_mentions: int = MIN_MENTIONS, min_count: int = MIN_COUNT) -> str:
    """16 hex digits over row count, last month, an order-free content hash and the cut-offs.

    A row's map contributes the XOR of its entries' hashes (map order does not matter and
    no per-row sort is needed); rows add up as a wide decimal sum (duplicates count).
    """
    entries = F.aggregate(F.coalesce(F.map_entries("keywords"), F.array().cast("array<struct<key:string,value:int>>")),
                          F.lit(0).cast("long"),
                          lambda acc, e: acc.bitwiseXOR(F.xxhash64(e["key"], e["value"])))
    row_hash = F.xxhash64("timestamp", "source", "archive", "id", "sentiment", entries)
    r = news.agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("m"),
                 F.sum(row_hash.cast("decimal(38,0)")).alias("h")).first()
    raw = f"{r['n']}|{r['m']}|{r['h']}|{min_mentions}|{min_count}"
    return hashlib.sha256(raw.encode()).hexdigest()[:16]


def files_fingerprint(news: DataFrame, min_mentions: int = MIN_MENTIONS, min_count: int = MIN_COUNT, version: str = "") -> str:
    """Fingerprint of the files that ``news`` reads (a scan, filters and projections allowed), a caller's ``version`` of how they
    are read, and the cut-offs; equal in every session. No column is read: path, size and modification time are
    hashed and summed by Spark, so the driver holds no list of files."""
    m = news.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    r = m.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*m.columns).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(json.dumps([str(r["n"]), str(r["h"]), version, min_mentions, min_count]).encode()).hexdigest()[:16]


def number_urls(news: DataFrame, path: str, rows: int = NUMBERED_ROWS) -> DataFrame:
    """``news``, kept below ``path``, with ``_at``: a number per row in order of ``archive`` (null: null).

    Extremes of numbers are summed up by hash, those of strings only after a sort of every exploded mention. Each article is sorted
    once instead, in ranges of about ``rows`` articles, however many there are; rows without an URL or of one URL are spread by hash.
    """
    kept = materialize(news, f"{path}/news")
    ranges = max(int(news.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // rows))
    spread = F.xxhash64("id", "timestamp", "source")
    ordered = kept.repartitionByRange(ranges, F.col("archive"), spread).sortWithinPartitions("archive")
    number = F.when(F.col("archive").isNotNull(), F.monotonically_increasing_id())
    return materialize(ordered.withColumn("_at", number), f"{path}/numbered")


def urls_of_numbers(rel: DataFrame, numbered: DataFrame) -> DataFrame:
    """``rel`` with the numbers in its ``EXTREMES`` replaced by the URLs they stand for. ``rel`` is read several times."""
    wanted = rel.select(F.explode(F.array(*EXTREMES)).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    urls = numbered.select("_at", "archive").join(wanted, "_at", "left_semi")
    for c in EXTREMES:
        rel = rel.withColumnRenamed(c, f"_{c}").join(urls.select(F.col("_at").alias(f"_{c}"), F.col("archive").alias(c)), f"_{c}", "left").drop(f"_{c}")
    return rel


class RelationStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def data_path(self) -> str:
        return f"{self.root}/data"

    @property
    def index_path(self) -> str:
        return f"{self.root}/index"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def index(self, fp: str) -> DataFrame:
        if not self._exists(self.index_path):
            return self.spark.createDataFrame([], "topic string, topic_key string, batch string, relations long")
        return (self.spark.read.parquet(self.index_path).where(F.col("fp") == fp)
                .select("topic", "topic_key", "batch", "relations"))

    def read(self, fp: str, topics: Iterable[str] | DataFrame | None = None) -> DataFrame:
        """Committed relation rows of ``topics`` (all stored topics when None)."""
        if not self._exists(self.data_path):
            return self.spark.createDataFrame(
                [], "topic string, keyword string, count long, sentiment double, articles long, "
                    "first_archive string, last_archive string")
        data = self.spark.read.parquet(self.data_path).where(F.col("fp") == fp)
        idx = self.index(fp).groupBy("topic").agg(F.min("batch").alias("batch"))  # one committed batch a topic
        if isinstance(topics, DataFrame):
            idx = idx.join(topics.select("topic").distinct(), "topic", "left_semi")
        elif topics is not None:
            names = sorted(set(topics))
            keys = [self._key(t) for t in names]
            # literal filters reach the scan: partition pruning on the prefix, row groups on the key
            data = data.where(F.col("key_prefix").isin(sorted({k[:2] for k in keys})) & F.col("topic_key").isin(keys))
            idx = idx.where(F.col("topic").isin(names))
        return data.join(idx, ["topic", "batch"], "left_semi").select(*STORED)

    @staticmethod
    def _key(topic: str) -> str:
        """Same value as the ``topic_key`` column (SHA-256 of the UTF-8 topic, 10 hex digits)."""
        return hashlib.sha256(topic.encode()).hexdigest()[:10]

    def write(self, rel: DataFrame, computed: DataFrame, fp: str) -> str:
        """Append ``rel`` (rows of the topics in ``computed``) as one batch and commit it."""
        batch = uuid.uuid4().hex
        (rel.select(*STORED)
            .withColumn("topic_key", topic_key("topic"))
            .withColumn("key_prefix", F.substring("topic_key", 1, 2))
            .withColumn("batch", F.lit(batch))
            .withColumn("fp", F.lit(fp))
            .hint("rebalance", "key_prefix")  # AQE merges small and splits skewed prefixes
            .sortWithinPartitions("key_prefix", "topic_key", "keyword")
            .write.mode("append").partitionBy("fp", "batch", "key_prefix").parquet(self.data_path))
        # index counts come from the rows just written, not from a second computation
        counts = (self.spark.read.parquet(self.data_path)
                  .where((F.col("fp") == fp) & (F.col("batch") == batch))
                  .groupBy("topic").agg(F.count(F.lit(1)).alias("relations")))
        (computed.select("topic").distinct()
            .join(counts, "topic", "left")
            .select("topic", topic_key("topic").alias("topic_key"), F.lit(batch).alias("batch"),
                    F.coalesce("relations", F.lit(0)).cast("long").alias("relations"), F.lit(fp).alias("fp"))
            .write.mode("append").partitionBy("fp").parquet(self.index_path))
        return batch

    def get_or_compute(self, news: DataFrame, topics: Iterable[str] | DataFrame,
                       min_mentions: int = MIN_MENTIONS, min_count: int = MIN_COUNT,
                       fingerprint: str = "content") -> DataFrame:
        """Relation sets of ``topics`` (a list, or a table with a ``topic`` column), computing only the
        topics not yet stored for this corpus and these cut-offs.

        ``fingerprint``: ``"content"`` hashes every row (exact, one scan of the corpus per call); ``"files"`` hashes the
        input files' metadata (reads no row; ``news`` must be a file scan); any other string is taken as the version
        itself (e.g. of a table). With the latter two a stored topic is served without reading the corpus.
        """
        if fingerprint == "content":
            fp = corpus_fingerprint(news, min_mentions, min_count)
        elif fingerprint == "files":
            fp = files_fingerprint(news, min_mentions, min_count)
        else:
            fp = hashlib.sha256(f"{fingerprint}|{min_mentions}|{min_count}".encode()).hexdigest()[:16]
        if isinstance(topics, str):
            topics = [topics]
        if isinstance(topics, DataFrame):
            wanted = topics.select("topic").distinct()
        else:
            wanted = self.spark.createDataFrame([(t,) for t in sorted(set(topics))], "topic string")
        missing = wanted.join(self.index(fp).select("topic"), "topic", "left_anti")
        with scratch_scope(self.spark):
            # the batch's topic set is written once, so the jobs below agree on it; the result does not read it
            todo = materialize(missing, scratch_path(self.spark, "store-todo"))
            if not todo.isEmpty():
                # a caller's list stays a list of literals: one narrow pass over the maps
                asked = todo if isinstance(topics, DataFrame) else [r["topic"] for r in todo.collect()]
                met = news
                if not isinstance(asked, DataFrame):  # the hits alone are put in order
                    met = news.where(F.size(F.map_filter("keywords", lambda k, v: (v > min_mentions) & k.isin(asked))) > 0)
                numbered = number_urls(met, scratch_path(self.spark, "store-news"))
                hits = topic_hits(numbered.withColumn("archive", F.col("_at")), asked, min_mentions)
                rel = materialize(relations(hits, min_count, extremes=True), scratch_path(self.spark, "store-relations"))
                self.write(urls_of_numbers(rel, numbered), todo, fp)
        return self.read(fp, topics)

"""Article corpora derived from the driver tables, so every query reads real tables.

* ``star_news``: one article per order (one without line items has no keywords); keywords are part names with
  their summed quantities, month and day from the order date, outlet from the customer's
  market segment.
* ``text_news``: one article per document; keywords are lower-cased letter runs with their occurrence counts, tone = quality - toxic from ``labels`` (null when
  unlabelled), archived URL built from ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.schema import NEWS

# How the fixture corpora are built.
ARCHIVE_PREFIX = "https://archive.example/noFrame/replay/"
STAR_CAPTURE_SUFFIX = "000000/https://www."
STAR_OUTLET_SUFFIX = ".example/story-"
TEXT_CAPTURE_SUFFIX = "15000000/"
TOKEN_SPLIT = r"[^\p{L}]+"
TEXT_FIRST_YEAR = 1998
TEXT_YEARS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _as_news(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NEWS.fields])


def star_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, keyword map).

    The (order, part name) sums are combined map-side before the first shuffle, so an order
    holding a huge share of the line items arrives as at most one row per part name and
    task; the second aggregation then builds each order's map (bounded by part names).
    """
    items = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name").where(F.col("p_name").isNotNull()),
              F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey", "p_name")
        .agg(F.sum("l_quantity").cast("int").alias("n"))
    )
    return items.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("p_name", "n"))).alias("keywords"))


def star_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    kw = star_keywords(spark, sf_dir)
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return _as_news(
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(kw, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("timestamp"),
            F.col("c_mktsegment").alias("source"),
            F.concat(F.lit(ARCHIVE_PREFIX), day, F.lit(STAR_CAPTURE_SUFFIX), F.lower("c_mktsegment"),
                     F.lit(STAR_OUTLET_SUFFIX), F.col("o_orderkey").cast("string")).alias("archive"),
            F.col("o_orderkey").alias("id"),
            F.lit(1.0).alias("probability"),
            F.coalesce("keywords", F.create_map().cast("map<string,int>")).alias("keywords"),
            (((F.col("o_orderkey") % 9) - 4) / 4.0).alias("sentiment"),
        )
    )


def _let(value, body):
    """``body(v)`` with ``v`` bound once to ``value`` (a one-element ``transform``).

    Catalyst may inline a projection into a pushed-down filter; binding intermediate
    arrays to lambda variables keeps that from re-evaluating them per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_map(text) -> "F.Column":
    """Lower-cased letter runs -> occurrences, computed inside the row.

    A document is one row, so no shuffle is needed: the tokens are sorted, the ends of
    equal-token runs are found in one pass, and run lengths are zipped with the run
    values into the map - O(n log n) per document, JVM-side.
    """
    toks = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")

    def runs(s):
        n = F.size(s)
        is_end = lambda i: (i <= n) & ((i == n) | (F.get(s, i - 1) != F.get(s, i)))
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), is_end)
        return _let(ends, lambda e: F.map_from_arrays(
            F.transform(e, lambda end: F.get(s, end - 1)),
            F.transform(e, lambda end, j: end - F.coalesce(F.get(e, j - 1), F.lit(0)))))

    return _let(F.sort_array(toks), runs)


def token_counts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``*keep, keywords`` with ``keywords = keyword_map(text)``."""
    return df.select(*keep, keyword_map(F.col(text)).alias("keywords"))


def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, token map) over the whole text of every document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


def text_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slim document rows meet pages and labels first (ids and short strings); the keyword maps, computed inside the
    documents scan, are joined to them last and shuffled once, by document."""
    slim = table(spark, sf_dir, "documents").select("doc_id", "source")
    maps = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = max(1, pages.count())  # from the file footers: a document's page is its id modulo the pages there are
    ts = (F.lit(TEXT_FIRST_YEAR) + F.col("doc_id") % TEXT_YEARS) * 100 + 1 + F.col("doc_id") % 12
    met = (slim.withColumn("timestamp", ts.cast("int"))
           .withColumn("page_key", F.col("doc_id") % n_pages)
           .join(pages, F.col("page_key") == F.col("page_id"), "left")
           .join(labels, F.col("doc_id") == F.col("l_doc_id"), "left"))
    return _as_news(
        met.join(maps, "doc_id").select(
            "timestamp", "source",
            F.concat(F.lit(ARCHIVE_PREFIX), F.col("timestamp").cast("string"), F.lit(TEXT_CAPTURE_SUFFIX),
                     F.col("url")).alias("archive"),
            F.col("doc_id").alias("id"),
            F.lit(1.0).alias("probability"),
            "keywords",
            (F.col("quality") - F.col("toxic")).alias("sentiment"),
        )
    )

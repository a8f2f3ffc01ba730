"""The article list of a relation: title, capture day, outlet host and logo key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotopic.functions.urls import (
    article_title, capture_date, capture_order, original_url, outlet_host,
)
from cotopic.operators.topics import KEY_PARTS, mention_rows
from cotopic.schema import MIN_COUNT
from cotopic.session import written

# Outlet tokens, tried in this order; the first one contained in the host wins.
OUTLETS = [
    "record", "noticiasaominuto", "lusa", "jornaldenegocios", "tsf", "sicnoticias",
    "expresso", "publico", "dn", "observador", "sapo", "iol", "rtp", "cnn",
    "cmjornal", "jn", "nit", "dinheirovivo", "aeiou",
]
NO_OUTLET = "404"  # key used when no token matches


def outlet_of(host, outlets: Sequence[str] = OUTLETS) -> Column:
    """First outlet token contained in ``host``, else ``404``.

    The ordered token list is small and fixed, so the first-match join becomes one CASE
    expression evaluated inside the scan stage: no join, no shuffle.
    """
    h = F.col(host) if isinstance(host, str) else host
    expr = None
    for token in outlets:
        cond = h.contains(token)
        expr = F.when(cond, F.lit(token)) if expr is None else expr.when(cond, F.lit(token))
    return expr.otherwise(F.lit(NO_OUTLET)) if expr is not None else F.lit(NO_OUTLET)


def match_outlet(df: DataFrame, host: str = "host", outlets: Sequence[str] | DataFrame = OUTLETS) -> DataFrame:
    """Add ``outlet`` to ``df``.

    ``outlets`` may also be a table ``(position, token)`` of any size. A token is known by its beginning, as long as the largest power of
    two in its length; every distinct host is cut into pieces of the few lengths that occur (read first; at most one per
    doubling), which meet the beginnings in an equality join and are verified. A host of L characters makes L rows a length. ``min_by``
    keeps the token of the first position.
    """
    if not isinstance(outlets, DataFrame):
        return df.withColumn("outlet", outlet_of(host, outlets))
    hosts = df.select(F.col(host).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    size = F.length("token")
    lead = F.when(size > 0, F.pow(F.lit(2.0), F.floor(F.log2(size)))).otherwise(0).cast("int")
    tokens = outlets.select("position", "token", lead.alias("_k"))
    tokens = tokens.withColumn("_piece", F.col("token").substr(F.lit(1), F.col("_k")))
    lengths = [r["_k"] for r in tokens.where("_k IS NOT NULL").select("_k").distinct().collect()]

    def pieces(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_h") - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("_k"), i.alias("_at"), F.col("_h").substr(i, F.lit(k)).alias("_piece")))

    places = [pieces(k) for k in lengths]
    if not places:
        return df.withColumn("outlet", F.lit(NO_OUTLET))
    cut = hosts.select("_h", F.explode(F.concat(*places)).alias("_c")).select("_h", "_c.*")
    met = cut.join(tokens, ["_k", "_piece"]).where(F.col("_h").substr(F.col("_at"), F.length("token")) == F.col("token"))
    first = met.groupBy("_h").agg(F.min_by("token", "position").alias("outlet"))
    return (df.join(first, F.col(host) == F.col("_h"), "left").drop("_h")
              .withColumn("outlet", F.coalesce("outlet", F.lit(NO_OUTLET))))


ARTICLE_FIELDS = ["title", "capture_date", "host", "original_url", "outlet", "archive"]


def _fields(articles: DataFrame) -> DataFrame:
    """All that an article's URL tells."""
    out = (articles.withColumn("title", article_title("archive")).withColumn("capture_date", capture_date("archive"))
           .withColumn("host", outlet_host("archive")).withColumn("original_url", original_url("archive")))
    return match_outlet(out, "host")


def relation_articles(hits: DataFrame, rel: DataFrame | None = None, dedup: bool = True,
                      min_count: int = MIN_COUNT, include_topic: bool = False) -> DataFrame:
    """``topic, keyword, title, capture_date, host, original_url, outlet, archive``.

    One row per (article, keyword) of the relation set; with ``dedup`` one row per
    (topic, keyword, title), keeping the latest capture (then the smallest URL).

    Every field is a function of the article's URL. An article without a title is no copy of anything and is kept.
    Without ``rel`` the relation set (count cut) comes from the same aggregate; the topic's own articles are left out unless
    ``include_topic``. With ``rel`` only its (topic, keyword) pairs are kept.

    De-duplication compares numbers. Without ``rel`` the hits are written once in order of title hash (80 bits), latest capture and URL, and numbered in that
    order, so of one title the article of least number wins, ties of a second included. Exploded mentions - keyword, title hash, number - are
    shuffled twice: by keyword, a keyword's mentions dealt over ``KEY_PARTS`` parts, which serves aggregate and count cut alike, and the
    winners, then keyword and number alone, to their articles, whose fields are made once an article.
    """
    if not dedup:
        rows = _fields(hits.select("topic", "keywords", "archive"))
        rows = rows.select("topic", *ARTICLE_FIELDS, F.explode("keywords").alias("keyword", "n")).where(F.col("n").isNotNull())
        if rel is None:
            keep = _kept(mention_rows(hits).groupBy("topic", "keyword").agg(F.sum("n").alias("_n")), min_count, include_topic)
        else:
            keep = rel.select("topic", "keyword")
        return rows.join(keep, ["topic", "keyword"], "left_semi").select("topic", "keyword", *ARTICLE_FIELDS)

    return _latest_articles(hits, min_count, include_topic) if rel is None else _given_articles(hits, rel)


def _latest_articles(hits: DataFrame, min_count: int, include_topic: bool) -> DataFrame:
    """The de-duplicated list of every relation: the hits are written once, numbered in order."""
    title, order = article_title("archive"), F.coalesce(-capture_order("archive"), F.lit(2**63 - 1))
    # an article without a title is a group of its own
    named = [F.when(title.isNotNull(), F.xxhash64(F.lit(seed), title)).otherwise(F.xxhash64(F.lit(seed + 2), "id", "archive")) for seed in (1, 2)]
    group = ["_t1", "_t2"]
    place = [*group, "_o", "archive"]
    slim = hits.select("topic", "keywords", "archive", order.alias("_o"), named[0].alias("_t1"), F.shiftright(named[1], 48).cast("int").alias("_t2"))
    ordered = slim.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_a", F.monotonically_increasing_id())
    numbered = written(ordered.select("topic", "keywords", "archive", *group, "_a"), "numbered-articles")
    rows = numbered.select("topic", *group, "_a", F.explode("keywords").alias("keyword", "n")).where(F.col("n").isNotNull())
    if not include_topic:
        rows = rows.where(F.col("keyword") != F.col("topic"))
    part = F.xxhash64("_t1").bitwiseAND(F.lit(KEY_PARTS - 1).cast("long"))  # never null: no filter on it is pushed into one use alone
    dealt = rows.withColumn("_part", part).repartition("topic", "keyword", "_part")
    # both uses of this aggregate keep all its columns, so that Spark computes it once
    latest = dealt.groupBy("topic", "keyword", "_part", *group).agg(F.min("_a").alias("_a"), F.sum("n").alias("_n"))
    counts = latest.groupBy("topic", "keyword").agg(F.sum("_n").alias("_n"), F.min("_a").alias("_a")).where(F.col("_a").isNotNull())
    keep = _kept(counts, min_count, include_topic).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1)).cast("array<long>")))
    winners = latest.where(F.col("_n").isNotNull()).join(keep.hint("shuffle_hash"), ["topic", "keyword", "_part"], "left_semi")
    # shuffled, by the slim side: the planner takes an exploded map for small and would broadcast the winners, as many as the result
    urls = _fields(numbered.select("topic", "archive", "_a")).hint("shuffle_hash")
    return winners.select("keyword", "_a").join(urls, "_a").select("topic", "keyword", *ARTICLE_FIELDS)


def _given_articles(hits: DataFrame, rel: DataFrame) -> DataFrame:
    """The de-duplicated list of given relations, mostly few: nothing is written."""
    title, order = article_title("archive"), F.coalesce(-capture_order("archive"), F.lit(2**63 - 1))
    # an article without a title is a group of its own
    named = [F.when(title.isNotNull(), F.xxhash64(F.lit(seed), title)).otherwise(F.xxhash64(F.lit(seed + 2), "id", "archive")).alias(f"_t{seed}")
             for seed in (1, 2)]
    group = ["_t1", "_t2"]
    slim = hits.select("topic", "keywords", "archive", order.alias("_o"), *named)
    rows = slim.select("topic", "_o", *group, "archive", F.explode("keywords").alias("keyword", "n")).where(F.col("n").isNotNull())
    rows = rows.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    winners = rows.groupBy("topic", "keyword", *group).agg(F.min("_o").alias("_o"))
    place = ["topic", *group, "_o"]
    urls = slim.select(*place, "archive").distinct()
    tied = urls.groupBy(*place).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select(*place)
    first = Window.partitionBy("keyword", *place).orderBy("archive")
    rivals = (rows.join(tied, place, "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
              .select("keyword", *place, F.col("archive").alias("_url")))
    won = winners.join(rivals, ["keyword", *place], "left")
    # shuffled, by the slim side: the planner takes an exploded map for small and would broadcast the winners, as many as the result
    return (won.join(_fields(urls).hint("shuffle_hash"), place).where(F.col("_url").isNull() | (F.col("_url") == F.col("archive")))
            .select("topic", "keyword", *ARTICLE_FIELDS))


def _kept(counts: DataFrame, min_count: int, include_topic: bool) -> DataFrame:
    """``topic, keyword`` of the relation set from summed mentions ``_n``."""
    keep = counts.where(F.col("_n") >= min_count)
    if not include_topic:
        keep = keep.where(F.col("keyword") != F.col("topic"))
    return keep.select("topic", "keyword")


def newest_articles(articles: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest articles of each relation in presentation order, with their ``position`` (a limit per task before the shuffle)."""
    w = Window.partitionBy("topic", "keyword").orderBy(F.desc_nulls_last("capture_date"), F.desc_nulls_last("archive"))
    return articles.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def ordered_articles(articles: DataFrame) -> DataFrame:
    """Presentation order: newest capture day first, then URL descending (a global sort; use at output)."""
    return articles.orderBy("topic", "keyword", F.desc_nulls_last("capture_date"), F.desc_nulls_last("archive"))

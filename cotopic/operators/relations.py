"""The relation set of a topic and its child tables.

``relations`` is the heart of a search: for every keyword co-occurring with the topic in
its hit articles, summed mentions and mention-weighted tone (optionally the extremes of the
archive URLs). It is one hash aggregation with map-side partial combine; hot keywords
therefore shuffle one partial row per task, never their raw rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotopic.functions.labels import tone_gauge
from cotopic.operators.topics import EXTREMES, merge_states, state_rows
from cotopic.schema import MIN_COUNT, SUGGESTIONS


def relations(hits: DataFrame, min_count: int = MIN_COUNT, extremes: bool = False) -> DataFrame:
    """``topic, keyword, count, sentiment, articles`` (+ ``first_archive, last_archive``).

    * ``count``: summed mentions; kept when ``>= min_count`` (the cut is in the plan).
    * ``sentiment``: sum(tone * n) / sum(n), both sums over mentions with a known tone;
      null when no mention has one. The topic itself is part of the set.
    * ``articles``: hit articles carrying the keyword.
    * ``extremes=True`` adds the smallest and largest archive URL. String minima are not
      hash-aggregatable (Spark falls back to a sort-based aggregate over every exploded
      row), so they are off by default; ``relation_extremes`` computes them for just the
      keys that need them.
    """
    out = ["topic", "keyword", "count", "sentiment", "articles"] + (EXTREMES if extremes else [])
    return (
        merge_states(state_rows(hits))
        .where(F.col("n") >= min_count)
        .withColumn("sentiment", F.col("tone_sum") / F.nullif(F.col("tone_n"), F.lit(0)))
        .withColumnRenamed("n", "count")
        .select(*out)
    )


def relation_extremes(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """``topic, keyword, first_archive, last_archive`` for the (topic, keyword) pairs of ``keys``.

    The sort-based string aggregate only sees the rows of the requested keys.
    """
    rows = state_rows(hits).join(keys.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    return merge_states(rows).select("topic", "keyword", *EXTREMES)


def with_extremes(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """``kept`` (one row per ``topic, keyword``, of the relation set of ``hits``) with its archive extremes.

    The exploded hits meet ``kept`` itself, so it is computed once, and the string aggregate sees the rows of these keywords alone.
    """
    rows = state_rows(hits).select("topic", "keyword", *EXTREMES).join(kept, ["topic", "keyword"])
    return rows.groupBy("topic", "keyword").agg(
        F.min("first_archive").alias("first_archive"), F.max("last_archive").alias("last_archive"),
        *[F.first(c).alias(c) for c in kept.columns if c not in ("topic", "keyword")])


def neighbours(rel: DataFrame) -> DataFrame:
    """The relation set without the topic itself."""
    return rel.where(F.col("keyword") != F.col("topic"))


def relation_months(hits: DataFrame, rel: DataFrame | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """``topic, keyword, timestamp, mentions`` for keywords of the relation set.

    Without ``rel`` the count cut is taken from this aggregate itself: a keyword's count is
    the sum over its months, a window over at most one row per calendar month (and one for
    unknown months) - one read of the hits, no self join.
    """
    per = merge_states(state_rows(hits, "timestamp"), "timestamp").select("topic", "keyword", "timestamp", F.col("n").alias("mentions"))
    if rel is not None:
        return per.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    total = F.sum("mentions").over(Window.partitionBy("topic", "keyword"))
    return per.withColumn("_count", total).where(F.col("_count") >= min_count).drop("_count")


def relation_sources(hits: DataFrame, rel: DataFrame | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """``topic, keyword, source, articles, pct``: articles per outlet for each relation.

    The share is taken against the keyword's article total and the count cut against its
    summed mentions, both windows over the keyword's outlet rows (one per outlet): one read
    of the hits, no self join.
    """
    per = (merge_states(state_rows(hits, "source"), "source")
           .select("topic", "keyword", "source", "articles", F.col("n").alias("_n")))
    w = Window.partitionBy("topic", "keyword")
    out = (per.withColumn("_total", F.sum("articles").over(w))
              .withColumn("_count", F.sum("_n").over(w)))
    if rel is None:
        out = out.where(F.col("_count") >= min_count)
    else:  # the given set decides
        out = out.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    return (out.withColumn("pct", F.col("articles") * F.lit(100.0) / F.col("_total"))
               .drop("_total", "_count", "_n"))


def relations_nested(hits: DataFrame, rel: DataFrame | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """The stored record shape: ``topic, keyword, count, sentiment, date, source, date_unknown, source_unknown``.

    ``date`` (month -> mentions) and ``source`` (outlet -> articles) are maps with string
    keys, bounded by months and outlets; mentions without a month and articles without an outlet
    are the two ``unknown`` numbers. With ``rel`` its keywords alone are kept, whatever their count.
    Article URLs stay in the long ``relation_articles`` table instead of a list here.

    One read of the hits: a single ``GROUPING SETS`` aggregate produces the per-month and
    the per-outlet rows; a second aggregate per keyword builds both maps and takes the count
    and tone sums from the month rows.
    """
    g = (state_rows(hits, "timestamp", "source")
             .groupingSets([["topic", "keyword", "timestamp"], ["topic", "keyword", "source"]],
                           "topic", "keyword", "timestamp", "source")
             .agg(F.sum("n").alias("mentions"), F.sum("articles").alias("articles"),
                  F.sum("tone_sum").alias("_ts"), F.sum("tone_n").alias("_tn"),
                  F.grouping_id().alias("_g")))
    by_month = F.col("_g") == 1  # source grouped out
    by_source = F.col("_g") == 2  # month grouped out

    def entries(cond, key, value):
        k = F.col(key).cast("string")
        known = cond & k.isNotNull()
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct(k.alias("k"), F.col(value).alias("v"))))))

    def unknown(cond, key, value):
        return F.coalesce(F.sum(F.when(cond & F.col(key).isNull(), F.col(value))), F.lit(0))

    out = (g.groupBy("topic", "keyword")
            .agg(F.sum(F.when(by_month, F.col("mentions"))).alias("count"),
                 F.sum(F.when(by_month, F.col("_ts"))).alias("_ts"),
                 F.sum(F.when(by_month, F.col("_tn"))).alias("_tn"),
                 entries(by_month, "timestamp", "mentions").alias("date"),
                 entries(by_source, "source", "articles").alias("_source"),
                 unknown(by_month, "timestamp", "mentions").alias("date_unknown"),
                 unknown(by_source, "source", "articles").alias("source_unknown"))
            .where(F.lit(rel is not None) | (F.col("count") >= min_count))
            .withColumn("sentiment", F.col("_ts") / F.nullif(F.col("_tn"), F.lit(0)))
            .select("topic", "keyword", "count", "sentiment", "date", F.col("_source").alias("source"),
                    "date_unknown", "source_unknown"))
    if rel is not None:
        out = out.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    return out


def _candidates(candidates, rel: DataFrame) -> DataFrame:
    if isinstance(candidates, DataFrame):
        return candidates
    spark = rel.sparkSession
    rows = [(c,) for c in candidates]
    return spark.createDataFrame(rows, "keyword string")


def relation_exists(rel: DataFrame, candidates: DataFrame | Iterable[str]) -> DataFrame:
    """Is a (trimmed) candidate keyword a neighbour of the topic?

    ``candidates`` holds ``keyword`` (and optionally ``topic``); returns the candidates with
    ``present``. A left join against the relation keys - no per-candidate action.
    """
    cand = _candidates(candidates, rel).withColumn("keyword", F.trim("keyword"))
    keys = ["topic", "keyword"] if "topic" in cand.columns else ["keyword"]
    found = (rel.where(F.col("keyword") != F.col("topic"))  # one row per (topic, keyword) already
                .select(*keys).withColumn("present", F.lit(True)))
    if keys == ["keyword"]:
        found = found.distinct()  # several topics may share a keyword
    return (cand.join(found, keys, "left")
                .withColumn("present", F.coalesce(F.col("present"), F.lit(False))))


def relation_summary(rel: DataFrame, candidates: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """``topic, keyword, count, sentiment, gauge`` of neighbours (optionally only candidates)."""
    out = neighbours(rel).select("topic", "keyword", "count", "sentiment")
    if candidates is not None:
        cand = _candidates(candidates, rel).withColumn("keyword", F.trim("keyword"))
        keys = ["topic", "keyword"] if "topic" in cand.columns else ["keyword"]
        out = out.join(cand.select(*keys).distinct(), keys, "left_semi")
    return out.withColumn("gauge", tone_gauge("sentiment"))


def recommend(rel: DataFrame, n: int = SUGGESTIONS, seed: int = 42, deterministic: bool = True) -> DataFrame:
    """Up to ``n`` neighbour keywords per topic, drawn without replacement.

    The deterministic form orders by SHA-256 of ``"<seed>:<keyword>"``; the other by
    ``rand(seed)``. The row_number filter becomes a per-task top-n before the shuffle.
    """
    key = (F.sha2(F.concat(F.lit(f"{seed}:"), F.col("keyword")), 256) if deterministic
           else F.rand(seed))
    w = Window.partitionBy("topic").orderBy(key, F.col("keyword"))
    return (neighbours(rel).select("topic", "keyword")
            .withColumn("pick", F.row_number().over(w))
            .where(F.col("pick") <= n))


def keyword_weights(rel: DataFrame) -> DataFrame:
    """``topic, keyword, count`` - the weights of a keyword cloud."""
    return neighbours(rel).select("topic", "keyword", "count")

"""Graph nodes of a topic: quantile bands of tone, top-N by mentions, sizes, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotopic.functions.labels import band_color, node_caption, sentiment_band, wrap_label
from cotopic.functions.urls import capture_month, capture_stamp
from cotopic.operators.relations import neighbours, with_extremes
from cotopic.operators.topics import spread_join, state_rows
from cotopic.schema import MIN_COUNT, TOP_NODES

# Quantile levels, and the weights blending all-neighbour with top-N quantiles.
LEVELS = (0.1, 0.3, 0.7, 0.9)
BLEND_ALL = {"q10": 0.4, "q30": 0.3, "q70": 0.3, "q90": 0.4}
BLEND_TOP = {"q10": 0.6, "q30": 0.7, "q70": 0.7, "q90": 0.6}
QNAMES = ("q10", "q30", "q70", "q90")
SELECT_ACCURACY = 1000  # rank slack of the sketch that bounds an exact quantile
# Node size = (ln(count / smallest count) * 3) ** 1.5 + 50.
SIZE_SCALE = 3.0
SIZE_POWER = 1.5
SIZE_BASE = 50.0


def sentiment_quantiles(rel: DataFrame, approx: bool = False, accuracy: int = 10000,
                        method: str = "distributed") -> DataFrame:
    """``topic, q10, q30, q70, q90`` of the keywords' tone, linear interpolation.

    * ``"distributed"`` (default): exact, by selection between sketched bounds (``selected_quantiles``).
    * ``"aggregate"``: exact ``percentile``; tasks ship value->count summaries and
      the final merge holds one map per topic (distinct tone values of its neighbours).
    * ``approx=True``: ``percentile_approx`` with bounded memory.
    Null tones are skipped.
    """
    if method == "distributed" and not approx:
        return selected_quantiles(rel, "topic", "sentiment")
    agg = (F.percentile_approx("sentiment", list(LEVELS), accuracy) if approx
           else F.percentile("sentiment", list(LEVELS)))
    q = rel.groupBy("topic").agg(agg.alias("_q"))
    return q.select("topic", *[F.col("_q")[i].alias(name) for i, name in enumerate(QNAMES)])


def selected_quantiles(df: DataFrame, key: str, value: str, accuracy: int = SELECT_ACCURACY) -> DataFrame:
    """Exact quantiles (``LEVELS``, linear interpolation as ``percentile``) per ``key`` in two light passes, lazily.

    First pass: a mergeable sketch per key whose ranks are off by at most one in ``accuracy`` gives each level a range of values that must
    hold its two ranks (keys of up to ``4 * accuracy`` values take the whole range: at that size the sketch's slack is below one rank).
    Second pass: the exact ``percentile`` of the values moved to the ends of their level's range. That changes no rank inside the
    range, so the result is exact, and its value->count maps, merged partially on every task, hold the distinct values of about one in
    ``accuracy / 5`` of the key's rows. No window, no job, and no task holds a key's values; a key's rows meet its
    ranges in several parts (``spread_join``).
    """
    slack = 2.0 / accuracy
    tails = [min(1.0, max(0.0, q + d)) for q in LEVELS for d in (-slack, slack)]
    values = df.select(key, F.col(value).cast("double").alias("_v"))
    sketch = values.groupBy(key).agg(F.percentile_approx("_v", tails, accuracy).alias("_s"), F.count("_v").alias("_n"))
    met = spread_join(values, sketch.select(key, F.when(F.col("_n") > 4 * accuracy, F.col("_s")).alias("_s")), key, "_v")

    def moved(i):  # nulls stay null
        inside = F.when(F.col("_v") < F.col("_s")[2 * i], F.col("_s")[2 * i]).when(F.col("_v") > F.col("_s")[2 * i + 1], F.col("_s")[2 * i + 1])
        return inside.otherwise(F.col("_v"))
    return met.groupBy(key).agg(*[F.percentile(moved(i), q).alias(name) for i, (q, name) in enumerate(zip(LEVELS, QNAMES))])


def top_relations(neigh: DataFrame, n: int = TOP_NODES) -> DataFrame:
    """The ``n`` keywords with most mentions per topic (ties: keyword ascending)."""
    w = Window.partitionBy("topic").orderBy(F.desc("count"), F.asc("keyword"))
    return neigh.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sentiment_thresholds(neigh: DataFrame, n: int = TOP_NODES, approx: bool = False,
                         method: str = "distributed") -> DataFrame:
    """``topic, q10, q30, q70, q90``: quantiles of all neighbours blended with those of the
    top ``n`` by count (``method`` as in ``sentiment_quantiles``)."""
    return (_ranked_with_quantiles(neigh, n, approx, method)
            .groupBy("topic")
            .agg(*[F.first(c).alias(c) for c in QNAMES]))


def _ranked_with_quantiles(neigh: DataFrame, n: int, approx: bool, method: str = "aggregate") -> DataFrame:
    """Top ``n`` neighbours per topic with blended thresholds and the smallest count.

    All-neighbour quantiles are selected between sketched bounds, per topic; the top-N cut is a per-task limit before the shuffle; top-N
    quantiles and the smallest count are windows over at most ``n`` rows per topic. The
    relation set is read by both sides (Spark plans the two pruned uses separately); a caller
    serving many reports reads it from written hits or the relation store.
    """
    pct = (F.percentile_approx("sentiment", list(LEVELS), 10000) if approx
           else F.percentile("sentiment", list(LEVELS)))
    if method == "distributed" and not approx:
        qa = selected_quantiles(neigh, "topic", "sentiment").select("topic", F.array(*QNAMES).alias("_qa"))
    else:
        qa = neigh.groupBy("topic").agg(pct.alias("_qa"))
    per_topic = Window.partitionBy("topic")
    top = (top_relations(neigh, n)
           .withColumn("_qt", pct.over(per_topic))
           .withColumn("min_count", F.min("count").over(per_topic))
           .join(qa, "topic", "left"))
    thr = [(F.col("_qa")[i] * BLEND_ALL[c] + F.col("_qt")[i] * BLEND_TOP[c]).alias(c) for i, c in enumerate(QNAMES)]
    return top.select("*", *thr).drop("_qa", "_qt")


def relation_nodes(rel: DataFrame, n: int = TOP_NODES, sep: str = "<br>", approx: bool = False,
                   hits: DataFrame | None = None, quantiles: str = "distributed") -> DataFrame:
    """``topic, keyword, count, sentiment, size, band, color, label, caption, first_seen, last_seen``.

    ``rel`` is the relation set (topic included; it is removed here) and must carry the
    archive extremes (``relations(..., extremes=True)``, or a stored relation set); without
    them pass ``hits=`` and they are computed for the shown keywords only.

    All-neighbour quantiles are a partial/final aggregate per topic; the top-N cut is a
    per-task limit before the shuffle; top-N quantiles and the smallest count are windows
    over at most ``n`` rows per topic; per-topic values are one-row-per-topic lookups.
    ``quantiles="aggregate"`` merges a topic's values in one task instead of selecting between bounds (``selected_quantiles``).
    """
    if "first_archive" not in rel.columns and hits is None:
        raise ValueError("relation set has no archive extremes: pass hits=, or relations(..., extremes=True)")
    nodes = _ranked_with_quantiles(neighbours(rel), n, approx, quantiles)
    if "first_archive" not in rel.columns:
        nodes = with_extremes(nodes, hits)  # of the at most n shown keywords, not of the whole relation set
    size = F.pow(F.ln(F.col("count") / F.col("min_count")) * SIZE_SCALE, SIZE_POWER) + SIZE_BASE
    band = sentiment_band("sentiment", "q10", "q30", "q70", "q90")
    last_seen = capture_month("last_archive")
    return (nodes.select("topic", "keyword", "count", "sentiment",
                         size.alias("size"), band.alias("band"),
                         wrap_label("keyword", sep).alias("label"),
                         node_caption("keyword", "count", last_seen).alias("caption"),
                         capture_month("first_archive").alias("first_seen"),
                         last_seen.alias("last_seen"))
                 .withColumn("color", band_color("band")))


def relation_years(hits: DataFrame, rel: DataFrame | None = None, n: int = TOP_NODES,
                   min_count: int = MIN_COUNT) -> DataFrame:
    """``topic, keyword, year, mentions`` for the graph nodes (top ``n`` neighbours), every
    year filled.

    The range runs from the first capture year (or first mention year, if earlier) to the
    last capture year (or last mention year, if later), so no mention falls outside it.

    A hash aggregate per (topic, keyword, year) holds the mentions; per keyword they roll up into a year
    map (one entry per calendar year) and the count; the top-N cut is a window; the archive extremes are
    read for the kept keywords only; the spine is generated from
    the range and filled by map lookup. With ``rel`` its keywords alone count, whatever their mentions.
    """
    per = (state_rows(hits, "timestamp").groupBy("topic", "keyword", (F.col("timestamp") / 100).cast("int").alias("year"))
               .agg(F.sum("n").alias("mentions")))
    dated = F.col("year").isNotNull()
    kw = per.groupBy("topic", "keyword").agg(
        F.sum("mentions").alias("count"),
        F.map_from_entries(F.collect_list(F.when(dated, F.struct("year", "mentions")))).alias("_ym"),
        F.min(F.when(dated, F.col("year"))).alias("_m0"), F.max(F.when(dated, F.col("year"))).alias("_m1"))
    kw = kw.where(F.col("keyword") != F.col("topic"))
    if rel is None:
        kw = kw.where(F.col("count") >= min_count)
    else:  # the given set decides
        kw = kw.join(rel.select("topic", "keyword"), ["topic", "keyword"], "left_semi")
    top = with_extremes(top_relations(kw, n), hits)
    first = capture_stamp("first_archive").substr(1, 4).try_cast("int")
    last = capture_stamp("last_archive").substr(1, 4).try_cast("int")
    bounds = top.select("topic", "keyword", "_ym",
                        F.least(first, F.col("_m0")).alias("_y0"), F.greatest(last, F.col("_m1")).alias("_y1"))
    spine = (bounds.where(F.col("_y0").isNotNull() & F.col("_y1").isNotNull())
             .select("topic", "keyword", "_ym", F.explode(F.sequence("_y0", "_y1")).alias("year")))
    return spine.select("topic", "keyword", "year",
                        F.coalesce(F.col("_ym")[F.col("year")], F.lit(0)).cast("long").alias("mentions"))

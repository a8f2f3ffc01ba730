"""A whole topic search as one set of lazy reports over one materialized hit set.

This is the page a user gets for a topic: summary, outlets, monthly history, relation
set, graph nodes, keyword weights. The hits are written once as a Parquet table in the
shared checkpoint folder (the corpus maps are scanned once); every report below is a lazy
DataFrame over them, so the caller runs only
the reports it needs, as one job each. ``relation_detail`` is the follow-up for one
related keyword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.operators import (
    keyword_weights, neighbours, recommend, relation_articles, relation_history, relation_nodes,
    relation_sources, relation_summary, relation_years, relations, topic_history, topic_hits,
    topic_sources, topic_summary,
)
from cotopic.schema import MIN_COUNT, MIN_MENTIONS, TOP_NODES
from cotopic.session import scratch_path
from cotopic.sources.news import materialize
from cotopic.sources.records import RecordStore


def topic_search(news: DataFrame, topic, min_mentions: int = MIN_MENTIONS, min_count: int = MIN_COUNT,
                 n: int = TOP_NODES) -> dict[str, DataFrame]:
    """All reports of a search for ``topic`` (a string, a list, or a ``topic`` table)."""
    spark = news.sparkSession
    hits = materialize(topic_hits(news, topic, min_mentions), scratch_path(spark, "search-hits"))
    rel = materialize(relations(hits, min_count), scratch_path(spark, "search-relations"))
    return {
        "hits": hits,
        "summary": topic_summary(hits),
        "sources": topic_sources(hits),
        "history": topic_history(hits),
        "relations": rel,
        "nodes": relation_nodes(rel, n, hits=hits),
        "years": relation_years(hits, rel, n, min_count),
        "weights": keyword_weights(rel),
    }


def stored_search(store: RecordStore, topic, min_count: int = MIN_COUNT, n: int = TOP_NODES) -> dict[str, DataFrame]:
    """The reports of ``topic_search`` for stored topics, from the record store's states: the corpus is not read.

    A topic that is not stored has no rows; ``store.add_topics`` adds it, ``store.refresh`` brings in new files.
    """
    states, rel = store.states(topic), store.relations(topic, min_count)
    return {
        "summary": topic_summary(states),
        "sources": topic_sources(states),
        "history": topic_history(states),
        "relations": rel,
        "nodes": relation_nodes(rel, n),
        "years": relation_years(states, rel, n, min_count),
        "weights": keyword_weights(rel),
    }


def stored_detail(store: RecordStore, topic: str, keyword: str, min_count: int = MIN_COUNT, suggestions: int = 5) -> dict[str, DataFrame]:
    """``relation_detail`` from the record store. Counts, history and outlets read the rows of this relation and the topic's own;
    the article list reads the postings of both keywords and the articles they name, and no keyword map."""
    keyword = keyword.strip()
    rel = store.relations(topic, min_count)
    one = neighbours(rel).where(F.col("keyword") == keyword)
    states = store.states(topic, [keyword])
    return {
        "summary": relation_summary(rel, [keyword]),
        "history": relation_history(states, one),
        "sources": relation_sources(states, one),
        "articles": relation_articles(store.hits(topic, [keyword]), one),
        "suggestions": recommend(rel, suggestions),
    }


def relation_detail(search: dict[str, DataFrame], keyword: str, suggestions: int = 5) -> dict[str, DataFrame]:
    """Follow-up for one related keyword: exists?, summary, history, outlets, articles,
    and suggestions (meant for when it does not exist)."""
    hits, rel = search["hits"], search["relations"]
    one = neighbours(rel).where(F.col("keyword") == F.trim(F.lit(keyword)))
    return {
        "summary": relation_summary(rel, [keyword]),
        "history": relation_history(hits, one),
        "sources": relation_sources(hits, one),
        "articles": relation_articles(hits, one),
        "suggestions": recommend(rel, suggestions),
    }

"""Physical-plan properties: pruning, pushdown, top-k before shuffle, JVM-only execution."""

import re

import pytest

from cotopic.operators import monthly_top_keywords, relations, topic_hits
from cotopic.plans.catalogue import QUERIES, Corpus
from cotopic.session import scratch_path
from cotopic.sources.fixtures import star_news
from cotopic.sources.news import materialize, read_news, write_news
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    star = materialize(star_news(spark, SF001), scratch_path(spark, "plan-star"))
    return Corpus(spark, SF001, star=star)


def test_status_is_a_partition_filter(spark, hand):
    root = scratch_path(spark, "status")
    write_news(hand, root, status="success")
    write_news(hand.limit(2), root, status="failed")
    df = read_news(spark, root, status="success")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in p and "(status" in p
    assert df.count() == 7


def test_topic_predicate_and_pruning_reach_the_scan(corpus):
    p = plan(relations(corpus.hits()))
    assert re.search(r"DataFilters: \[.*keywords.*\[red gear\] > 4", p)
    assert "ReadSchema: struct<keywords:map<string,int>,sentiment:float>" in p  # 2 of 7 columns


def test_month_top_k_is_limited_before_the_shuffle(corpus):
    p = plan(monthly_top_keywords(corpus.hits()))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_relation_aggregate_is_partial_then_final(corpus):
    p = plan(relations(topic_hits(corpus.star, None)))
    assert "partial_sum" in p
    assert p.count("Exchange hashpartitioning") == 1  # all-topics: one shuffle, no self join


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("read_status_partition", "relation_store_roundtrip")))
def test_no_python_in_any_plan(corpus, name):
    p = plan(QUERIES[name](corpus))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF", p)


def test_topic_history_limits_each_month_before_the_shuffle(corpus):
    from cotopic.operators import topic_history
    p = plan(topic_history(corpus.hits()))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "Join" not in p  # gap filling by map lookup: no join at all

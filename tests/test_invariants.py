"""Invariants on random corpora (hypothesis)."""

from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cotopic.operators import (
    monthly_top_keywords, relation_months, relation_sources, relations, topic_history, topic_hits,
)
from cotopic.schema import NEWS

VOCAB = ["t", "a", "b", "c", "d e", "f"]

row = st.tuples(
    st.integers(2019, 2021).flatmap(lambda y: st.integers(1, 12).map(lambda m: y * 100 + m)),
    st.sampled_from(["s1", "s2", None]),
    st.integers(1, 28).map(lambda d: f"https://archive.example/noFrame/replay/2020{d:04d}000000/https://www.x.example/n-{d}"),
    st.dictionaries(st.sampled_from(VOCAB), st.integers(0, 9), min_size=1, max_size=5),
    st.one_of(st.none(), st.integers(-4, 4).map(lambda k: k / 4)),
)
corpus = st.lists(row, min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows):
    data = [(ts, src, url, i, 1.0, kw, s) for i, (ts, src, url, kw, s) in enumerate(rows)]
    return spark.createDataFrame(data, NEWS)


@SETTINGS
@given(rows=corpus)
def test_children_sum_to_their_relation(spark, rows):
    news = frame(spark, rows)
    hits = topic_hits(news, "t")
    rel = {r.keyword: r for r in relations(hits).collect()}
    months, sources = {}, {}
    for r in relation_months(hits).collect():
        months[r.keyword] = months.get(r.keyword, 0) + r.mentions
    for r in relation_sources(hits).collect():
        sources[r.keyword] = sources.get(r.keyword, 0) + r.articles
    assert set(months) == set(rel) == set(sources)
    for k, r in rel.items():
        assert months[k] == r["count"]
        assert sources[k] == r.articles


@SETTINGS
@given(rows=corpus)
def test_tone_is_a_weighted_mean(spark, rows):
    news = frame(spark, rows)
    hits = topic_hits(news, "t").collect()
    for r in relations(topic_hits(news, "t")).collect():
        tones = [h.sentiment for h in hits if h.keywords.get(r.keyword) is not None and h.sentiment is not None
                 and h.keywords[r.keyword] > 0]
        if r.sentiment is None:
            continue
        assert min(tones) - 1e-9 <= r.sentiment <= max(tones) + 1e-9


@SETTINGS
@given(rows=corpus)
def test_top_list_and_gap_free_history(spark, rows):
    news = frame(spark, rows)
    hits = topic_hits(news, "t")
    per = {}
    for r in monthly_top_keywords(hits).collect():
        per.setdefault(r.timestamp, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in per.values())
    months = sorted(date(int(m[:4]), int(m[5:]), 1) for m in (r.month for r in topic_history(hits).collect()))
    for a, b in zip(months, months[1:]):
        assert (b.year * 12 + b.month) - (a.year * 12 + a.month) == 1


@SETTINGS
@given(rows=corpus)
def test_partitioning_and_topic_form_do_not_change_results(spark, rows):
    news = frame(spark, rows)
    one = sorted(tuple(r) for r in relations(topic_hits(news.repartition(1), "t")).collect())
    many = sorted(tuple(r) for r in relations(topic_hits(news.repartition(7), "t")).collect())
    every = sorted(tuple(r) for r in relations(topic_hits(news, None)).where("topic = 't'").collect())
    assert one == many == every


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(groups=st.dictionaries(st.sampled_from(["t", "u", "hot", "v"]),
                              st.lists(st.one_of(st.none(), st.integers(-8, 8).map(lambda k: k / 8)),
                                       min_size=1, max_size=60), min_size=1))
def test_distributed_quantiles_equal_percentile(spark, groups):
    from cotopic.operators.nodes import sentiment_quantiles
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "topic string, sentiment double").repartition(3)
    a = {r.topic: tuple(r)[1:] for r in sentiment_quantiles(df).collect()}
    b = {r.topic: tuple(r)[1:] for r in sentiment_quantiles(df, method="distributed").collect()}
    assert a == b

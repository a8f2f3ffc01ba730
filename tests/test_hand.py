"""Worked answers on the 7-article hand-made corpus (topic "q")."""

import pytest
from pyspark.sql import functions as F

from cotopic.operators import (
    corpus_summary, keyword_weights, monthly_articles, monthly_top_keywords, neighbours, recommend,
    relation_articles, relation_exists, relation_history, relation_months, relation_nodes,
    relation_sources, relation_summary, relation_years, relations, relations_nested,
    sentiment_quantiles, sentiment_thresholds, top_relations, topic_history, topic_hits,
    topic_sources, topic_summary,
)


@pytest.fixture(scope="module")
def hits(hand):
    return topic_hits(hand, "q")


@pytest.fixture(scope="module")
def rel(hits):
    return relations(hits, extremes=True)  # the stored-record shape


def as_dict(df, key, *vals):
    return {r[key]: tuple(r[v] for v in vals) if len(vals) > 1 else r[vals[0]] for r in df.collect()}


def test_hits_and_summary(hits):
    assert sorted(r.id for r in hits.collect()) == [1, 2, 3, 4, 7]  # id 5 has exactly 4
    s = topic_summary(hits).first()
    assert (s.articles, s.first_month, s.first_label) == (5, 201501, "janeiro de 2015")


def test_topic_sources(hits):
    got = as_dict(topic_sources(hits), "source", "articles", "pct")
    assert got == {"alpha": (3, 60.0), "beta": (1, 20.0), None: (1, 20.0)}


def test_relations_null_tone_left_out(rel):
    got = as_dict(rel, "keyword", "count", "sentiment")
    assert set(got) == {"q", "a", "b", "c"}  # d (4 mentions) is cut
    assert got["q"][0] == 30 and got["q"][1] == pytest.approx(-0.13)
    assert got["a"] == (6, pytest.approx(1 / 3))
    assert got["b"] == (5, pytest.approx(-0.7))
    assert got["c"] == (8, pytest.approx(-0.5))


def test_relation_sources_count_articles(hits):
    got = {(r.keyword, r.source): r.articles for r in relation_sources(hits).collect() if r.keyword != "q"}
    assert got == {("a", "alpha"): 1, ("a", "beta"): 1, ("b", "alpha"): 2, ("c", "beta"): 1, ("c", None): 1}


def test_relation_months_count_mentions(hits):
    got = {(r.keyword, r.timestamp): r.mentions for r in relation_months(hits).collect() if r.keyword != "q"}
    assert got == {("a", 201501): 6, ("b", 201501): 1, ("b", 201504): 4, ("c", 201501): 7, ("c", 201504): 1}


def test_monthly_articles_count_known_urls(hits):
    assert as_dict(monthly_articles(hits), "timestamp", "articles") == {201501: 2, 201503: 1, 201504: 1}


def test_monthly_top_keywords_ties_by_name(hits):
    rows = monthly_top_keywords(hits).orderBy("timestamp", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.timestamp, []).append(r.keyword)
    assert got == {201501: ["c", "a", "b"], 201504: ["b", "d", "c"]}


def test_topic_history_reference_exact(hits):
    got = as_dict(topic_history(hits), "month", "articles", "top_label")
    assert got == {
        "2015-01": (2, "1. c<br>2. a<br>3. b"),
        "2015-02": (0, "-"),
        "2015-03": (0, "-"),  # only the topic is mentioned that month
        "2015-04": (1, "1. b<br>2. d<br>3. c"),
    }
    labels = as_dict(topic_history(hits), "month", "month_label")
    assert labels["2015-03"] == "março de 2015"


def test_topic_history_keep_topic_only_months(hits):
    got = as_dict(topic_history(hits, keep_topic_only_months=True), "month", "articles")
    assert got == {"2015-01": 2, "2015-02": 0, "2015-03": 1, "2015-04": 1}


def test_relation_history(hits, rel):
    got = as_dict(relation_history(hits, rel.where("keyword = 'a'")), "month", "articles", "mentions")
    assert got == {"2015-01": (2, 6), "2015-02": (0, 0), "2015-03": (1, 0), "2015-04": (1, 0)}


def test_quantiles_of_neighbours(rel):
    q = sentiment_quantiles(neighbours(rel)).first()
    assert (q.q10, q.q30, q.q70, q.q90) == pytest.approx((-0.66, -0.58, -1 / 6, 1 / 6))


def test_nodes_default(rel):
    got = as_dict(relation_nodes(rel), "keyword", "band", "size", "color")
    assert got["a"][0] == "very positive" and got["a"][1] == pytest.approx(50.404519, abs=1e-6)
    assert got["b"][0] == "very negative" and got["b"][1] == pytest.approx(50.0)
    assert got["c"][0] == "neutral" and got["c"][1] == pytest.approx(51.674302, abs=1e-6)
    assert got["b"][2] == "#CC0000"


def test_thresholds_and_sizes_with_small_top(rel):
    neigh = neighbours(rel)
    top = top_relations(neigh, 2)
    assert sorted(r.keyword for r in top.collect()) == ["a", "c"]
    t = sentiment_thresholds(neigh, 2).first()
    assert (t.q10, t.q30, t.q70, t.q90) == pytest.approx((-0.514, -0.349, 0.008333333, 0.216666667), abs=1e-6)
    sizes = as_dict(relation_nodes(rel, n=2), "keyword", "size")
    assert sizes == {"a": pytest.approx(50.0), "c": pytest.approx(50.801772, abs=1e-6)}


def test_nodes_from_hits_equal_nodes_from_stored_record(hits, rel):
    from_hits = sorted(tuple(r) for r in relation_nodes(relations(hits), hits=hits).drop("sentiment").collect())
    stored = sorted(tuple(r) for r in relation_nodes(rel).drop("sentiment").collect())
    assert from_hits == stored
    with pytest.raises(ValueError):
        relation_nodes(relations(hits))  # no extremes and no hits


def test_node_labels_and_seen(rel):
    n = {r.keyword: r for r in relation_nodes(rel).collect()}
    assert n["b"].first_seen == "2015/01" and n["b"].last_seen == "2015/04"
    assert n["b"].caption == "Tópico: b<br>Menções: 5<br>Último registo: 2015/04"


def test_relation_years(hits, rel):
    got = {(r.keyword, r.year): r.mentions for r in relation_years(hits, rel).collect()}
    assert got == {("a", 2015): 6, ("b", 2015): 5, ("c", 2015): 8}


def test_articles_dedup_by_title(hits, rel):
    arts = relation_articles(hits, rel.where("keyword = 'a'")).collect()
    assert len(arts) == 1  # ids 1 and 2 share the key big-story
    a = arts[0]
    assert (a.title, a.capture_date, a.host) == ("big-story", "2015-01-10", "alpha.example")
    assert a.original_url == "http://www.alpha.example/Big-Story/"


def test_articles_without_dedup_keeps_every_pair(hits, rel):
    assert relation_articles(hits, rel.where("keyword = 'a'"), dedup=False).count() == 2


def test_articles_of_topic(hits, rel):
    titles = {r.title for r in relation_articles(hits, rel.where("keyword = 'q'")).collect()}
    assert titles == {"big-story", "12345?ref=a", "other-tale", None}


def test_exists_summary_recommend_weights(rel):
    ex = as_dict(relation_exists(rel, [" a ", "d", "q"]), "keyword", "present")
    assert ex == {"a": True, "d": False, "q": False}  # the topic is not its own relation
    s = as_dict(relation_summary(rel, ["c"]), "keyword", "gauge")
    assert s == {"c": pytest.approx(25.0)}
    rec = [r.keyword for r in recommend(rel).collect()]
    assert sorted(rec) == ["a", "b", "c"]
    assert as_dict(keyword_weights(rel), "keyword", "count") == {"a": 6, "b": 5, "c": 8}


def test_random_recommend_is_a_sample_without_replacement(rel):
    rec = [r.keyword for r in recommend(rel, n=2, deterministic=False, seed=7).collect()]
    assert len(rec) == 2 and len(set(rec)) == 2 and set(rec) <= {"a", "b", "c"}


def test_nested_record(hits):
    n = {r.keyword: r for r in relations_nested(hits).collect()}
    assert dict(n["b"].date) == {"201501": 1, "201504": 4}
    assert dict(n["c"].source) == {"beta": 1} and n["c"].source_unknown == 1
    j = relations_nested(hits).where("keyword = 'q'").select(F.to_json("date")).first()[0]
    assert j == '{"201501":11,"201503":9,"201504":10}'


def test_all_topics_and_topic_lists(hand):
    all_rel = {(r.topic, r.keyword): r["count"] for r in relations(topic_hits(hand, None)).collect()}
    assert all_rel[("q", "a")] == 6 and all_rel[("a", "a")] == 55 and all_rel[("c", "q")] == 6
    listed = relations(topic_hits(hand, ["q"])).collect()
    single = relations(topic_hits(hand, "q")).collect()
    assert sorted((r.keyword, r["count"]) for r in listed) == sorted((r.keyword, r["count"]) for r in single)
    table = hand.sparkSession.createDataFrame([("q",), ("zz",)], "topic string")
    from_table = relations(topic_hits(hand, table)).collect()
    assert sorted((r.keyword, r["count"]) for r in from_table) == sorted((r.keyword, r["count"]) for r in single)


def test_no_hits_gives_empty_frames(hand):
    hits = topic_hits(hand, "nothing")
    rel = relations(hits)
    assert rel.count() == 0
    assert relation_nodes(rel, hits=hits).count() == 0
    assert topic_history(hits).count() == 0


def test_only_topic_passes_cut(hand):
    hits = topic_hits(hand, "q")
    rel = relations(hits, min_count=20)  # only q itself (30) survives
    assert [r.keyword for r in rel.collect()] == ["q"]
    assert relation_nodes(rel, hits=hits).count() == 0


def test_corpus_summary(hand):
    s = corpus_summary(hand).first()
    assert (s.articles, s.first_month, s.last_month) == (7, 201501, 201505)


def test_nested_json_round_trip(spark, hits):
    from cotopic.session import persisted, scratch_path
    from cotopic.sources.news import read_relations_json, write_relations_json
    path = scratch_path(spark, "nested-json")
    with persisted(relations_nested(hits)) as nested:
        write_relations_json(nested, path)
        want = sorted((r.keyword, r["count"], dict(r.date), dict(r.source)) for r in nested.collect())
    back = read_relations_json(spark, path)
    got = sorted((r.keyword, r["count"], dict(r.date), dict(r.source)) for r in back.collect())
    assert got == want


def test_fill_months_and_spine(spark):
    from datetime import date

    from cotopic.operators import fill_months
    df = spark.createDataFrame([("t", date(2020, 11, 1), 3), ("t", date(2021, 2, 1), 1), ("u", date(2020, 1, 1), 2)],
                               "topic string, month date, n int")
    got = sorted((r.topic, r.month.isoformat(), r.n) for r in fill_months(df, ["topic"], {"n": 0}).collect())
    assert got == [("t", "2020-11-01", 3), ("t", "2020-12-01", 0), ("t", "2021-01-01", 0), ("t", "2021-02-01", 1),
                   ("u", "2020-01-01", 2)]


def test_relation_extremes_match_the_extremes_of_relations(hits, rel):
    from cotopic.operators import relation_extremes
    got = {(r.keyword, r.first_archive, r.last_archive) for r in relation_extremes(hits, rel).collect()}
    assert got == {(r.keyword, r.first_archive, r.last_archive) for r in rel.collect()}


def test_ordered_articles_newest_first(hits, rel):
    from cotopic.operators import ordered_articles
    rows = ordered_articles(relation_articles(hits, rel.where("keyword = 'q'"))).collect()
    dates = [r.capture_date for r in rows if r.capture_date]
    assert dates == sorted(dates, reverse=True)
    assert rows[-1].capture_date is None


def test_history_peak_of_two_series(hits, rel):
    from cotopic.operators import history_peak
    rh = relation_history(hits, rel.where("keyword = 'a'"))
    peak = history_peak(rh, ["articles", "mentions"], keys=["topic", "keyword"]).first().peak
    assert peak == pytest.approx(6 * 1.1)
    assert history_peak(topic_history(hits), ["articles"]).first().peak == pytest.approx(2 * 1.1)


def test_distributed_quantiles_give_the_same_nodes(spark, rel):
    from cotopic.plans.catalogue import Corpus
    default = sorted(tuple(r) for r in relation_nodes(rel).collect())
    distributed = sorted(tuple(r) for r in relation_nodes(rel, quantiles="distributed").collect())
    assert default == distributed
    star = Corpus(spark, "/root/testdata/sf0.001")
    srel = relations(topic_hits(star.star, "red gear"), extremes=True)
    a = sorted(tuple(r) for r in relation_nodes(srel, n=20).collect())
    b = sorted(tuple(r) for r in relation_nodes(srel, n=20, quantiles="distributed").collect())
    assert a == b


def test_approximate_quantiles_stay_within_the_tone_range(rel):
    q = sentiment_quantiles(neighbours(rel), approx=True).first()
    tones = [r.sentiment for r in neighbours(rel).collect()]
    assert all(min(tones) <= v <= max(tones) for v in (q.q10, q.q30, q.q70, q.q90))
    assert relation_nodes(rel, approx=True).count() == 3


def test_outlet_table_of_any_size(spark):
    from cotopic.operators import match_outlet
    hosts = spark.createDataFrame([("expresso.pt",), ("none.example",), (None,)], "host string")
    rows = [(i, f"t{i}") for i in range(20_000)] + [(-1, "sso.p"), (7, "xpress")]
    table = spark.createDataFrame(rows, "position int, token string")
    got = {r.host: r.outlet for r in match_outlet(hosts, "host", table).collect()}
    assert got == {"expresso.pt": "sso.p", "none.example": "404", None: "404"}


def test_a_given_relation_set_decides(spark, hand):
    from cotopic.operators import relation_nodes, relation_sources, relation_years, relations, topic_hits
    hits = topic_hits(hand, "q")
    rel = relations(hits, min_count=1)
    names = {r.keyword for r in rel.collect()}
    assert {"b", "d"} <= names
    assert {r.keyword for r in relation_sources(hits, rel).collect()} == names
    assert {r.keyword for r in relation_years(hits, rel).collect()} == names - {"q"}
    assert {r.keyword for r in relation_nodes(rel, hits=hits).collect()} == names - {"q"}


def test_months_that_are_none(spark):
    from cotopic.functions.labels import month_start, yyyymm_label
    df = spark.createDataFrame([(202001,), (20200115,), (202000,), (202013,), (2020,), (None,)], "t int")
    got = [(r.m and str(r.m), r.l) for r in df.select(month_start("t").alias("m"), yyyymm_label("t").alias("l")).collect()]
    assert got[0] == ("2020-01-01", "janeiro de 2020")
    assert [m for m, _ in got[1:]] == [None] * 5 and got[2][1] is None and got[3][1] is None

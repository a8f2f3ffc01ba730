"""The whole-search report over one materialized hit set."""

from cotopic.plans.report import relation_detail, topic_search


def test_topic_search_and_detail(hand):
    search = topic_search(hand, "q")
    assert search["summary"].first().articles == 5
    assert {r.keyword for r in search["nodes"].collect()} == {"a", "b", "c"}
    assert {r.keyword: r["count"] for r in search["weights"].collect()} == {"a": 6, "b": 5, "c": 8}
    assert search["history"].count() == 4
    detail = relation_detail(search, " a ")
    assert [(r.keyword, r["count"]) for r in detail["summary"].collect()] == [("a", 6)]
    assert {r.month: (r.articles, r.mentions) for r in detail["history"].collect()} == {
        "2015-01": (2, 6), "2015-02": (0, 0), "2015-03": (1, 0), "2015-04": (1, 0)}
    assert {r.source: r.articles for r in detail["sources"].collect()} == {"alpha": 1, "beta": 1}
    assert [r.title for r in detail["articles"].collect()] == ["big-story"]
    assert detail["suggestions"].count() == 3


def test_missing_relation_has_empty_detail(hand):
    detail = relation_detail(topic_search(hand, "q"), "zzz")
    assert detail["summary"].count() == 0 and detail["history"].count() == 0
    assert detail["suggestions"].count() == 3

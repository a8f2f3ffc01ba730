"""Quantiles selected between bounds, article ties, order of presentation, outlet tables."""

import random

import pytest
from pyspark.sql import functions as F

from cotopic.operators import (
    match_outlet, newest_articles, ordered_articles, ordered_history, recommend, relation_articles, relation_history, relations, topic_history, topic_hits,
)
from cotopic.operators.nodes import selected_quantiles, sentiment_quantiles
from cotopic.schema import NEWS
from tests.conftest import U


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot key with two thirds of all values, many of them equal, over thirteen orders of magnitude; small keys; keys without values."""
    v = F.when(F.col("id") % 7 == 0, F.lit(0.5)).when(F.col("id") % 11 == 0, None).otherwise(F.round(F.randn(3) * F.pow(F.lit(10.0), F.rand(4) * 6), 9))
    key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    df = spark.range(60_000, numPartitions=6).select(key.alias("topic"), v.alias("sentiment"))
    df = df.union(spark.createDataFrame([("void", None), ("one", 1.25), ("two", -1.0), ("two", 3.0)], df.schema))
    return df.cache()


def test_selection_is_exact(spark, skewed):
    got = sorted(tuple(r) for r in selected_quantiles(skewed, "topic", "sentiment").collect())
    assert got == sorted(tuple(r) for r in sentiment_quantiles(skewed, method="aggregate").collect())
    for accuracy in (10, 100):  # narrow sketches: the bounds are used for small keys, too
        assert got == sorted(tuple(r) for r in selected_quantiles(skewed, "topic", "sentiment", accuracy).collect())


def test_selection_is_lazy_and_spreads_a_key(spark, hand):
    df = sentiment_quantiles(relations(topic_hits(hand, "q")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "_part" in plan and "partial_percentile" in plan


def test_relation_history_reads_the_hits_once(spark, hand, tmp_path):
    hand.write.parquet(str(tmp_path / "c"))
    df = relation_history(topic_hits(spark.read.parquet(str(tmp_path / "c")), "q"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "NestedLoop" not in plan


def articles_by_hand(rows, topic):
    from urllib.parse import urlsplit  # noqa: F401
    best = {}
    for ts, src, url, i, p, kw, tone in rows:
        if kw.get(topic, 0) <= 4:
            continue
        title, when = url.rstrip("/").rsplit("/", 1)[-1].lower(), int(url.split("/")[5])
        for k, n in kw.items():
            if k != topic and n is not None:
                key = (k, title)
                if key not in best or (-when, url) < best[key]:
                    best[key] = (-when, url)
    return sorted((k, u) for (k, _), (_, u) in best.items())


def test_ties_of_title_and_capture(spark):
    """Different URLs of one title and second: the smallest that has the keyword wins, keyword by keyword."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        host = rng.choice(["a.example", "b.example", "c.example"])
        day = rng.choice(["20200101", "20200102"])
        kw = {"t": rng.choice([3, 5, 9]), **{k: rng.randrange(5, 9) for k in rng.sample("uvwxyz", 3)}}
        rows.append((202001, "s", U(day, f"https://{host}/some-{rng.choice('pq')}"), i, 1.0, kw, 0.5))
    news = spark.createDataFrame(rows, NEWS).repartition(3)
    got = sorted((r.keyword, r.archive) for r in relation_articles(topic_hits(news, "t")).collect())
    assert got == articles_by_hand(rows, "t")
    plan = relation_articles(topic_hits(news, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_mentions_of_an_article_list_are_shuffled_twice(spark, hand):
    """Once by keyword, for de-duplication and count cut together, once as slim winners to their articles."""
    hits = topic_hits(hand, "q")
    listed = relation_articles(hits)
    listed.collect()
    plan = listed._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(" in x and "Reused" not in x]
    assert len(dealt) <= 5 and sum("REPARTITION_BY_COL" in x for x in dealt) == 1 and "Reused" in plan  # mentions, counts, cut, winners, articles


def test_presentation_order(spark, hand):
    hits = topic_hits(hand, "q")
    listed = [(r.keyword, r.capture_date, r.archive) for r in ordered_articles(relation_articles(hits)).collect()]
    key = lambda x: (x[0], x[1] is None, [-ord(c) for c in x[1] or ""], x[2] is None, [-ord(c) for c in x[2] or ""])
    assert listed == sorted(listed, key=key) and len({x[0] for x in listed}) > 1
    newest = newest_articles(relation_articles(hits), 1).collect()
    assert {(r.keyword, r.archive) for r in newest} == {(k, next(a for kk, _, a in listed if kk == k)) for k, _, _ in listed}
    months = [(r.topic, r.month) for r in ordered_history(topic_history(topic_hits(hand, ["q", "a"]))).collect()]
    assert months == sorted(months) and len(months) > 2
    rel = [(r.keyword, r.month) for r in ordered_history(relation_history(hits)).collect()]
    assert rel == sorted(rel)


def test_random_suggestions_are_neighbours(spark, hand):
    rel = relations(topic_hits(hand, "q"))
    names = {r.keyword for r in rel.collect()} - {"q"}
    for seed in (1, 2):
        drawn = [r.keyword for r in recommend(rel, 2, seed=seed, deterministic=False).collect()]
        assert len(set(drawn)) == len(drawn) == 2 and set(drawn) <= names


def test_outlet_tables_of_any_size(spark):
    rng = random.Random(6)
    tokens = list({"".join(rng.choices("abcd", k=rng.randrange(1, 40))) for _ in range(3000)}) + ["", "zz"]
    hosts = ["".join(rng.choices("abcd.", k=rng.choice([1, 7, 40, 250]))) for _ in range(60)] + ["", "zz", None, "..", "xzzx"]
    for some in (tokens, [t for t in tokens if len(t) > 5], ["zz"]):
        table = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "position int, token string")
        got = {r.host: r.outlet for r in match_outlet(spark.createDataFrame([(h,) for h in hosts], "host string"), "host", table).collect()}
        assert got == {h: next((t for t in some if h is not None and t in h), "404") for h in hosts}
    assert match_outlet(spark.createDataFrame([("a",)], "host string"), "host", table.limit(0)).first().outlet == "404"

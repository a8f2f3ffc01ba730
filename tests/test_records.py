"""The record store: every report from stored states, batches of a growing corpus, commits over several tables."""

import pytest
from pyspark.sql import functions as F

from cotopic.operators import (
    neighbours, relation_articles, relation_history, relation_months, relation_nodes, relation_sources, relation_years, relations,
    relations_nested, topic_history, topic_hits, topic_sources, topic_summary,
)
from cotopic.schema import NEWS
from cotopic.session import scratch_path
from cotopic.sources.news import write_news
from cotopic.sources.records import Conflict, RecordStore
from tests.conftest import U


def rows(df):
    """All columns, rounded doubles, in order."""
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in (r[c] for c in cols)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def months(spark, hand):
    """The hand-made corpus as JSON files, one month after the other."""
    root = scratch_path(spark, "growing")
    write_news(hand.where("timestamp <= 201503").coalesce(1), root)
    store = RecordStore(spark, scratch_path(spark, "records"))
    assert store.refresh(root, topics=["q"]) == 1
    write_news(hand.where("timestamp > 201503").coalesce(2), root)
    return root, store


def test_a_new_month_reads_only_its_files(spark, hand, months):
    root, store = months
    read = []

    def reader(paths):
        read.append(sorted(paths))
        from cotopic.sources.news import read_news
        return read_news(spark, paths, base=root)
    before = set(store.live()[1]["articles"])
    n = store.refresh(root, read=reader, topics=["a"])
    assert n == len(read[0]) and 1 <= n <= 2
    new = [b for b in store.live()[1]["articles"] if b not in before]
    assert {r.timestamp for r in store.read("articles", new).collect()} == {201504, 201505, None} - {None}
    assert store.refresh(root, read=reader) == 0 and len(read) == 1  # nothing is read again
    assert store.read("articles").count() == hand.count()


def test_every_report_comes_from_the_store(spark, hand, months):
    root, store = months
    store.refresh(root, topics=["q", "a"])
    hits = topic_hits(hand, ["q", "a"])
    cells = store.states(["q", "a"])
    assert rows(store.relations(["q", "a"])) == rows(relations(hits, extremes=True))
    for report in (relation_months, relation_sources, topic_summary, topic_sources, topic_history, relation_history, relation_years,
                   relations_nested):
        assert rows(report(cells)) == rows(report(hits)), report.__name__
    assert rows(relation_nodes(store.relations("q"))) == rows(relation_nodes(relations(topic_hits(hand, "q"), extremes=True)))
    for kw in ("a", "b", "c"):
        one = spark.createDataFrame([("q", kw)], "topic string, keyword string")
        assert rows(relation_articles(store.hits("q", [kw]), one)) == rows(relation_articles(topic_hits(hand, "q"), one))
        assert rows(relation_history(store.states("q", [kw]), one)) == rows(relation_history(topic_hits(hand, "q"), one))
    assert rows(relation_articles(store.hits("q"))) == rows(relation_articles(topic_hits(hand, "q")))


def test_reports_read_no_corpus(months):
    root, store = months
    store.refresh(root, topics=["q"])
    for df in (store.relations("q"), relation_history(store.states("q")), relation_sources(store.states("q"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "/articles" not in plan and "keywords" not in plan and "PushedFilters: [In(topic" in plan or "EqualTo(topic,q)" in plan
    detail = store.hits("q", ["a"]).select("id", "archive", "keywords")
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert "keywords:map" not in plan  # stored maps are not read


def test_a_crash_between_two_tables_shows_nothing(spark, hand, monkeypatch):
    store = RecordStore(spark, scratch_path(spark, "records"))
    store.add_topics(["q"])
    store.add_articles(hand.where("id <= 2"))
    want = rows(store.relations("q"))
    write = RecordStore._write

    def failing(self, df, table, batch):
        if table == "totals":
            raise OSError("lost")
        write(self, df, table, batch)
    monkeypatch.setattr(RecordStore, "_write", failing)
    with pytest.raises(OSError):
        store.add_articles(hand.where("id > 2"))
    assert rows(store.relations("q")) == want and store.read("articles").count() == 2
    monkeypatch.setattr(RecordStore, "_write", write)
    store.add_articles(hand.where("id > 2"))
    assert rows(store.relations("q")) == rows(relations(topic_hits(hand, "q"), extremes=True))


def test_two_writers_from_one_state(spark, hand):
    root = scratch_path(spark, "records")
    a, b = RecordStore(spark, root), RecordStore(spark, root)
    version, _ = b.live()
    a.add_topics(["q"])
    with pytest.raises(Conflict):
        b._commit(version, {"topics": "lost"}, {})
    assert [r.topic for r in b.read("topics").collect()] == ["q"]


def test_changed_files_replace_everything(spark, hand, tmp_path):
    root = str(tmp_path / "news")
    write_news(hand.coalesce(1), root, fmt="parquet")
    store = RecordStore(spark, scratch_path(spark, "records"))
    store.refresh(root, fmt="parquet", topics=["q"])
    fewer = hand.where("id <> 2")
    fewer.withColumn("status", F.lit("success")).coalesce(1).write.mode("overwrite").partitionBy("status").parquet(root)
    assert store.refresh(root, fmt="parquet") == 1
    assert rows(store.relations("q")) == rows(relations(topic_hits(fewer, "q"), extremes=True))
    assert [r.topic for r in store.read("topics").collect()] == ["q"]


def test_compaction_keeps_every_row(spark, hand):
    store = RecordStore(spark, scratch_path(spark, "records"))
    store.add_topics(["q", "nothing"])
    for k in range(3):
        store.add_articles(hand.where(F.col("id") % 3 == k))
    store.add_topics(["a"])
    want, months = rows(store.relations()), rows(relation_months(store.states()))
    store.compact()
    assert len(store.live()[1]["cells"]) == len(store.live()[1]["totals"]) == 1
    assert rows(store.relations()) == want == rows(relations(topic_hits(hand, ["q", "a"]), extremes=True))
    assert rows(relation_months(store.states())) == months
    assert store.relations("nothing").count() == 0 and neighbours(store.relations("unknown")).count() == 0


def test_other_cut_off_is_refused(spark, hand):
    root = scratch_path(spark, "records")
    RecordStore(spark, root).add_topics(["q"])
    with pytest.raises(ValueError):
        RecordStore(spark, root, min_mentions=9).live()


def test_random_batches_fold_to_the_full_run(spark):
    import random
    rng = random.Random(7)
    data = [(202001 + rng.randrange(6), rng.choice(["s1", "s2", None]), rng.choice([None, U("20200101", f"https://www.x.example/n-{i}")]), i % 40, 1.0,
             {k: rng.randrange(9) for k in rng.sample("tabcdef", 4)}, rng.choice([None, -0.5, 0.25, 1.0])) for i in range(120)]
    news = spark.createDataFrame(data, NEWS)
    store = RecordStore(spark, scratch_path(spark, "records"))
    store.add_topics(["t"])
    for part in news.randomSplit([1.0, 2.0, 1.0], 5):
        store.add_articles(part)
    store.add_topics(["a", "b"])
    hits = topic_hits(news, ["t", "a", "b"])
    assert rows(store.relations()) == rows(relations(hits, extremes=True))
    assert rows(relation_sources(store.states())) == rows(relation_sources(hits))
    assert rows(topic_history(store.states())) == rows(topic_history(hits))


def test_a_stored_search_equals_a_fresh_one(spark, hand, months):
    from cotopic.plans.report import relation_detail, stored_detail, stored_search, topic_search
    root, store = months
    store.refresh(root, topics=["q"])
    fresh, stored = topic_search(hand, "q"), stored_search(store, "q")
    for name in ("summary", "sources", "history", "nodes", "years", "weights"):
        assert rows(stored[name]) == rows(fresh[name]), name
    a, b = relation_detail(fresh, "a"), stored_detail(store, "q", " a ")
    for name in ("summary", "history", "sources", "articles", "suggestions"):
        assert rows(b[name].drop("pick")) == rows(a[name].drop("pick")), name
    assert all(df.count() == 0 for df in stored_search(store, "nowhere").values())

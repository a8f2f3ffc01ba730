"""Relation store: round trip, reuse without recompute, invalidation on corpus change."""

from pyspark.sql import functions as F

from cotopic.operators import relations, topic_hits
from cotopic.session import scratch_path
from cotopic.sources import store as store_module
from cotopic.sources.store import RelationStore, corpus_fingerprint


def rows(df):
    return sorted((r.topic, r.keyword, r["count"]) for r in df.select("topic", "keyword", "count").collect())


def every_topic(hand):
    return hand.select(F.explode(F.map_keys("keywords")).alias("topic")).distinct()


def test_round_trip_topic_table(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    got = store.get_or_compute(hand, every_topic(hand))
    assert rows(got) == rows(relations(topic_hits(hand, None)))


def test_a_batch_written_twice_reads_once(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    rel = relations(topic_hits(hand, "q"), extremes=True)
    todo = spark.createDataFrame([("q",)], "topic string")
    store.write(rel, todo, "f")
    store.write(rel, todo, "f")
    assert rows(store.read("f", ["q"])) == rows(rel)


def test_only_missing_topics_are_computed(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    store.get_or_compute(hand, ["q"])
    fp = corpus_fingerprint(hand)
    assert store.index(fp).count() == 1
    store.get_or_compute(hand, ["q", "a", "nothing"])
    idx = {r.topic: r.relations for r in store.index(fp).collect()}
    assert idx == {"q": 4, "a": 2, "nothing": 0}  # an empty topic is remembered too
    again = store.get_or_compute(hand, ["q"])
    assert rows(again) == rows(relations(topic_hits(hand, "q")))
    assert store.index(fp).count() == 3  # nothing recomputed


def test_changed_corpus_is_not_served_stale(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    store.get_or_compute(hand, ["q"])
    changed = hand.withColumn("sentiment", F.when(F.col("id") == 1, F.lit(-1.0).cast("float")).otherwise(F.col("sentiment")))
    assert corpus_fingerprint(changed) != corpus_fingerprint(hand)
    got = {r.keyword: r.sentiment for r in store.get_or_compute(changed, ["q"]).collect()}
    want = {r.keyword: r.sentiment for r in relations(topic_hits(changed, "q")).collect()}
    assert got == want


def test_unindexed_batches_are_invisible(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    fp = corpus_fingerprint(hand)
    rel = relations(topic_hits(hand, "q"), extremes=True)
    rel.withColumn("topic_key", F.lit("x")).withColumn("key_prefix", F.lit("xx")) \
       .withColumn("batch", F.lit("crashed")).withColumn("fp", F.lit(fp)) \
       .write.partitionBy("fp", "batch", "key_prefix").parquet(store.data_path)  # data without index rows
    assert store.read(fp).count() == 0


def test_files_fingerprint_reads_no_row_and_tracks_files(spark, hand):
    from cotopic.sources.news import materialize
    from cotopic.sources.store import files_fingerprint
    path = scratch_path(spark, "fp-a")
    a = materialize(hand, path)
    b = materialize(hand, scratch_path(spark, "fp-b"))
    assert files_fingerprint(a) == files_fingerprint(spark.read.parquet(path))
    assert files_fingerprint(a) != files_fingerprint(b)
    assert files_fingerprint(a) != files_fingerprint(a, version="2")
    store = RelationStore(spark, scratch_path(spark, "store"))
    got = store.get_or_compute(a, ["q"], fingerprint="files")
    assert rows(got) == rows(relations(topic_hits(hand, "q")))
    assert rows(store.get_or_compute(a, ["q"], fingerprint="v1")) == rows(got)


def test_listed_topics_are_read_with_partition_pruning(spark, hand):
    store = RelationStore(spark, scratch_path(spark, "store"))
    store.get_or_compute(hand, every_topic(hand))
    fp = corpus_fingerprint(hand)
    df = store.read(fp, ["q"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_prefix" in plan and "fp" in plan
    assert "PushedFilters: [" in plan and "topic_key" in plan
    assert rows(df) == rows(relations(topic_hits(hand, "q")))


def test_extremes_of_a_batch_need_no_sort_of_mentions(spark, hand, monkeypatch):
    """URLs are compared as numbers, by hash; null, equal and odd URLs come back as the strings they were."""
    plans = []

    def seen(*args, **kwargs):
        out = relations(*args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    odd = hand.withColumn("archive", F.when(F.col("id") == 4, F.lit("")).when(F.col("id") == 5, F.lit("\u00e9\U0001f600")).otherwise(F.col("archive")))
    news = hand.unionByName(odd).unionByName(hand.limit(2)).withColumn("id", F.when(F.col("id") != 2, F.col("id")))
    want = relations(topic_hits(news, None), extremes=True)
    monkeypatch.setattr(store_module, "relations", seen)
    got = RelationStore(spark, scratch_path(spark, "store")).get_or_compute(news, every_topic(hand), fingerprint="1")

    def whole(df):
        return sorted(((r.topic, r.keyword, r["count"], r.sentiment if r.sentiment is None else round(r.sentiment, 9), r.articles,
                        r.first_archive, r.last_archive) for r in df.collect()), key=str)
    assert whole(got) == whole(want)
    assert plans and all("HashAggregate" in p and "SortAggregate" not in p for p in plans)


def test_numbers_follow_the_order_of_urls(spark, hand):
    path = scratch_path(spark, "numbers")
    rows = store_module.number_urls(hand.unionByName(hand), path, rows=2).orderBy("_at").collect()
    known = [r.archive for r in rows if r["_at"] is not None]
    assert len(rows) == 14 and known == sorted(known) and len(known) == 12
    assert all(r.archive is None for r in rows if r["_at"] is None)

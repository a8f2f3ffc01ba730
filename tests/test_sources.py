"""Article scans: JSON with the fixed schema, malformed lines, status partitions, Parquet."""

import os

from cotopic.operators import corpus_summary, relations, topic_hits
from cotopic.session import scratch_path
from cotopic.sources.layout import read_hits, write_search_layout
from cotopic.sources.news import materialize, read_news, write_news


def test_malformed_json_lines_are_counted_as_null_rows(spark, hand):
    root = scratch_path(spark, "json")
    write_news(hand, root, status="success")
    leaf = os.path.join(root.replace("file:", ""), "status=success")
    with open(os.path.join(leaf, "part-broken.json"), "w") as f:
        f.write("{not json\n")
    news = read_news(spark, root, status="success")
    s = corpus_summary(news).first()
    assert s.articles == 8 and s.last_month == 201505  # the broken line is an all-null row
    assert relations(topic_hits(news, "q")).count() == 4  # and it is never a hit


def test_read_all_statuses_keeps_the_column(spark, hand):
    root = scratch_path(spark, "json")
    write_news(hand, root, status="success")
    write_news(hand.limit(3), root, status="failed")
    assert read_news(spark, root, status="failed").count() == 3
    both = read_news(spark, root, status=None)
    assert both.count() == 10
    assert {r.status: r["count"] for r in both.groupBy("status").count().collect()} == {"success": 7, "failed": 3}


def test_parquet_corpus_round_trip(spark, hand):
    path = scratch_path(spark, "parquet")
    materialize(hand, path)
    news = read_news(spark, path, fmt="parquet", status=None)
    assert sorted(r.id for r in topic_hits(news, "q").collect()) == [1, 2, 3, 4, 7]


def test_search_layout_gives_the_hits_of_a_topic(spark, hand):
    path = scratch_path(spark, "layout")
    write_search_layout(hand, path)
    rows = lambda df: sorted(map(str, df.select("topic", *hand.columns).collect()))
    for topic in ("q", "a", "c", "nothing"):
        assert rows(read_hits(spark, path, topic)) == rows(topic_hits(hand, topic))
    assert rows(read_hits(spark, path, "q", 5)) == rows(topic_hits(hand, "q", 5))
    plan = read_hits(spark, path, "q")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(keyword,q)" in plan and "GreaterThan(n,4)" in plan
    plan = read_hits(spark, path, "q").select("id", "source")._jdf.queryExecution().executedPlan().toString()
    assert "keywords" not in plan  # a report that needs no map reads none
    few = read_hits(spark, path, "q", keywords=["a", "z"])
    want = [(r.id, {k: v for k, v in r.keywords.items() if k in ("q", "a")}) for r in topic_hits(hand, "q").collect()]
    assert sorted((r.id, sorted(r.keywords.items())) for r in few.collect()) == sorted((i, sorted(m.items())) for i, m in want)
    assert "keywords:map" not in few._jdf.queryExecution().executedPlan().toString()
    write_search_layout(hand.limit(0), path + "-empty")
    assert read_hits(spark, path + "-empty", "q").count() == 0


def test_every_line_is_an_article_or_a_reject(spark, hand, tmp_path):
    from cotopic.sources.news import read_news_checked
    root = str(tmp_path / "news")
    write_news(hand, root)
    bad = ['{"timestamp": 201501, "id": 1', "no json", '{"timestamp": "many", "id": 9}', "[1]", "7"]
    spark.createDataFrame([(x,) for x in [*bad, "", "   ", "{}"]], "value string").coalesce(1).write.mode("append").text(root + "/status=success")
    spark.createDataFrame([("broken too",)], "value string").coalesce(1).write.mode("append").text(root + "/status=failed")
    rows, rejects = read_news_checked(spark, root, str(tmp_path / "out"))
    assert sorted(r.line for r in rejects.collect()) == sorted(bad)
    assert all("status=success" in r.file for r in rejects.collect())
    as_text = lambda df: sorted(map(str, df.select(*hand.columns).collect()))
    assert as_text(rows.where("id is not null")) == as_text(hand) and rows.count() == hand.count() + 1  # {} has no field, but is an object
    assert read_news_checked(spark, root, str(tmp_path / "all"), status=None)[1].count() == len(bad) + 1


def test_summary_reads_no_row(spark, hand, tmp_path):
    from cotopic.operators import corpus_summary
    from cotopic.sources.news import summary_from_statistics
    path = str(tmp_path / "corpus")
    hand.repartition(3).write.parquet(path)
    df = summary_from_statistics(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(timestamp), MAX(timestamp)]" in plan
    assert df.collect() == corpus_summary(hand).collect()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session keeps its settings


def test_layout_is_within_twice_the_corpus(spark, tmp_path):
    """On the text corpus, all postings included; a search reads a part of the postings."""
    import glob
    import os

    import pyarrow.parquet as pq

    from cotopic.sources.fixtures import text_news
    news = text_news(spark, "/root/testdata/sf0.01")
    news.write.option("compression", "zstd").parquet(str(tmp_path / "corpus"))
    write_search_layout(spark.read.parquet(str(tmp_path / "corpus")), str(tmp_path / "layout"))
    size = lambda p: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{p}/**/*.parquet", recursive=True))
    assert size("layout") <= 2 * size("corpus")
    read = whole = 0
    for f in glob.glob(f"{tmp_path}/layout/postings/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            whole += meta.row_group(g).total_byte_size
            read += meta.row_group(g).total_byte_size if stats is not None and stats.min <= "the" <= stats.max else 0
    assert 0 < read < whole

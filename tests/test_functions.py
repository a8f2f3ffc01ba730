"""URL, label and key expressions, including malformed input."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cotopic.functions import (
    article_title, capture_date, capture_month, month_label, month_start, numbered_list,
    original_url, outlet_host, topic_key, url_slug, wrap_label, yyyymm_label,
)
from cotopic.operators import outlet_of
from tests.conftest import U


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("url,title,date,host,orig", [
    (U("20150105", "https://www.alpha.example/2015-01-05-big-story_1?x=1"), "big-story", "2015-01-05",
     "alpha.example", "https://www.alpha.example/2015-01-05-big-story_1?x=1"),
    (U("20150110", "http://www.alpha.example/Big-Story/"), "big-story", "2015-01-10", "alpha.example",
     "http://www.alpha.example/Big-Story/"),
    (U("20150301", "https://beta.example/12345?ref=a"), "12345?ref=a", "2015-03-01", "beta.example",
     "https://beta.example/12345?ref=a"),
    ("https://beta.example/x", "x", None, None, None),  # too short: null parts, no error
    (None, None, None, None, None),
])
def test_url_parts(spark, url, title, date, host, orig):
    assert one(spark, article_title("v"), url) == title
    assert one(spark, capture_date("v"), url) == date
    assert one(spark, outlet_host("v"), url) == host
    assert one(spark, original_url("v"), url) == orig


def test_slug_and_month(spark):
    assert one(spark, url_slug("v"), "a/b/") == "b"
    assert one(spark, url_slug("v"), "") is None
    assert one(spark, capture_month("v"), U("20150402", "https://x.example/y")) == "2015/04"


def test_labels(spark):
    assert one(spark, yyyymm_label("v"), 199812, "v int") == "dezembro de 1998"
    assert one(spark, month_label(month_start("v")), 200003, "v int") == "março de 2000"
    assert one(spark, month_start("v"), 201513, "v int") is None  # invalid month -> null
    assert one(spark, numbered_list(F.col("v")), ["x", "y"], "v array<string>") == "1. x<br>2. y"
    assert one(spark, numbered_list(F.col("v")), None, "v array<string>") == "-"


@pytest.mark.parametrize("kw,label", [
    ("red gear", "red<br>gear"), ("a b c", "a<br>b c"), ("a b c d", "a b<br>c d"), ("solo", "solo"),
])
def test_wrap_label(spark, kw, label):
    assert one(spark, wrap_label("v"), kw) == label


def test_topic_key_matches_sha256(spark):
    for t in ["red gear", "ação", "ONU"]:
        assert one(spark, topic_key("v"), t) == hashlib.sha256(t.encode()).hexdigest()[:10]


@pytest.mark.parametrize("host,outlet", [
    ("expresso.pt", "expresso"), ("sicnoticias.pt", "sicnoticias"), ("dn.pt", "dn"),
    ("furniture.example", "nit"), ("cnn.com", "cnn"), ("example.org", "404"), (None, "404"),
    ("rtp.record.pt", "record"),  # first token of the list wins
])
def test_outlet_first_match(spark, host, outlet):
    assert one(spark, outlet_of("v"), host) == outlet


def test_outlet_table_join_matches_case(spark):
    from cotopic.operators import OUTLETS, match_outlet
    hosts = spark.createDataFrame([(h,) for h in ["expresso.pt", "rtp.record.pt", "x.org", "furniture.example"]],
                                  "host string")
    table = spark.createDataFrame(list(enumerate(OUTLETS)), "position int, token string")
    a = {r.host: r.outlet for r in match_outlet(hosts, "host", table).collect()}
    b = {r.host: r.outlet for r in match_outlet(hosts, "host").collect()}
    assert a == b

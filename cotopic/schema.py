"""Article schema and the default cut-offs of a topic search."""

from __future__ import annotations

from pyspark.sql import types as T

# Article rows as they arrive: month, outlet, archived URL, keyword -> mentions map, tone.
NEWS = T.StructType(
    [
        T.StructField("timestamp", T.IntegerType(), True),  # month as YYYYMM
        T.StructField("source", T.StringType(), True),
        T.StructField("archive", T.StringType(), True),
        T.StructField("id", T.LongType(), True),  # article key, widened from int
        T.StructField("probability", T.FloatType(), True),
        T.StructField("keywords", T.MapType(T.StringType(), T.IntegerType(), True), True),
        T.StructField("sentiment", T.FloatType(), True),
    ]
)

# Adapters may widen the article key; everything downstream only needs these names.
NEWS_COLUMNS = [f.name for f in NEWS.fields]

# The cut-offs of a topic search.
MIN_MENTIONS = 4  # an article is a hit when it mentions the topic strictly more than this
MIN_COUNT = 5  # a related keyword is kept when its summed mentions reach this
TOP_PER_MONTH = 5  # keywords listed per month in the topic history
TOP_NODES = 125  # related keywords drawn as graph nodes
SUGGESTIONS = 5  # keywords suggested when a relation is absent

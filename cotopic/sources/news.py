"""Reading and writing the article corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotopic.operators.topics import corpus_summary
from cotopic.schema import NEWS


def read_news(spark: SparkSession, path: str | list[str], fmt: str = "json", status: str | None = "success",
              mode: str = "PERMISSIVE", base: str | None = None) -> DataFrame:
    """Scan an article directory with the fixed schema (no inference).

    ``path`` is the parent of ``status=<value>`` sub-folders; ``status`` keeps one of them
    through partition pruning (the filter shows as ``PartitionFilters``). ``status=None``
    reads every status and keeps the column. Malformed JSON lines become all-null rows
    under ``PERMISSIVE`` and are still counted, like any other row. ``path`` may also list files below ``base``.
    """
    reader = spark.read.format(fmt)
    if base is not None:
        reader = reader.option("basePath", base)
    if fmt == "json":
        reader = reader.schema(NEWS).option("mode", mode)
    df = reader.load(path)
    extra = []
    if "status" in df.columns:
        if status is not None:
            df = df.where(F.col("status") == F.lit(status))
        else:
            extra = ["status"]
    return df.select(*[F.col(f.name).cast(f.dataType) if fmt != "json" else F.col(f.name) for f in NEWS.fields],
                     *extra)


def read_news_checked(spark: SparkSession, path: str, out: str, status: str | None = "success") -> tuple[DataFrame, DataFrame]:
    """``(articles, rejects)`` of a directory of JSON lines, sorted out in one pass and written once below ``out``.

    A line is rejected when it is no JSON object or a field has another type than the schema's: ``rejects`` has ``file, line``, so every
    line that is not blank is in exactly one of the two. ``path`` and ``status`` as in ``read_news``.
    """
    lines = spark.read.text(path)
    if "status" in lines.columns and status is not None:
        lines = lines.where(F.col("status") == F.lit(status))
    kind = T.StructType([*NEWS.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = (lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("_r"))
            .withColumn("rejected", F.col("_r._bad").isNotNull() | F.col("_r").isNull()))
    (rows.select("rejected", *[F.when(~F.col("rejected"), F.col(f"_r.{f.name}")).alias(f.name) for f in NEWS.fields],
                 *[F.when(F.col("rejected"), F.col(c)).alias(a) for c, a in (("file", "file"), ("value", "line"))])
         .write.partitionBy("rejected").parquet(out))
    stored = spark.read.schema(T.StructType([*NEWS.fields, T.StructField("file", T.StringType()), T.StructField("line", T.StringType()),
                                             T.StructField("rejected", T.BooleanType())])).parquet(out)
    return (stored.where("NOT rejected").select(*[f.name for f in NEWS.fields]), stored.where("rejected").select("file", "line"))


def summary_from_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``corpus_summary`` of a Parquet corpus from its files' statistics: count and extremes are pushed into the reader and no row
    is read. The settings it takes are those of a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return corpus_summary(own.read.schema(NEWS).parquet(path))


def write_news(news: DataFrame, path: str, status: str = "success", fmt: str = "json",
               mode: str = "append") -> None:
    """Write articles below ``path/status=<status>/``."""
    (news.withColumn("status", F.lit(status))
         .write.mode(mode).partitionBy("status").format(fmt).save(path))


def materialize(news: DataFrame, path: str) -> DataFrame:
    """Write a derived corpus once as Parquet and return the scan of it (cuts lineage)."""
    news.write.mode("overwrite").parquet(path)
    return news.sparkSession.read.parquet(path)


# Nested relation record as written by ``write_relations_json`` (one JSON object per line).
NESTED = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("sentiment", T.DoubleType()),
    T.StructField("date", T.MapType(T.StringType(), T.LongType())),
    T.StructField("source", T.MapType(T.StringType(), T.LongType())),
    T.StructField("date_unknown", T.LongType()),
    T.StructField("source_unknown", T.LongType()),
])


def write_relations_json(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON sink of ``relations_nested`` rows: ``{topic, keyword, count, sentiment, date:{..}, source:{..}}``."""
    nested.select(*[f.name for f in NESTED.fields]).write.mode(mode).json(path)


def read_relations_json(spark: SparkSession, path: str) -> DataFrame:
    """Read nested relation records back with the fixed schema (no inference)."""
    return spark.read.schema(NESTED).json(path)

"""A training corpus from ``documents``: language, lines, near copies, mixture, packed sequences.

Each stage takes all that its predecessor kept, as ``(spark, docs, sf_dir)``, and returns a DataFrame; ``run`` writes each one's rows as
Parquet to the shared folder and gives them, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.llm import langid, linedup, mixing, packing, simhash
from cotopic.llm.common import table, written
from cotopic.session import scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_REPEATS = 1.25  # a pass and a quarter of the rarest source for one of the commonest


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go, and no others where no language could be learned."""
    model = langid.learn(docs, langid.held_in())
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated line in its first document only; documents that lose all their text go."""
    out = linedup.drop_repeated_lines(docs)
    left = F.col("n_dropped") < F.col("n_lines")
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id, ids before none; of texts that share that id, or have
    none, the one of least hash. Rows equal in id and text are one document and stay together."""
    classes = simhash.near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = classes.groupBy("root", F.col("doc_id").alias("_id")).agg(F.min("row").alias("_row")).select("_id", "_row")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (simhash.text_hash(F.col("text")) == F.col("_row"))
    return docs.join(stay.hint("merge"), same).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights; every document at least once."""
    return mixing.mix(docs, max_repeats=MIX_REPEATS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in the training sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]

#: SQL can express neither the language mixture nor SimHash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last stage's rows stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    with scratch_scope(spark) as stages:
        for name, stage in STAGES:
            with scratch_scope(spark) as inside:
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
                inside.keep(f"pipeline-{name}")
        stages.keep(f"pipeline-{STAGES[-1][0]}")
    return docs

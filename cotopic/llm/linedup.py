"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches of ascending id. The runs hold, sorted by hash, every key seen so far with the
document that has it first. A new batch is merge-joined with the runs: keys found there belong to an earlier document and lose
their lines; the rest (an anti-join) is added as a run of its own. When a level holds ``FANOUT`` runs
they are merged into one run of the next level, so a batch meets few runs, whatever came before.

Runs are tables bucketed and sorted by hash in the warehouse: a join reads them without a shuffle, and only
the slim rows of the new batch (two longs of hash, the id) are dealt. Keys are 128-bit hashes. A key
that a third of all documents have is one row per document in the batch's rows and one row in a run; a task
scanning documents sends a key once per document, and the first owner is found by a partial minimum.
Texts are shuffled once, by id, to lose their lines.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from cotopic.llm.common import BLOCK_ROWS, giving_back, per_block, table, written

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3

_KEYS = pa.schema([("row", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def line_keys(text: str, min_chars: int):
    """128-bit hashes of the keys of a text's lines; None where a line has no key or too short a one."""
    import xxhash

    out = []
    for line in text.split("\n"):
        key = line.encode().strip().lower()  # on bytes: exactly space, \t-\r and A-Z
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


class Runs:
    """The levels of sorted runs; each run a table ``h1, h2, owner`` bucketed by hash."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _store(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        (rows.repartition(self.buckets, "h1").sortWithinPartitions("h1", "h2")
             .write.bucketBy(self.buckets, "h1").sortBy("h1").option("compression", "zstd").saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, rows: DataFrame) -> DataFrame:
        """A new run of keys that no run holds; compacts full levels. Returns the run."""
        name = self._store(rows)
        run = self.spark.table(name)
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return run
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for n in old[1:]:
                merged = merged.unionByName(self.spark.table(n))
            name = self._store(merged)
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for k in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``row, h1, h2``: the keys whose lines a document loses. ``docs``: ``row`` (long id), ``text``."""
    spark = docs.sparkSession

    def block(ids, texts):
        row, digests = [], []
        for (i,), t in zip(ids, texts):
            found = {k for k in line_keys(t, min_chars) if k is not None}
            digests += sorted(found)
            row += [i] * len(found)
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return {"row": row, "h1": h[:, 0], "h2": h[:, 1]}

    keys = written(docs.select("row", "text").mapInArrow(per_block(block, _KEYS, "row"), "row long, h1 long, h2 long"), "line-keys")
    # batch borders: quantiles of the ids, a handful of numbers
    cuts = sorted(set(keys.approxQuantile("row", [k / batches for k in range(1, batches)], 0.01)))
    cuts = [None, *[int(c) for c in cuts], None]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = Runs(spark, buckets, fanout)
    try:
        return written(_lost(keys, cuts, runs), "line-lost")
    finally:
        runs.drop()


def _lost(keys: DataFrame, cuts: list, runs: Runs) -> DataFrame:
    """``row, h1, h2`` from batches of ``keys`` between the borders; ``runs`` grow by each."""
    lost = []
    for lo, hi in zip(cuts, cuts[1:]):
        batch = keys
        if lo is not None:
            batch = batch.where(F.col("row") >= lo)
        if hi is not None:
            batch = batch.where(F.col("row") < hi)
        # the batch's own first owners, one row a key; earlier runs take theirs out
        own = batch.groupBy("h1", "h2").agg(F.min("row").alias("owner"), F.count(F.lit(1)).alias("n"))
        if lo is not None:
            earlier = runs.runs()
            own = written(own, "line-batch")
            fresh = own
            for run in earlier:
                fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
            for run in earlier:
                seen = own.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_semi").select("h1", "h2")
                lost.append(batch.join(seen, ["h1", "h2"], "left_semi").select("row", "h1", "h2"))
        else:
            fresh = own
        run = runs.add(fresh.select("h1", "h2", "owner", "n"))
        # inside the batch: every document but the owner
        again = run.where("n > 1").select("h1", "h2", "owner")
        lost.append(batch.join(again, ["h1", "h2"]).where("row <> owner").select("row", "h1", "h2"))
    out = lost[0]
    for x in lost[1:]:
        out = out.unionByName(x)
    return out


def _digests(lost: pa.ListArray):
    """The lines a row loses as a set of digests, row by row; no object is made of a hash but its 16 bytes."""
    flat = lost.flatten()
    data = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1)], axis=1).tobytes()
    at = 0
    for n in pc.fill_null(pc.list_value_length(lost), 0).to_pylist():
        yield {data[k:k + 16] for k in range(16 * at, 16 * (at + n), 16)}
        at += n


def _stay(text: str | None, gone: set[bytes], min_chars: int):
    """``kept, n_lines, n_dropped`` of a text."""
    lines = (text or "").split("\n")
    if not gone:
        return {"kept": text, "n_lines": len(lines), "n_dropped": 0}
    stay = [x for x, k in zip(lines, line_keys(text, min_chars)) if k is None or k not in gone]
    return {"kept": "\n".join(stay), "n_lines": len(lines), "n_dropped": len(lines) - len(stay)}


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        batches: int = BATCHES) -> DataFrame:
    """``docs`` with the text reduced to the lines that stay, and ``n_lines``, ``n_dropped`` beside it.

    A line's key is the line without blanks at its ends, A-Z in lower case; a key of ``min_chars`` code points or more
    that several documents have stays in the one of smallest id, there with all its lines. Null or empty text is one
    empty line, and stays null or empty. Rows that share an id count as one document; rows without an id keep their lines and
    own no key. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.col(text_col).cast("string")
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row"), text.alias("text"))
    lost = (repeated_lines(slim, min_chars, batches).groupBy(F.col("row").alias("_row"))
            .agg(F.collect_set(F.struct("h1", "h2")).alias("_lost")))
    joined = docs.join(lost.hint("merge"), F.col(id_col).cast("long") == F.col("_row"), "left")

    kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def keep(batches):
        for text, lost in batches:
            done = [pa.array([], kind)]
            for a in range(0, len(text), BLOCK_ROWS):  # a few texts and their hashes at once become Python values
                done.append(pa.array([_stay(t, gone, min_chars) for t, gone in zip(text.slice(a, BLOCK_ROWS).to_pylist(),
                                                                                  _digests(lost.slice(a, BLOCK_ROWS)))], kind))
            yield pa.concat_arrays(done)

    udf = F.arrow_udf(giving_back(keep), "kept string, n_lines long, n_dropped long", ArrowUDFType.SCALAR_ITER)
    out = joined.withColumn("_k", udf(text, F.col("_lost")))
    return out.select(*[F.col("_k.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                      "_k.n_lines", "_k.n_dropped")


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """Contract query: lines dropped from every document, and the hash of what stays."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, line, i, lower_ascii AS key, length(lower_ascii) >= 10 AS long_enough
  FROM (SELECT doc_id, line, i,
               translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
owner AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE long_enough GROUP BY key),
k AS (SELECT l.doc_id, l.line, l.i, long_enough AND first_doc <> l.doc_id AS gone
      FROM l LEFT JOIN owner ON l.long_enough AND l.key = owner.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(coalesce(gone, FALSE)::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, FALSE)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

"""Exact top-k search by inner product with a vector-approximation file.

Components are scaled integers. Each is quantised to one of ``CELLS`` cells between its dimension's least and largest value; the file holds
a byte per component beside the exact vectors, in columns of their own, so a scan of cells reads no vectors.

For a block of queries, (1) a scan of the cells bounds every score from below and above, and the k-th largest lower bound
of all, merged from each task's best, is a floor that no result is under; (2) a second scan keeps the
vectors whose upper bound reaches the floor; (3) their exact vectors are read in the order of the bounds: first each query's ``FIRST`` best,
whose k-th exact score is a new floor, then those whose bound still reaches it. What remains cannot
be among the results, so they are certain.

Equal vectors are stored once, with the ``k + 1`` smallest of their ids: more of them can never be among a query's first k. Queries are
a stated set, handled in blocks of ``QUERY_BLOCK``; a block's vectors, floors and survivors go with the tasks, and are of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotopic.llm.common import table, written

CELLS = 256
QUERY_BLOCK = 1024
FIRST = 4  # times k: exact vectors of a query read first
ROWS = 4096  # vectors bounded at once in a task


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: each vector once with its ``k + 1`` smallest ids in order."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)  # cut before the shuffle, too
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _padded(lists, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return flat[offsets[0]:offsets[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def build(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The file ``vid, cells, v, ids`` (written), and each dimension's least value and cell width."""
    vectors = written(distinct_vectors(rows, k), "va-vectors")

    def extremes(batches):
        low = high = np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("v")
            if not len(lists):
                continue
            width = max(len(low), int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
            if width == 0:
                continue
            m = _padded(lists, width)
            grow = width - len(low)
            # a dimension that some vector lacks counts as zero there
            low, high = np.append(low, np.zeros(grow, np.int64)), np.append(high, np.zeros(grow, np.int64))
            low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        yield pa.RecordBatch.from_pydict({"d": np.arange(len(low)), "low": low, "high": high})

    ends = (vectors.select("v").mapInArrow(extremes, "d long, low long, high long")
                   .groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toArrow())
    low = ends.column("low").to_numpy().astype(np.int64)
    width = np.maximum(1, -(-(ends.column("high").to_numpy().astype(np.int64) - low + 1) // CELLS))
    dims = len(low)

    def quantise(batches):
        for batch in batches:
            if batch.num_rows:
                m = _padded(batch.column("v"), dims) if dims else np.zeros((batch.num_rows, 0), np.int64)
                cells = ((m - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in batch.column("ids").to_pylist()], pa.int64()),
                                                  pa.array([r.tobytes() for r in cells], pa.binary()), batch.column("v"), batch.column("ids")],
                                                 names=["vid", "cells", "v", "ids"])

    return written(vectors.select("v", "ids").mapInArrow(quantise, "vid long, cells binary, v array<long>, ids array<long>"), "va-file"), low, width


def _bounds(cells, queries: np.ndarray, low: np.ndarray, width: np.ndarray):
    """Least and largest possible score of each vector (rows) with each query (columns)."""
    c = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), len(low)).astype(np.float64)
    a = c * width + low
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    floor_ = a @ up + (a + (width - 1)) @ down
    slack = ((width - 1).astype(np.float64) * np.abs(queries)).sum(axis=1)
    err = 1e-9 * (np.abs(floor_) + slack) + 1
    return floor_ - err, floor_ + slack + err


def _best_floors(queries, low, width, k):
    """mapInArrow over cells: each task's ``k`` largest lower bounds of each query."""
    def run(batches):
        best = np.full((len(queries), 0), 0.0)
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            n_ids = batch.column("n").to_numpy()
            for a in range(0, len(cells), ROWS):
                lower, _ = _bounds(cells[a:a + ROWS], queries, low, width)
                lower = np.repeat(lower, n_ids[a:a + ROWS], axis=0)
                best = np.concatenate((best, lower.T), axis=1)
                if best.shape[1] > k:
                    best = -np.partition(-best, k - 1, axis=1)[:, :k]
        q = np.repeat(np.arange(len(queries)), best.shape[1])
        yield pa.RecordBatch.from_pydict({"q": q, "bound": best.ravel()})
    return run


def _survivors(queries, low, width, floors):
    """mapInArrow over cells: ``q, vid, bound`` of the vectors whose upper bound reaches the floor."""
    def run(batches):
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            vid = batch.column("vid").to_numpy()
            for a in range(0, len(cells), ROWS):
                _, upper = _bounds(cells[a:a + ROWS], queries, low, width)
                i, q = np.nonzero(upper >= floors[None, :])
                yield pa.RecordBatch.from_pydict({"q": q.astype(np.int64), "vid": vid[a:a + ROWS][i], "bound": upper[i, q]})
    return run


def _exact(queries):
    """mapInArrow: the exact score of each candidate with its vector."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _padded(batch.column("v"), queries.shape[1])
                q = batch.column("q").to_numpy()
                score = np.concatenate([np.einsum("ij,ij->i", v[a:a + ROWS], queries[q[a:a + ROWS]]) for a in range(0, len(q), ROWS)])
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("vid"), batch.column("ids"), pa.array(score, pa.int64())],
                                                 names=["q", "vid", "ids", "score"])
    return run


def top_k(file: DataFrame, low: np.ndarray, width: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` for one block of queries (rows of ``queries``)."""
    cells = file.select("vid", "cells", F.size("ids").alias("n"))
    need = k + 1  # a query may meet itself
    floors = np.full(len(queries), -np.inf)
    top = Window.partitionBy("q").orderBy(F.desc("bound"))
    kth = (cells.mapInArrow(_best_floors(queries, low, width, need), "q long, bound double")
                .withColumn("r", F.row_number().over(top)).where(F.col("r") == need).select("q", "bound").toArrow())
    floors[kth.column("q").to_numpy()] = kth.column("bound").to_numpy()
    near = written(cells.mapInArrow(_survivors(queries, low, width, floors), "q long, vid long, bound double"), "va-near")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "vid"))).where(F.col("r") <= FIRST * need)
    vectors = file.select("vid", "v", "ids")

    def scores(candidates):
        return candidates.select("q", "vid").join(vectors, "vid").select("q", "vid", "ids", "v").mapInArrow(
            _exact(queries), "q long, vid long, ids array<long>, score long")

    read = written(scores(first), "va-first")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    certain = np.full(len(queries), -np.inf)
    each = read.select("q", "score", F.explode("ids").alias("id"))
    kth = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") == need).select("q", "score").toArrow()
    certain[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
    sure = near.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(certain)], "q long, least double")
    rest = (near.join(F.broadcast(sure), "q").where("bound >= least")  # one row a query of the block
                .join(first.select("q", "vid"), ["q", "vid"], "left_anti"))
    both = read.unionByName(scores(rest)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= need)
    names = near.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(query_ids)], "q long, query_id long")
    ids = (both.join(F.broadcast(names), "q").select("query_id", "score", F.explode("ids").alias("vec_id"))
               .where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query row with the other rows.

    Components become ``floor(scale * x)``. Rows with a null id, a null vector, or a null or non-finite component take no part; a shorter vector counts
    as ending in zeros; ties go to the smaller id. An id is expected once: of repeated rows with one vector each counts,
    and a query leaves out every row of its own id. Scores are exact below 2**63. No rows, no result.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), is_query.alias("is_query"))
    spark = vectors.sparkSession
    file, low, width = build(rows.select("vec_id", "v"), k)
    queries = written(rows.where("is_query").select("vec_id", "v"), "va-queries")
    total = queries.count()
    blocks = -(-total // query_block)
    out = None
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    for b in range(blocks):
        part = dealt.where(F.col("block") == b).orderBy("vec_id").toArrow()  # about query_block rows
        if not part.num_rows:
            continue
        one = top_k(file, low, width, part.column("vec_id").to_numpy(),
                    _padded(part.column("v").combine_chunks(), len(low)), k)
        one = written(one, "va-top") if blocks > 1 else one
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def op2_top_k(spark, sf_dir) -> DataFrame:
    """Contract query: the ten best of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

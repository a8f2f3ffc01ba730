"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The
exponent is bisected to the target: the largest one whose weights reach an entropy, or the smallest one that
repeats no source more than a limit. With a budget of tokens the weights become token budgets. Without one the
budget is the least that gives every source all its documents once, so nothing is lost.

A budget is met by block permutations: in every pass over a source its documents are ordered by a keyed hash, whose first digits name
a block. Whole passes take every document; the last, partial pass takes whole blocks in order while they fit, and
documents in order from the block that the budget ends in. Only token sums of blocks are windowed per source
(``BLOCKS`` rows at most), and the documents of one block; so a source with a third of all rows is no hot group.

There may be as many sources as documents: their sums, weights and budgets stay tables, of which only totals are collected, and are joined
to the documents by a broadcast if Spark measures them as small, or else by a sort-merge join whose hot sources it can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotopic.llm.common import table, written

MAX_REPEATS = 2.0
SEED = 7
BLOCK_DIGITS = 3  # hex digits: 4096 blocks a source
BISECTIONS = 60
EXPONENTS = 32  # exponents tried in one pass over a table of sources


def n_words(text) -> Column:
    """Words (runs outside space and \\t-\\r) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Normalised powers of the shares."""
    total = sum(tokens)
    powers = [(t / total) ** exponent for t in tokens]
    return [p / sum(powers) for p in powers]


def entropy(ws: list[float]) -> float:
    return -sum(w * math.log(w) for w in ws if w > 0)


def repeats(tokens: list[float], ws: list[float]) -> float:
    """How often the most repeated source is read while the least repeated one is read once."""
    per = [w / t for w, t in zip(ws, tokens)]
    return max(per) / min(per)


def find_exponent(tokens: list[float], target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent by bisection, rounded up to six digits; entropy falls and repeats fall as it grows."""
    def ok(a):  # holds from some exponent on (repeats) or up to it (entropy)
        ws = weights(tokens, a)
        return entropy(ws) >= target_entropy if target_entropy is not None else repeats(tokens, ws) <= max_repeats

    lo, hi = 0.0, 1.0
    if target_entropy is not None:
        if ok(1.0):
            return 1.0
        for _ in range(BISECTIONS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return math.floor(lo * 1e6) / 1e6
    if ok(0.0):
        return 0.0
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return min(1.0, math.ceil(hi * 1e6) / 1e6)


def entropy_exponent(sources: DataFrame, total: int, target_entropy: float) -> float:
    """``find_exponent`` to an entropy, in millionths, over a table of sources with tokens ``_t > 0`` that sum to ``total``: each
    pass finds the entropies at ``EXPONENTS`` exponents, so the interval shrinks to a part of that number."""
    share = F.col("_t") / F.lit(float(total))

    def entropies(marks):
        at = sources.select(F.explode(F.array(*[F.lit(m) for m in marks])).alias("m"), share.alias("p"))
        at = at.withColumn("w", F.pow("p", F.col("m") / 1e6))
        sums = at.groupBy("m").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("l")).collect()
        return {r["m"]: math.log(r["z"]) - r["m"] / 1e6 * r["l"] / r["z"] for r in sums}

    lo, hi = 0, 1_000_000
    if entropies([hi])[hi] >= target_entropy:
        return 1.0
    while hi - lo > 1:
        marks = sorted({lo + (hi - lo) * i // (EXPONENTS + 1) for i in range(1, EXPONENTS + 1)} - {lo}) or [lo + 1]
        found = entropies(marks)
        short = [m for m in marks if found[m] < target_entropy]
        hi = min([hi, *short])
        lo = max([lo, *(m for m in marks if m < hi)])
    return lo / 1e6


def _plan(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> DataFrame:
    """``_s, weight, _passes, _rest`` of sources ``_s, _t``: the weight, whole passes, and tokens of the last one."""
    some = sources.where("_t > 0")
    span = some.agg(F.sum("_t").alias("total"), F.min("_t").alias("least"), F.max("_t").alias("most")).first()
    if span["total"] is None:
        return sources.selectExpr("_s", "0D AS weight", "1L AS _passes", "0L AS _rest")
    # the most repeated source is the least one, the least repeated the largest; no other one matters to the limit
    exponent = (find_exponent([span["least"], span["most"]], None, max_repeats) if target_entropy is None
                else entropy_exponent(some, span["total"], target_entropy))
    power = F.pow(F.col("_t") / F.lit(float(span["total"])), F.lit(exponent))
    norm = some.agg(F.sum(power)).first()[0]
    # a budget that reads the least repeated source exactly once
    total = float(budget) if budget is not None else span["most"] * norm / (span["most"] / span["total"]) ** exponent
    b = F.floor(F.col("weight") * F.lit(total) + 0.5)
    plan = sources.withColumn("weight", F.when(F.col("_t") > 0, power / F.lit(norm)).otherwise(0.0))
    plan = plan.withColumn("_b", b if budget is not None else F.greatest("_t", b))
    return plan.selectExpr("_s", "weight", "CASE WHEN _t > 0 THEN _b div nullif(_t, 0) ELSE 1L END AS _passes",
                           "CASE WHEN _t > 0 THEN _b % nullif(_t, 0) ELSE 0L END AS _rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None,
        seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_tokens``, ``copy`` (from 0) and ``weight`` (of its source): one row per document and pass.

    A null source is a source of its own. Documents without tokens come once per whole pass, at least once. Sources of no tokens at all
    have weight 0 and come once. With a ``budget`` a source may come less than once; its last pass ends with the document that reaches
    the budget. Ties in the hash order go by id. Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("n_tokens", "copy", "weight")
    docs = docs.withColumn("n_tokens", n_words(F.col(text_col).cast("string")))
    sources = written(docs.groupBy(F.col(source_col).alias("_s")).agg(F.sum("n_tokens").alias("_t")), "mixing-sources")
    plan = _plan(sources, target_entropy, max_repeats, budget)

    def planned(plan):
        out = docs.join(plan, F.col(f"`{source_col}`").eqNullSafe(F.col("_s")))
        hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_passes").cast("string"), F.col(f"`{id_col}`").cast("string")))
        return out.withColumn("_h", hashed).withColumn("_block", F.substring("_h", 1, BLOCK_DIGITS))

    # the block each source's last pass ends in, and the tokens before it: one row a source
    sums = planned(plan).where("_rest > 0").groupBy("_s", "_rest", "_block").agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_block"))
    cuts = (sums.withColumn("_to", upto).where("_to > _rest").groupBy(F.col("_s").alias("_cs"))
                .agg(F.min(F.struct("_block", (F.col("_to") - F.col("_n")).alias("before"))).alias("c"))
                .selectExpr("_cs", "c._block AS _cut", "c.before AS _before"))
    plan = plan.join(cuts, F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    out = planned(written(plan, "mixing-plan"))
    cols = [*[f"`{c}`" for c in docs.columns if c != "n_tokens"], "n_tokens", "copy", "weight"]
    passes = F.col("_passes") + F.when(F.col("_block") < F.col("_cut"), 1).otherwise(0)
    whole = out.where(passes > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    # the documents of the cut blocks in order, until the budget is reached
    order = Window.partitionBy("_s").orderBy("_h", F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")))
    run = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = out.where("_block = _cut").withColumn("_run", F.col("_before") + run).where("_run < _rest")
    return whole.selectExpr(*cols).unionByName(last.withColumn("copy", F.col("_passes")).selectExpr(*cols))


def op8_mixing(spark, sf_dir) -> DataFrame:
    """Every document with its passes, at most two for one of the least repeated source's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "source", "copy", "n_tokens", F.round("weight", 9).alias("weight"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM d GROUP BY source HAVING sum(n_tokens) > 0),
span AS (SELECT max(t)::DOUBLE / min(t) AS spread FROM s),
-- repeats at exponent a are spread ** (1 - a): the bisection's limit in closed form
e AS (SELECT CASE WHEN spread <= 2 THEN 0.0 ELSE least(1.0, ceil((1 - ln(2.0) / ln(spread)) * 1e6) / 1e6) END AS a FROM span),
p AS (SELECT source, t, (t::DOUBLE / (SELECT sum(t) FROM s)) ** (SELECT a FROM e) AS p FROM s),
w AS (SELECT source, t, p / (SELECT sum(p) FROM p) AS weight FROM p),
b AS (SELECT source, t, weight, greatest(t, floor(weight * (SELECT max(t / weight) FROM w) + 0.5)::BIGINT) AS budget FROM w),
plan AS (
  SELECT source, weight, budget // t AS passes, budget % t AS rest FROM b
  UNION ALL SELECT source, 0.0, 1, 0 FROM d GROUP BY source HAVING sum(n_tokens) = 0),
full_pass AS (
  SELECT doc_id, d.source, unnest(range(passes)) AS copy, n_tokens, weight
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
ordered AS (
  SELECT doc_id, d.source, passes AS copy, n_tokens, weight, rest,
         sum(n_tokens) OVER (PARTITION BY d.source ORDER BY md5('7|' || passes || '|' || doc_id), doc_id) - n_tokens AS before
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source WHERE rest > 0)
SELECT doc_id, source, copy::BIGINT AS copy, n_tokens, round(weight, 9) AS weight FROM full_pass
UNION ALL SELECT doc_id, source, copy::BIGINT, n_tokens, round(weight, 9) FROM ordered WHERE before < rest
"""

"""Host-level quality rules, in DataFrame functions only.

Each document is measured by a few rules inside its row. A host's failure rate is shrunk towards the corpus: its
documents are Bernoulli draws with a rate from a beta prior, whose parameters are fitted to the hosts' rates
by moments; the posterior mean ``(failed + a) / (documents + a + b)`` is the host's rate, so a host of few documents is
not condemned by them. A host at ``MAX_RATE`` or more is rejected with all its documents.

One scan measures; hosts are summed with partial aggregates (a hot host is one row per task) and joined back on the
host by a broadcast that Spark chooses by measured size, or else by a sort-merge join that it can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import table, written

# The rules of the base measure.
SEPARATORS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
MAX_RATE = 0.9


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound once to ``value``, so that it is not computed again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text (never null)."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(ws: Column, width: int = REPEAT_WINDOW) -> Column:
    """How many words stand in a window of ``width`` words that the text has twice or more.

    Windows are known by a 64-bit hash; sorted with their places, those with an equal neighbour are repeated, and
    their places in order cover ``min(width, distance to the next)`` words each.
    """
    def places(h):
        sorted_ = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(sorted_, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"])),
            lambda x: x["i"])))

    def cover(p):
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(width)), F.lit(width))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(w):
        last = F.size(w) - width + 1
        hashes = F.transform(F.slice(w, 1, F.greatest(last, F.lit(0))),
                             lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .otherwise(let(places(h), cover)))
    return F.when(F.size(ws) < width + 1, F.lit(0).cast("long")).otherwise(let(ws, windows))


def measures(text: Column) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; null has none of anything."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    with_word = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SEPARATORS, "") != "")
    return [
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures and ``base_failed`` (columns of these names are replaced)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_w"]
    keep = [c for c in docs.columns if c not in names]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], *measures(F.col(f"`{text_col}`")))
    out = out.select(*[F.col(f"`{c}`") for c in keep], "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_rates(docs: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``host, documents, failed, rate, rejected`` from measured documents; a null host is a host.

    The prior's mean is the corpus's rate; its weight comes from the variance of the hosts' rates, weighted by documents, beyond
    what drawing alone gives. Where the hosts vary no more than that the prior is as heavy as the corpus.
    """
    hosts = docs.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, x = F.col("documents").cast("double"), F.col("failed").cast("double")
    corpus = hosts.agg(F.sum("documents").alias("_n"), F.sum("failed").alias("_x"), F.count(F.lit(1)).alias("_hosts"),
                       F.sum(x * x / n).alias("_xx"))  # one row
    mean = F.col("_x") / F.col("_n")
    drawn = mean * (1 - mean)
    spread = F.col("_xx") / F.col("_n") - mean * mean  # weighted variance of the hosts' rates
    by_chance = drawn * F.col("_hosts") / F.col("_n")
    between = F.least(spread - by_chance, drawn)
    weight = F.when(between > 0, F.greatest(drawn / between - 1, F.lit(0.0))).otherwise(F.col("_n").cast("double"))
    prior = corpus.select(mean.alias("mean"), weight.alias("weight")).first()  # two numbers
    a, both = (prior["mean"] or 0.0) * (prior["weight"] or 0.0), prior["weight"] or 0.0
    rate = (F.col("failed") + F.lit(a)) / (F.col("documents") + F.lit(both))
    return hosts.select("host", "documents", "failed", rate.alias("rate"), (rate >= max_rate).alias("rejected"))


def apply_host_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The columns of ``docs`` but the text, the measures, ``base_failed``, ``host_rate`` and ``kept``: the base rules passed and
    the host not rejected.

    The measures, without texts, are written once and used twice. Rows are measured one by one, so ties and repeated rows are all
    kept; an empty table gives no rows. Columns of ``docs`` with the new names are replaced.
    """
    docs = written(measured(docs.drop("host_rate", "kept"), text_col).drop(text_col), "host-measures")
    hosts = host_rates(docs, host_col, max_rate).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"),
                                                    F.col("rejected").alias("_rejected"))
    out = docs.join(hosts, F.col(f"`{host_col}`").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("_rejected")).drop("_host", "_rejected")


def op4_host_rules(spark, sf_dir) -> DataFrame:
    """Contract query: measures and verdict of every document; the host is its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apply_host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, list_value(word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS g, lead(word, 2) OVER o IS NOT NULL AS whole
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g WHERE whole),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) WHERE twice GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY source),
c AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) AS sq, count(*) / sum(n) AS hosts_per_doc, sum(n) AS total FROM h),
v AS (SELECT mean, mean * (1 - mean) AS drawn, total,
             least(sq - mean * mean - mean * (1 - mean) * hosts_per_doc, mean * (1 - mean)) AS between_hosts FROM c),
r AS (SELECT source, (x + mean * weight) / (n + weight) >= 0.9 AS rejected
      FROM h, (SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(drawn / between_hosts - 1, 0.0) ELSE total END AS weight FROM v))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

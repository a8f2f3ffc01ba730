"""Spelling variants through a variable-length gram index.

Words are the letter runs of a corpus; two are near when they differ by one inserted, deleted or replaced code point, and a rare
word's form is its commonest near word.

Dictionary: grams of 2 to ``QMAX`` code points are counted over the distinct words (with a mark at both ends). A gram is extended
while it is frequent, so the dictionary's leaves are rare; only the frequent inner grams are needed to cut a word, and a threshold that
grows with the corpus keeps them below ``GRAMS`` a length. They are the only data broadcast.

Decomposition: at each place of a word stands its shortest gram that is not frequent (or is ``QMAX`` long, or reaches the end mark).
Which gram that is depends on no character outside it, so an edit affects exactly the grams that cover it: all others are in the other
word too, moved by one place at most. (Grams inside a longer neighbour are kept: leaving them out would make an edit act at a distance.)

Merging: a set of grams of which any one edit affects fewer than all (the set's size less its affected-gram bound is 1 or more)
meets every near word in one of its inverted lists. Two grams that do not overlap are such a set; each word takes the rarest two, and one
exists because ``QMAX + 2`` is at most a padded word's length. Lists are keyed by gram, place and word length, and the two short lists are
read for words of the same length or one more; the shorter word of a pair thus finds the longer. Each candidate is verified.

At scale: words carry their counts through one equality join. A list with more than ``MAX_LIST`` words is not read against all its
readers: both sides are dealt again by their one-deletion variants, which near words share, so no list costs its square. A form has
at least ``ratio`` times the word's occurrences, so chains of forms are logarithmic and pointers are doubled a known number of times.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import BLOCK_ROWS, giving_back, table, written

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
NOISE = 199  # one run in about so many loses a code point
QMIN, QMAX = 2, 5
GRAMS = 50_000  # frequent grams of one length, at most
MIN_LIST = 64  # a gram in no more words is never extended
MAX_LIST = 2048
RUN = r"[A-Za-zÀ-ÿ]+"
TEXT_PART = 1 << 20  # code points of a text searched at once
HELD = 200_000  # words counted in a task before they are sent on


def _counter(min_chars: int, noise: int):
    """``(doc_id, text)`` batches to ``(word, n)``: occurrences, summed over many documents of a task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    upper = {c: c + 32 for c in range(65, 91)}

    def parts(text: str, run, other):
        a = 0
        while a < len(text):
            b = min(len(text), a + TEXT_PART)
            if b < len(text):
                cut = other.search(text, b)
                b = cut.start() if cut else len(text)
            yield run.findall(text, a, b)
            a = b

    def count(batches):
        run, other = re.compile(RUN), re.compile(RUN.replace("[", "[^").rstrip("+"))
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)
            held.clear()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(a, BLOCK_ROWS)
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    if not text:
                        continue
                    found: Counter = Counter()
                    for p in parts(text, run, other):
                        found.update(p)
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w, n in found.items():
                        if len(w) < min_chars:
                            continue  # a deletion makes it shorter still
                        w = w.lower() if w.isascii() else w.translate(upper)
                        h = zlib.crc32(w.encode(), start)
                        if not h % noise:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                            if len(w) < min_chars:
                                continue
                        held[w] += n
                    if len(held) > HELD:
                        yield rows()
        if held:
            yield rows()
    return giving_back(count)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``word, n``: words of at least ``min_chars`` code points that occur ``min_count`` times or more in all whole texts.

    A word is a maximal run of Latin letters with A-Z in lower case; where ``noise`` divides the crc32 of ``<id>:<run>`` the run loses
    one code point. Null or empty text has no words; a null id is written as nothing before the colon.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = slim.mapInArrow(_counter(min_chars, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, grams: int = GRAMS, min_list: int = MIN_LIST) -> dict[str, int]:
    """The grams to be extended and their numbers of places: those in more than ``min_list`` places, and in more than one in ``grams`` of
    all places, so at most ``grams`` a length reach the driver whatever the number of words."""
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(min_list, -(-places // grams))

    def of_size(q: int):
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))

    per_word = [of_size(q) for q in range(qmin, qmax)]
    found = (words.select(F.explode(F.concat(*per_word)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > least))
    return {r["gram"]: r["n"] for r in found.collect()}


def decompose(word: str, frequent, qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[int, str]]:
    """(place, gram) of every place of the padded word; a gram is as long as it takes to be in no frequent inner node."""
    s = f"^{word}$"
    out = []
    for p in range(len(s) - qmin + 1):
        e = p + qmin
        while e < len(s) and e - p < qmax and s[p:e] in frequent:
            e += 1
        out.append((p, s[p:e]))
    return out


def affected(grams: list[tuple[int, str]]) -> int:
    """The affected-gram bound: how many of these grams one edit can change at most (an edit changes those that cover its place)."""
    cover: Counter = Counter()
    for p, g in grams:
        cover.update(range(p, p + len(g)))
    return max(cover.values(), default=0)


def merged_lists(grams: list[tuple[int, str]], frequent) -> list[tuple[int, str]]:
    """The two rarest grams of which an edit leaves one: size 2, affected-gram bound 1."""
    cost = [(frequent.get(g, 0), p, g) for p, g in grams]
    best, least = None, math.inf
    # the cheapest gram that ends at or before each place, then one that starts there or after
    for c, p, g in cost:
        for c2, p2, g2 in cost:
            if p2 >= p + len(g) and max(c, c2) * 4 + c + c2 < least:
                best, least = [(p, g), (p2, g2)], max(c, c2) * 4 + c + c2
    if best is None:
        raise ValueError("a word too short for two grams: lower qmax, or raise min_chars")
    return best


def _postings(frequent, qmin: int, qmax: int):
    """``word, n`` batches to rows of the inverted lists (``reads`` false) and their readers (``reads`` true)."""
    schema = pa.schema([("gram", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("reads", pa.bool_()),
                        ("word", pa.string()), ("n", pa.int64())])
    types = [f.type for f in schema]

    def rows(batches):
        inner = frequent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                out = []
                for w, n in zip(some.column("word").to_pylist(), some.column("n").to_pylist()):
                    grams = decompose(w, inner, qmin, qmax)
                    size = len(w)
                    out += [(g, p, size, False, w, n) for p, g in grams]
                    for p, g in merged_lists(grams, inner):
                        out += [(g, p, size, True, w, n), (g, p, size + 1, True, w, n), (g, p + 1, size + 1, True, w, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)
    return giving_back(rows)


def _variants(word: str):
    """The word and every word one deletion makes of it."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)),
                      lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(F.col(word)), cut))


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, max_list: int = MAX_LIST, min_list: int = MIN_LIST) -> DataFrame:
    """``word, n, near, near_n``: each pair of near words in both directions. ``words``: distinct ``word`` (no ``^`` or ``$``, of at least
    ``qmin + qmax - 2`` code points), ``n``."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, qmin, qmax, min_list=min_list))
    lists = written(words.mapInArrow(_postings(frequent, qmin, qmax),
                                     "gram string, place int, size int, reads boolean, word string, n long")
                    .select(F.xxhash64("gram", "place", "size").alias("key"), "reads", "word", "n"), "spelling-lists")
    sizes = lists.groupBy("key").agg(F.sum(F.when(F.col("reads"), 0).otherwise(1)).alias("held"), F.sum(F.when(F.col("reads"), 1).otherwise(0)).alias("readers"))
    long = written(sizes.where((F.col("held") > max_list) & (F.col("readers") > 0)).select("key"), "spelling-long-lists")

    def met(rows: DataFrame, key: str) -> DataFrame:
        held = rows.where(~F.col("reads")).select(F.col(key), F.col("word").alias("near"), F.col("n").alias("near_n"))
        readers = rows.where("reads").select(F.col(key), "word", "n")
        both = readers.join(held, key).where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
        swap = F.col("near") < F.col("word")
        return both.select(F.when(swap, F.col("near")).otherwise(F.col("word")).alias("a"),
                           F.when(swap, F.col("near_n")).otherwise(F.col("n")).alias("a_n"),
                           F.when(swap, F.col("word")).otherwise(F.col("near")).alias("b"),
                           F.when(swap, F.col("n")).otherwise(F.col("near_n")).alias("b_n"))

    short = lists.join(long, "key", "left_anti")
    dealt = (lists.join(long, "key", "left_semi").select("key", "reads", "word", "n", F.explode(_variants("word")).alias("_v"))
             .select(F.xxhash64("key", "_v").alias("key"), "reads", "word", "n"))
    pairs = met(short, "key").unionByName(met(dealt, "key")).distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.explode(ways).alias("w")).select("w.*")


def spelling_variants(words: DataFrame, ratio: int = RATIO, **index) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct ``word`` and ``n``.

    ``form``: the near word of most occurrences (ties: first in code-point order) if it has at least ``ratio`` times the word's, else
    null; ``root``: the last of the chain of forms, the word itself if it has none. ``ratio`` is above 1.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = written(words.select("word", "n"), "spelling-words")
    near = near_words(words, **index)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_b"))
    known = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_b.near").alias("_near"), (-F.col("_b.m")).alias("_near_n")),
        "spelling-near")
    form = F.col("_near_n") >= F.lit(ratio) * F.col("n")
    known = known.select("word", "n", "n_near", F.when(form, F.col("_near")).alias("form"), F.when(form, F.col("_near_n")).alias("form_n"))
    links = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each step of a chain multiplies the count by `ratio`; so many doublings reach its end
    top = words.agg(F.max("n"), F.min("n")).first()
    steps = 1 + int(math.log(max(1, (top[0] or 1) / max(1, top[1] or 1)), ratio)) + 1
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        links = written(links, "spelling-roots")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return (known.join(links, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling(spark, sf_dir) -> DataFrame:
    """Contract query: the form and root of every word of ``documents``."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2),
                       lambda i: ('0x' || substr(x, i::INT + 1, 2))::BIGINT)),
                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
w AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT word, n, -1 AS i, word AS cut FROM w UNION ALL
      SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.cut = b.cut
         WHERE a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
             CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS leaf, 0 AS d FROM f
                       UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON f.word = c.leaf WHERE f.form IS NOT NULL)
  SELECT word, arg_max(leaf, d) AS root FROM c GROUP BY word)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word)
"""

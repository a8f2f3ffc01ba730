"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint per document; two documents are linked when their fingerprints differ at
``max_bits`` bits or fewer, and a class is a connected component of these links.

Candidates: a fingerprint is cut into ``s = max_bits // 2 + 1`` segments (two for three bits), few
enough that in any linked pair one segment differs at no more than one bit. Each segment is
indexed under its one-wildcard variants - the segment with one bit deleted, once per bit - so
equal keys are exactly "differs at most at the deleted bit", and an equality on the key finds
every candidate. Each candidate is verified on all 64 bits.

At scale: only distinct fingerprints are indexed, ``64`` slim rows (two longs) each, whatever the
text size, and equal fingerprints never meet each other. Index rows are dealt and sorted by key and
streamed; a group of equal keys larger than ``max_group`` is not compared in one task but indexed
again on finer keys of the bits outside the matched segment, and at the last level it is cut into
blocks of which each pair is one task's work. A group returns a spanning forest of its links, not
all pairs, so dense groups of near copies do not grow with their square. Components are found by
alternating large-star and small-star steps on written edge tables; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import giving_back, per_block, table, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
MAX_GROUP = 2048  # fingerprints of one key compared in one task; larger groups are split


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: a bit is set when more than half of the shingle hashes have it.

    A-Z are lower-cased; words are runs outside space and \\t-\\r; shingles are counted with
    repeats; fewer words than a shingle form one shingle; no words: 0.
    """
    import xxhash

    words = data.lower().split()  # on bytes: ASCII letters and exactly those six separators
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return h64(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    a, b = starts[:n].tolist(), ends[shingle_words - 1:].tolist()
    hashes = np.fromiter((h64(joined[x:y], seed) for x, y in zip(a, b)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k:k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        set_in += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_in * 2 > n).tobytes(), "big")


def text_hash(text):
    """What tells the texts of one id apart; null has one, too."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, row, fp`` (longs: the text's hash, the unsigned fingerprint's bits). Null text counts as no words."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def block(keys, texts):
        fps = np.array([fingerprint(t.encode(), shingle_words, seed) for t in texts], np.uint64)
        return {"doc_id": [i for i, _ in keys], "row": [r for _, r in keys], "fp": fps.view(np.int64)}

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("row"), text.alias("text"))
    out = slim.mapInArrow(per_block(block, schema, "doc_id", "row"), "doc_id long, row long, fp long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "row", "fp")


def _field(base, low: int, bits: int):
    """Bits ``low .. low+bits-1`` of a long column."""
    return F.shiftrightunsigned(base, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _variants(value, bits: int):
    """``value`` (a ``bits``-wide long) with each bit deleted in turn: structs (bit, rest)."""
    def one(i):
        low = F.lit((1 << i) - 1).cast("long")
        return F.struct(F.lit(i).alias("bit"),
                        F.shiftright(value, i + 1).bitwiseAND(F.lit((1 << 63) - 1).cast("long")) * F.lit(1 << i).cast("long")
                        + value.bitwiseAND(low))
    return [one(i) for i in range(bits)]


def segments(width: int, max_bits: int) -> list[tuple[int, int]]:
    """(low bit, bits) of the fewest segments of which one differs at <= 1 bit in a linked pair."""
    n = min(width, max_bits // 2 + 1)
    cut = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def signature_rows(fps: DataFrame, width: int = 64, max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fp``: every one-wildcard variant of every segment of every fingerprint.

    The key is a 64-bit hash of (segment, deleted bit, remaining bits): an accidental equality
    only adds a candidate, which the verification drops.
    """
    keys = []
    for low, bits in segments(width, max_bits):
        for v in _variants(_field(F.col("fp"), low, bits), bits):
            keys.append(F.xxhash64(F.lit(low), v["bit"], v["col2"]))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints of one group."""
    g = len(fp)
    label = np.arange(g)
    close = np.empty((g, g), bool)
    for a in range(0, g, 256):
        close[a:a + 256] = np.bitwise_count(fp[a:a + 256, None] ^ fp[None, :]) <= max_bits
    while True:
        new = label.copy()
        for a in range(0, g, 256):
            new[a:a + 256] = np.where(close[a:a + 256], label[None, :], g).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(g))
    return fp[other], fp[label[other]]


def group_edges(key: np.ndarray, fp: np.ndarray, max_bits: int, max_group: int):
    """Links within runs of equal (sorted) keys: ``(a, b), rows of runs that are too large``."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(starts, len(key)))
    a_out, b_out = [], []
    small = np.repeat((size > 1) & (size <= 8), size)
    k, f = key[small], fp[small]
    for lag in range(1, 8):
        if len(k) <= lag:
            break
        hit = (k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= max_bits)
        a_out.append(f[lag:][hit])
        b_out.append(f[:-lag][hit])
    for s, n in zip(starts[(size > 8) & (size <= max_group)], size[(size > 8) & (size <= max_group)]):
        a, b = forest(fp[s:s + n], max_bits)
        a_out.append(a)
        b_out.append(b)
    a = np.concatenate(a_out) if a_out else fp[:0]
    b = np.concatenate(b_out) if b_out else fp[:0]
    return a, b, np.repeat(size > max_group, size)


def _match_sorted(max_bits: int, max_group: int):
    """mapInArrow over rows sorted by key: edges (big=false) and the rows of too-large groups.

    A key's run may span batches: rows of the last key wait for the next batch until there are
    more than ``max_group`` of them, from when they are passed on as rows of a large group. The rest of
    that key may lead a batch that ends in another large key, so both are known until the batch is done.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("big", pa.bool_())])

    def rows(a, b, big):
        return pa.RecordBatch.from_pydict(
            {"a": a.view(np.int64), "b": b.view(np.int64), "big": np.full(len(a), big)}, schema=schema)

    def run(batches):
        key, fp, large = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        def done(key, fp):
            if not len(key):
                return
            a, b, big = group_edges(key, fp, max_bits, max_group)
            big |= np.isin(key, large)
            if len(a):
                yield rows(a, b, False)
            if big.any():
                yield rows(key[big].view(np.uint64), fp[big], True)
        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy().view(np.uint64)))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > max_group:
                large = np.append(large, key[-1])
                yield from done(key, fp)
                key, fp, large = key[:0], fp[:0], large[-1:]
            else:
                yield from done(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield from done(key, fp)
    return run


def _match(rows: DataFrame, max_bits: int, max_group: int, name: str) -> DataFrame:
    out = (rows.repartition("key").sortWithinPartitions("key", "fp")
               .mapInArrow(giving_back(_match_sorted(max_bits, max_group)), "a long, b long, big boolean"))
    return written(out, name)


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """``a, b``: links between distinct fingerprints that join up every component.

    ``fps`` holds distinct ``fp``. Groups of up to ``max_group`` rows are compared in one task.
    Larger groups go on twice: their rows are keyed again by the old key with each narrower
    one-wildcard variant (a linked pair that shares the old key also shares one of the new ones,
    since all 64 bits are cut, more finely), and what is still too large after
    that is compared block by block, every pair of blocks by one row group.
    """
    step = _match(signature_rows(fps, 64, max_bits), max_bits, max_group, "simhash-links")
    edges = step.where(~F.col("big")).select("a", "b")
    big = step.where("big").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if big.isEmpty():
        return edges.distinct()
    # finer keys: with s pieces of equal width one piece is equal when s > max_bits
    pieces = []
    n = max_bits + 1
    cut = [64 * i // n for i in range(n + 1)]
    for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
        pieces.append(F.xxhash64("key", F.lit(i), _field(F.col("fp"), lo, hi - lo)))
    finer = big.select(F.explode(F.array(*pieces)).alias("key"), "fp").distinct()
    step = _match(finer, max_bits, max_group, "simhash-links-finer")
    edges = edges.unionByName(step.where(~F.col("big")).select("a", "b"))
    big = step.where("big").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if big.isEmpty():
        return edges.distinct()
    return edges.unionByName(_block_pairs(big, max_bits, max_group)).distinct()


def _block_pairs(big: DataFrame, max_bits: int, max_group: int) -> DataFrame:
    """The last level: groups cut into blocks of about ``max_group / 2``; each pair of blocks is a task's work."""
    half = max(1, max_group // 2)
    n_blocks = big.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("n"))
    block = big.join(n_blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                       lambda j: F.xxhash64("key", F.least("i", j), F.greatest("i", j)))
    met = block.select(F.explode(pair).alias("key"), "fp")
    schema = "a long, b long"

    def compare(pdf):
        import pandas as pd
        a, b = forest(np.unique(pdf["fp"].to_numpy().view(np.uint64)), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return written(met.groupBy("key").applyInPandas(compare, schema), "simhash-links-blocks")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, root``: the smallest node of each component, for nodes that have an edge.

    Alternating large-star and small-star steps; each round is one written table. A star's
    centre is found by a partial aggregate, so a hub is not gathered anywhere.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "components-0")
    for k in range(1, max_rounds + 1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large-star: every larger neighbour of a node is linked to the node's smallest neighbour
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .where("a <> b").distinct())
        # small-star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                                 F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                      .select("e.a", "e.b").where("a <> b").distinct())
        new = written(small, f"components-{k}")
        changed = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, seed: int = SEED, max_group: int = MAX_GROUP) -> DataFrame:
    """``doc_id, row, fp, root, component_id`` for every row of ``docs``, extra columns ignored.

    ``component_id`` is the smallest id reachable over links, the document's own included; ``root`` is the smallest fingerprint
    there, ``row`` the text's hash. Null
    and empty texts have fingerprint zero and are linked like others; repeated ids keep their rows;
    a null id keeps its row and never names a component that has another id; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash-fp")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    comp = components(links(distinct.select("fp"), max_bits, max_group))
    # a component's smallest id, by its root fingerprint
    rooted = (distinct.join(comp, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def hex16(fp) -> "F.Column":
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark, sf_dir) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")

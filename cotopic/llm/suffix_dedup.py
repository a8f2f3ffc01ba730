"""Exact removal of long repeated passages through run-compressed suffix indexes.

A byte goes when a ``window``-byte string covers it that also starts anywhere else in the corpus,
in the same document included. Strings are judged on the input; matches never cross documents.

1. Every window chooses an anchor, its ``GRAM``-byte string of least hash. Equal windows choose
   equal anchors, so a repeat can only be found among windows of equal anchor; a run of windows that choose
   one anchor is a *context*. One slim row per context (about one per 180 bytes) is shuffled, no text.
2. Equal contexts met twice are repeats as a whole. A context that is alone with its anchor holds none.
3. What is left - different contexts of one anchor - is dealt by anchor into buckets of bounded size.
   In each, a run-length compressed Burrows-Wheeler transform of the contexts is built with its
   sampled run ends, the matching statistics are streamed from the samples, and every window start
   with a statistic of ``window`` or more is marked. Equal windows always meet in one bucket.
4. An anchor with more than ``max_bytes`` of different contexts is dealt again by a longer
   key: its windows are cut into bins of neighbouring offsets, and the bytes that all windows of a bin
   share are the key. Bins narrow to a single window, where contexts of one key are equal; so every
   group becomes small or is settled by step 2, and none is dropped.
5. Marked runs are grouped by document and applied to the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import BLOCK_ROWS, give_back, giving_back, table, written
from cotopic.llm.suffix_core import RunIndex, window_anchors

WINDOW = 400
PIECE = 1 << 20  # bytes of window starts of a long document handled at once
BLOCK = 1 << 19  # bytes of documents handled at once; below 2**22 with a piece and a window
BUCKET_BYTES = 1 << 20
MAX_BYTES = 2 << 20
INDEX_BYTES = 1 << 18  # contexts of a bucket indexed at once, whole anchors; one anchor alone may have up to MAX_BYTES
SEEN = 200_000  # contexts a scanning task remembers
BINS = (64, 8, 1)  # windows in a bin when a large group is dealt again
SORT_ROWS = 500_000

# A context's place, packed in a long: 15 bits of the text's hash (they tell rows of one id apart),
# 31 bits first window start, 9 bits last minus first, 9 bits anchor minus first.
_MEMBER = "doc_id long, place long, g long, c long, settled boolean"
_MEMBER_PA = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("g", pa.int64()), ("c", pa.int64()), ("settled", pa.bool_())])
_CONTEXT = "doc_id long, place long, g long, c long, ctx binary"
_CONTEXT_PA = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("g", pa.int64()), ("c", pa.int64()), ("ctx", pa.binary())])
_SPAN = "doc_id long, tag long, first long, last long"
_SPAN_PA = pa.schema([(n, pa.int64()) for n in ("doc_id", "tag", "first", "last")])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _place(tag, first, last, anchor):
    return (tag << 49) | (first << 18) | ((last - first) << 9) | (anchor - first)


def _unplace(place):
    """``tag, first, last, anchor`` of a place (numbers, arrays or columns' values)."""
    first = (place >> 18) & ((1 << 31) - 1)
    return (place >> 49) & 0x7FFF, first, first + ((place >> 9) & 511), first + (place & 511)


def _values(batches, *names: str):
    """The rows of the batches as Python values, a few rows of a batch at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def _contexts_of(docs, window: int):
    """``doc ids, places, g, c`` of a few documents. ``docs``: (doc_id, tag, offset, bytes)."""
    import xxhash

    data = b"".join(d[3] for d in docs)
    ends = np.cumsum([len(d[3]) for d in docs])
    g, anchor, first, last = window_anchors(np.frombuffer(data, np.uint8), np.append(ends, 1 << 62), window)
    k = np.searchsorted(ends, first, side="right")
    shift = np.array([d[2] for d in docs], np.int64)[k] - np.concatenate(([0], ends[:-1]))[k]
    h = xxhash.xxh3_64_intdigest
    c = np.array([h(data[a:b + window]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
    place = _place(np.array([d[1] for d in docs], np.int64)[k], first + shift, last + shift, anchor + shift)
    return [docs[i][0] for i in k], place, _signed(g), _signed(c)


def members(docs: DataFrame, window: int) -> DataFrame:
    """One row per context of ``docs`` (``doc_id, tag, text``): a scan, no shuffle.

    A context met for the third time or more among the last of one task is ``settled``: two others of the task go on to
    be counted, so copies, however many, meet as two rows per ``SEEN`` contexts of a task.
    """
    def run(batches):
        seen: dict = {}

        def rows(few):
            if len(seen) > SEEN:
                seen.clear()
            ids, place, g, c = _contexts_of(few, window)
            settled = np.zeros(len(g), bool)
            for i, gc in enumerate(zip(g.tolist(), c.tolist())):
                n = seen.get(gc, 0)
                settled[i] = n > 1
                seen[gc] = n + 1
            return pa.RecordBatch.from_pydict({"doc_id": ids, "place": place, "g": g, "c": c, "settled": settled}, schema=_MEMBER_PA)

        few, size = [], 0
        for doc_id, tag, text in _values(batches, "doc_id", "tag", "text"):
            data = (text or "").encode()
            for a in range(0, len(data) - window + 1, PIECE):
                piece = data[a:a + PIECE + window - 1]
                if few and size + len(piece) > BLOCK:
                    yield rows(few)
                    few, size = [], 0
                few.append((doc_id, tag, a, piece))
                size += len(piece)
        if few:
            yield rows(few)
    return docs.select("doc_id", "tag", "text").mapInArrow(giving_back(run), _MEMBER)


_SORTED = "doc_id long, place long, g long, c long, again boolean, several boolean"
_SORTED_PA = pa.schema([*list(_MEMBER_PA)[:4], ("again", pa.bool_()), ("several", pa.bool_())])


def _same_as_before(*cols):
    same = np.ones(len(cols[0]), bool)
    for x in cols:
        same &= np.concatenate(([False], x[1:] == x[:-1]))
    return same


def _sort_out(batches):
    """mapInArrow over a range partition sorted by (g, c): what each context's row tells.

    ``again``: the context occurs twice or more, it is a repeat as a whole. ``several``: set on one row
    per context, if its anchor has other contexts (or may have in the neighbouring partition).
    Rows with neither are left out. A partition is of bounded size, as ranges split anchors and a
    context comes in two rows per scanning task at most.
    """
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    g, c = table.column("g").to_numpy(), table.column("c").to_numpy()
    same_g, same_c = _same_as_before(g), _same_as_before(g, c)
    run = np.cumsum(~same_g) - 1
    many = np.bincount(run, weights=same_g & ~same_c) > 0
    many[0] = many[-1] = True
    again = same_c | np.append(same_c[1:], False)
    several = many[run] & ~same_c
    keep = again | several
    out = table.select(_MEMBER_PA.names[:4]).filter(pa.array(keep))
    out = out.append_column("again", pa.array(again[keep])).append_column("several", pa.array(several[keep]))
    yield from out.cast(_SORTED_PA).to_batches(max_chunksize=1 << 16)


def _sorted_out(rows: DataFrame, name: str) -> DataFrame:
    n = max(2, -(-rows.count() // SORT_ROWS))
    n = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(rows.repartitionByRange(n, "g", "c").sortWithinPartitions("g", "c").mapInArrow(giving_back(_sort_out), _SORTED), name)


def _marks(ctx: list[bytes], size: np.ndarray, window: int):
    """Runs of window starts of the contexts whose window occurs again in them: ``context, first, last``."""
    text = np.zeros(int(size.sum()) + len(ctx), np.uint16)  # symbol 0 ends a context
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    for s, x in zip(start.tolist(), ctx):
        text[s:s + len(x)] = np.frombuffer(x, np.uint8)
        text[s:s + len(x)] += 1
    room = np.repeat(start + size, size + 1) - np.arange(len(text))  # symbols left in the context
    hit = np.minimum(RunIndex(text).stream(), room) >= window
    a = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    b = np.flatnonzero(hit & ~np.append(hit[1:], False))
    k = np.searchsorted(start, a, side="right") - 1
    return k, a - start[k], b - start[k]


def _bucket_marks(window: int, index_bytes: int = INDEX_BYTES):
    """applyInArrow: contexts of one bucket to the runs of repeated window starts.

    Equal windows have equal anchors, so a few whole anchors are indexed at a time: memory follows the largest anchor, not the bucket.
    """
    import pyarrow.compute as pc

    def run(table):
        try:
            g, c = table.column("g").to_numpy(), table.column("c").to_numpy()
            order = np.lexsort((c, g))
            order = order[~_same_as_before(g[order], c[order])]  # a context is indexed once
            _, n = np.unique(g[order], return_counts=True)
            order, n = order[np.repeat(n > 1, n)], n[n > 1]  # a context alone with its anchor has no repeat
            ends = np.cumsum(n)  # where anchors end
            length = pc.binary_length(table.column("ctx")).to_numpy().astype(np.int64)[order]
            upto = np.concatenate(([0], np.cumsum(length)))
            found, at = [], 0
            while at < len(order):
                few = int(np.searchsorted(upto[ends], upto[at] + index_bytes, side="right"))
                to = int(ends[few - 1]) if few and ends[few - 1] > at else int(ends[few])  # one anchor at least
                rows = order[at:to]
                part = table.take(pa.array(rows))
                k, first, last = _marks(part.column("ctx").to_pylist(), length[at:to], window)
                tag, start, _, _ = _unplace(part.column("place").to_numpy()[k])
                found.append(pa.table({"doc_id": part.column("doc_id").take(pa.array(k)), "tag": tag, "first": first + start, "last": last + start}))
                at = to
            return pa.concat_tables(found) if found else _SPAN_PA.empty_table()
        finally:
            give_back()
    return run


def _refined(window: int, width: int):
    """mapInArrow: contexts of large groups, cut into bins of ``width`` neighbouring offsets."""
    import xxhash

    def run(batches):
        h = lambda x: (v := xxhash.xxh3_64_intdigest(x)) - (v >> 63 << 64)
        out, size = {n: [] for n in _CONTEXT_PA.names}, 0
        for doc_id, place, g, ctx in _values(batches, "doc_id", "place", "g", "ctx"):
            _, first, last, anchor = _unplace(place)
            for j in range((anchor - last) // width, (anchor - first) // width + 1):
                a, b = max(first, anchor - j * width - width + 1), min(last, anchor - j * width)
                sub = ctx[a - first:b - first + window]
                core = ctx[anchor - j * width - first:anchor - j * width - width + 1 - first + window]
                key = h(core + j.to_bytes(4, "little") + g.to_bytes(8, "little", signed=True))
                size += len(sub)
                for n, v in zip(_CONTEXT_PA.names, (doc_id, place >> 49 << 49 | _place(0, a, b, anchor), key, h(sub), sub)):
                    out[n].append(v)
            if size > BLOCK:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_PA)
                out, size = {n: [] for n in _CONTEXT_PA.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_PA)
    return giving_back(run)


def _cut_contexts(window: int):
    """mapInArrow: documents with their wanted contexts to one row per context."""
    def run(batches):
        out, size = {n: [] for n in _CONTEXT_PA.names}, 0
        for doc_id, text, want in _values(batches, "doc_id", "text", "want"):
            data = text.encode()
            for w in want:
                _, first, last, _ = _unplace(w["place"])
                ctx = data[first:last + window]
                size += len(ctx)
                for n, v in zip(_CONTEXT_PA.names, (doc_id, w["place"], w["g"], w["c"], ctx)):
                    out[n].append(v)
            if size > BLOCK:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_PA)
                out, size = {n: [] for n in _CONTEXT_PA.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_PA)
    return giving_back(run)


def _spans(rows: DataFrame) -> DataFrame:
    """Whole contexts as runs of window starts."""
    p = F.col("place")
    first = F.shiftright(p, 18).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
    return rows.select("doc_id", F.shiftrightunsigned(p, 49).alias("tag"), first.alias("first"),
                       (first + F.shiftright(p, 9).bitwiseAND(F.lit(511).cast("long"))).alias("last"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES,
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, tag, first, last``: runs of window starts whose window occurs elsewhere."""
    rows = written(members(docs, window), "suffix-members")
    found = [_spans(rows.where("settled"))]
    step = _sorted_out(rows.where("not settled"), "suffix-sorted")
    found.append(_spans(step.where("again")))
    kept = step.where("several")
    want = kept.groupBy("doc_id", F.shiftrightunsigned("place", 49).alias("tag")).agg(
        F.collect_list(F.struct("place", "g", "c")).alias("want"))
    d, w = docs.alias("d"), want.hint("merge").alias("w")  # the lists grow with the corpus: one plan at every size
    # written at every size, so that the steps after it are the same whether an anchor is large or none
    contexts = written(d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tag") == F.col("w.tag")))
                       .select("d.doc_id", "text", "want").mapInArrow(_cut_contexts(window), _CONTEXT), "suffix-contexts")
    span = F.shiftright("place", 9).bitwiseAND(F.lit(511).cast("long")) + window + 1
    for width in (*BINS, None):
        groups = kept.groupBy("g").agg(F.sum(span).alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1")
        big = groups.where(F.col("bytes") > max_bytes).select("g")
        total = int(groups.where(F.col("bytes") <= max_bytes).agg(F.sum("bytes")).first()[0] or 0)
        deal_again = width is not None and not big.isEmpty()
        few = contexts.join(big, "g", "left_anti") if deal_again else contexts
        n = max(1, -(-total // bucket_bytes))
        found.append(few.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n)))
                        .groupBy("bucket").applyInArrow(_bucket_marks(window), _SPAN))
        if not deal_again:
            break
        sub = written(contexts.join(big, "g", "left_semi").mapInArrow(_refined(window, width), _CONTEXT), f"suffix-cut-{width}")
        step = _sorted_out(sub.select("doc_id", "place", "g", "c"), f"suffix-sorted-{width}")
        found.append(_spans(step.where("again")))
        kept = step.where("several")
        contexts = sub.join(kept.select("doc_id", "place", "g", "c"), ["place", "g", "c"], "left_semi").select(*_CONTEXT_PA.names)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def covered(runs, window: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows that start in ``runs`` (pairs first, last)."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + window) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   max_bytes: int = MAX_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: removed byte runs, and the bytes that stay (binary).

    Null and empty texts have no bytes. Rows with equal id and text are two documents, so they repeat each other;
    rows that share an id, or have none, are told apart by their text. A text is below 2 GB, as Spark has it.
    Extra columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # inside, a row is known by 64 bits of id and text and 15 more of the text: rows without an id, or of one id, stay apart
    slim = named.select("_id", F.xxhash64(F.coalesce("_id", F.lit(0)), F.col("_id").isNull(), F.coalesce("text", F.lit(""))).alias("doc_id"),
                        F.xxhash64("text").bitwiseAND(F.lit(0x7FFF).cast("long")).alias("tag"), "text")
    runs = repeated_runs(slim.drop("_id"), window, max_bytes, bucket_bytes)
    per_doc = (runs.groupBy(F.col("doc_id").alias("r_id"), F.col("tag").alias("r_tag"))
                   .agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    joined = (slim.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tag") == F.col("r_tag")), "left")
                  .select(F.col("_id").alias("doc_id"), "text", "runs"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def apply(batches):
        out, size = {n: [] for n in schema.names}, 0
        for doc_id, text, rs in _values(batches, "doc_id", "text", "runs"):
            data = (text or "").encode()
            gone = covered(rs or [], window)
            keep, at = [], 0
            for a, b in gone:
                keep.append(data[at:a])
                at = b
            kept = b"".join([*keep, data[at:]])
            size += len(data)
            for n, v in zip(schema.names, (doc_id, len(data), [{"start": a, "end": b} for a, b in gone], kept)):
                out[n].append(v)
            if size > BLOCK:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out, size = {n: [] for n in schema.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return joined.mapInArrow(giving_back(apply), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark, sf_dir) -> DataFrame:
    """Contract query: what 400-byte repeats take from every document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes",
                      F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

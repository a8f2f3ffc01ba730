"""What a task of the suffix operator holds: a few rows as Python values, a few anchors in an index."""

import random
import tracemalloc

import pyarrow as pa

from cotopic.llm import suffix_dedup
from cotopic.llm.suffix_dedup import _CONTEXT_PA, _SPAN_PA, _bucket_marks, _place, _values


def bucket(anchors):
    """Contexts of several anchors, each a cut of its anchor's passage behind other text, and some rows twice."""
    r = random.Random(anchors)
    rows = []
    for g in range(anchors):
        passage = bytes(r.choices(b"abcd", k=700))
        for i in range(g % 5):
            ctx = bytes(r.choices(b"efgh", k=r.randint(0, 90))) + passage[r.randint(0, 250):]
            rows.append((i, _place(3, 1000, 1000 + len(ctx) - 400, 1005), g * 7 - 20, len(rows), ctx))
    rows += rows[:5]
    r.shuffle(rows)
    return rows, pa.table(dict(zip(_CONTEXT_PA.names, map(list, zip(*rows)))), schema=_CONTEXT_PA)


def test_a_bucket_is_indexed_by_a_few_anchors(monkeypatch):
    rows, table = bucket(60)
    sizes = []
    index = suffix_dedup.RunIndex
    monkeypatch.setattr(suffix_dedup, "RunIndex", lambda text: (sizes.append(len(text)), index(text))[1])
    results = []
    for few in (1, 5000, 1 << 30):
        sizes.clear()
        out = _bucket_marks(400, few)(table)
        assert out.schema == _SPAN_PA
        results.append(sorted(map(tuple, (x.values() for x in out.to_pylist()))))
        assert few == 1 << 30 or max(sizes) <= max(few, 4 * 800) + 100  # it was the whole bucket at once
    grams = [(c, ctx[a:a + 400], a) for _, _, _, c, ctx in {x[3]: x for x in rows}.values() for a in range(len(ctx) - 399)]
    count = {}
    for _, gram, _ in grams:
        count[gram] = count.get(gram, 0) + 1
    assert results[0] == results[1] == results[2]
    assert sum(last - first + 1 for _, _, first, last in results[0]) == sum(count[gram] > 1 for _, gram, _ in grams) > 0
    assert _bucket_marks(400)(table.slice(0, 0)).num_rows == 0


def test_a_batch_is_not_turned_into_objects():
    texts = [f"{i}" * 1000 for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": texts})
    tracemalloc.start()
    assert sum(i == int(t[:len(str(i))]) for i, t in _values([batch], "doc_id", "text")) == 5000
    assert tracemalloc.get_traced_memory()[1] < 4 << 20  # all texts at once: 19 MB
    tracemalloc.stop()


def test_contexts_forgotten_in_a_scan_are_still_counted(spark, monkeypatch):
    """With little memory of what was met, more copies are counted, and the same bytes go."""
    from cotopic.llm.suffix_dedup import members, repeated_runs
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh ", k=900))
    rows = [(i, 0, "".join(r.choices("abcdefgh ", k=300)) + passage) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, tag long, text string").coalesce(1)

    def found():
        covered = {}
        for x in repeated_runs(df, 400).collect():
            covered.setdefault(x["doc_id"], set()).update(range(x["first"], x["last"] + 1))
        return covered
    want = found()
    assert all(v >= set(range(300, 801)) for v in want.values()) and len(want) == 40
    settled = members(df, 400).where("settled").count()
    monkeypatch.setattr(suffix_dedup, "SEEN", 0)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    assert members(df, 400).where("settled").count() < settled
    assert found() == want

import random

import numpy as np
import pytest

from cotopic.llm.suffix_core import RunIndex
from cotopic.llm.suffix_dedup import remove_repeats
from tests.llm.brute import repeats


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefé", k=r.randint(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(r.choices(words, k=k))
    passages = [text(40) for _ in range(6)]
    out = [None, "", "short", "x" * 900, "ab" * 700]
    for _ in range(n):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.randint(0, 30))]
        out.append(" ".join(parts))
    return out + out[7:12]


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics(seed):
    r = np.random.default_rng(seed)
    base = r.integers(1, 4, 60)
    parts = [base, r.integers(1, 4, 30), base[10:50], base, np.ones(40, int), r.integers(1, 3, 50)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
    n, window = len(text), 9
    got = RunIndex(text).stream() >= window
    grams = [tuple(text[i:i + window]) for i in range(n - window + 1)]
    for i, g in enumerate(grams):
        assert got[i] == (grams.count(g) > 1), i


@pytest.mark.parametrize("max_bytes", [2 << 20, 2500])
def test_against_brute_force(spark, max_bytes):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string").repartition(4)
    out = remove_repeats(df, window=120, max_bytes=max_bytes, bucket_bytes=4000)
    import hashlib
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in out.collect()}
    want = repeats(texts, 120)
    assert [got[i] for i in range(len(texts))] == want
    assert any(w[1] for w in want) and any(not w[1] for w in want)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500), (None, "b" * 399), (2, None)], schema)
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in remove_repeats(df).collect())
    assert got == [(0, 399, 399), (1, 500, 0), (1, 500, 0), (2, 0, 0)]


def test_rows_without_an_id_or_of_one_id(spark):
    """2,000 rows that share their id or have none, most of one text each and some equal, and one over the piece border."""
    import hashlib
    from collections import Counter
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(2000)]
    passages = [" ".join(r.choices(words, k=12)) for _ in range(40)]
    texts = [" ".join([*r.choices(words, k=r.randint(5, 40)), *([r.choice(passages)] if i % 4 == 0 else []), *r.choices(words, k=r.randint(5, 20))])
             for i in range(1990)]
    texts += texts[:5] + [None, "", "a b c " * 400]
    long = " ".join(r.choices(words, k=190_000))  # over 1 MiB
    at = (1 << 20) - 60
    texts += [long, long[at:at + 200]]
    rows = [(None if i % 3 else i % 2, t) for i, t in enumerate(texts)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=60)
    got = Counter((x.doc_id, x.n_bytes, len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in out.collect())
    want = Counter((i, n, spans, h) for (i, _), (n, _, spans, h) in zip(rows, repeats(texts, 60)))
    assert got == want

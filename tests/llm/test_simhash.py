import random

import numpy as np
import pyarrow as pa
import pytest

from cotopic.llm.simhash import _match_sorted, components, fingerprint, hex16, links, near_duplicates
from pyspark.sql import functions as F
from tests.llm.brute import link_components, simhash

TEXTS = [None, "", "  \t\n", "one", "One two", "a b c", "A  b\tc", "é É x y z", "a b c a b c a b c", "w " * 3000]


def test_fingerprint():
    r = random.Random(1)
    for t in TEXTS + [" ".join(r.choices(["Ab", "cd", "é x", "f"], k=k)) for k in range(1, 60)]:
        assert fingerprint((t or "").encode()) == simhash(t), t


def clusters(n, seed=5):
    r = random.Random(seed)
    fps = set()
    while len(fps) < n:
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 40)):
            fps.add(f)
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
    return sorted(fps)


@pytest.mark.parametrize("max_group", [2048, 16, 4])
def test_components_of_links(spark, max_group):
    fps = clusters(700)
    signed = [f - (f >> 63 << 64) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comp = components(links(df, 3, max_group))
    root = {r.node: r.root for r in comp.collect()}
    got = [root.get(f, f) for f in signed]
    assert got == link_components(signed, fps)


def test_near_duplicates(spark):
    r = random.Random(2)
    base = " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], k=400))
    texts = TEXTS + [base, base, base.upper(), base + " tail", base.replace("alpha", "omega")]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = near_duplicates(df).select("doc_id", hex16(F.col("fp")).alias("f"), "component_id").collect()
    fps = [simhash(t) for _, t, _ in rows]
    want = link_components([i for i, _, _ in rows], fps)
    assert sorted((o.doc_id, o.f, o.component_id) for o in out) == sorted((rows[i][0], f"{fps[i]:016x}", want[i]) for i in range(len(rows)))
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [7, 16, 30, 1000])
def test_neighbouring_large_keys_span_batches(batch):
    r = random.Random(batch)
    for sizes in [[20, 40], [60, 11, 50], *[r.choices([1, 2, 8, 9, 14, 25, 60], k=13) for _ in range(40)]]:
        key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
        fp = np.array(r.sample(range(1 << 40), len(key)), np.int64)
        batches = [pa.RecordBatch.from_pydict({"key": key[a:a + batch], "fp": fp[a:a + batch]}) for a in range(0, len(key), batch)]
        out = [x for b in _match_sorted(3, 8)(iter(batches)) for x in b.to_pylist() if x["big"]]
        want = [(k, f) for k, f in zip(key.tolist(), fp.tolist()) if sizes[k] > 8]
        assert sorted((x["a"], x["b"]) for x in out) == sorted(want)

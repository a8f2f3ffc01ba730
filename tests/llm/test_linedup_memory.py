"""What a task holds while lines are dropped: a few rows' hashes as Python values, never a batch's."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cotopic.llm.linedup import _digests, _stay, line_keys

HASHES = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())]))


def test_digests_of_slices_and_nulls():
    rng = np.random.default_rng(3)
    rows = [None if i % 5 == 0 else [{"h1": int(a), "h2": int(b)} for a, b in rng.integers(-2**63, 2**63 - 1, (i % 4, 2))] for i in range(40)]
    lost = pa.array(rows, HASHES)
    for a, n in ((0, 40), (3, 9), (39, 1), (7, 0)):
        want = [{np.array([g["h1"], g["h2"]], np.int64).tobytes() for g in r or []} for r in rows[a:a + n]]
        assert list(_digests(lost.slice(a, n))) == want


def test_a_batch_of_hashes_is_not_turned_into_objects():
    n, each = 4000, 50
    flat = pa.StructArray.from_arrays([pa.array(np.arange(n * each)), pa.array(np.arange(n * each))], ["h1", "h2"])
    lost = pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, each, dtype=np.int32)), flat)
    tracemalloc.start()
    assert sum(len(x) for a in range(0, n, 256) for x in _digests(lost.slice(a, 256))) == n * each
    assert tracemalloc.get_traced_memory()[1] < 4 << 20  # the hashes alone are 3.2 MB; as objects they were over 60
    tracemalloc.stop()


def test_lines_that_stay():
    text = "A line of its own\nshort\na LINE that goes \nA line of its own"
    gone = {line_keys("a line that goes", 10)[0]}
    assert _stay(text, gone, 10) == {"kept": "A line of its own\nshort\nA line of its own", "n_lines": 4, "n_dropped": 1}
    assert _stay(None, set(), 10) == {"kept": None, "n_lines": 1, "n_dropped": 0}

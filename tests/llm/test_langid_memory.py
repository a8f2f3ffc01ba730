"""What the pipeline's workers hold while languages are found and documents packed."""

import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from cotopic.llm import langid, packing
from cotopic.llm.langid import BUCKETS, Mixture, _guesses, trigrams


def model():
    table = np.zeros((2, BUCKETS))
    for row, text in zip(table, ("abcde bade caab ", "vwxyz xyvw zzwx ")):
        bucket, _ = trigrams([text * 10])
        np.add.at(row, bucket, 1)
    return Mixture(["aa", "zz"], table)


def test_a_batch_of_texts_is_not_turned_into_objects():
    texts = ["", None, "123", "abcde bade", "vwxyz xyvw"] + [f"{i} caab " + "1" * 16000 for i in range(4000)]
    batch = pa.array(texts)
    guess = _guesses(model(), langid.PENALTY)
    list(guess([batch.slice(0, 300)]))  # caches
    tracemalloc.start()
    (out,) = guess([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.field("lang_pred").to_pylist() == ["und"] * 3 + ["aa", "zz"] + ["aa"] * 4000
    assert out.field("languages").to_pylist()[2:4] == [[], [{"lang": "aa", "share": 1.0}]]
    assert peak < 40 << 20  # 256 texts, a block of 1 MB and its code points; all texts at once: 64 MB more
    assert _guesses(None, 8.0)([batch.slice(0, 2)]).__next__().to_pylist() == [{"lang_pred": "und", "score": 0.0, "languages": []}] * 2


def test_small_slices_guess_as_the_whole_batch(monkeypatch):
    r = random.Random(4)
    batch = pa.array([" ".join("".join(r.choices(r.choice(["abcde", "vwxyz", "1 2"]), k=4)) for _ in range(r.randint(0, 30))) for _ in range(500)])
    (want,) = _guesses(model(), 8.0)([batch])
    monkeypatch.setattr(langid, "BLOCK_ROWS", 7)
    (got,) = _guesses(model(), 8.0)([batch])
    assert got.field("lang_pred").equals(want.field("lang_pred"))
    assert np.allclose(got.field("score").to_numpy(False), want.field("score").to_numpy(False), atol=1e-5)


def test_language_tasks_load_no_pandas():
    code = "import sys; from cotopic.llm import langid, packing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=langid.__file__.rsplit("/cotopic/", 1)[0]).returncode == 0


def test_reading_a_vocabulary_gives_memory_back_before_texts(spark, monkeypatch, tmp_path):
    order = []
    monkeypatch.setattr(packing, "Ids", lambda place: (order.append("read"), type("Of", (), {"of": lambda self, ts: (order.append("texts"), [b""] * len(ts))[1]})())[1])
    monkeypatch.setattr(packing, "give_back", lambda: order.append("given back"))
    taken = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, fn, schema):
            taken.append(fn)
    packing.pieces(Docs(), "v.json", 8, 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "row": [1], "text": ["x"]})
    assert [b.num_rows for b in taken[0]([batch])] == [1]
    assert order == ["read", "given back", "texts"]

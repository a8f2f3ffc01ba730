"""Toxicity and language: held-out accuracy, edges, and that no label or language reaches a score."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotopic.llm import langid, toxicity
from cotopic.llm.toxicity import (
    DECAY, SPAN, WINDOW, coded, fit, highest, phi, products, score, sequences, slot, window_scores,
)

SF = "/root/testdata/sf0.01"
CLEAN = ["the river runs through the old town", "a quiet evening with good bread", "they walk along the shore",
         "she reads a long letter at noon", "we plant trees in the garden"]


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(4)
    clean = [" ".join(r.choice(CLEAN, 4)) + "." for _ in range(60)]
    toxic = [" ".join(r.choice(CLEAN, 3)) + f" you {r.choice(['blockhead', 'nitwit'])}. " + r.choice(CLEAN) for _ in range(40)]
    return fit(toxic, clean, landmarks=40)


def test_sequences_against_plain_enumeration():
    kind, _ = coded(["ab-cde fg"])
    kind = kind[:-WINDOW]
    p = products(kind)
    want = {}
    n = len(kind)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                for m in range(k + 1, n):
                    if m - i < SPAN:
                        s = int(slot(p[0][i:i + 1], p[1][j:j + 1], p[2][k:k + 1], p[3][m:m + 1])[0])
                        want[s] = want.get(s, 0) + DECAY ** (m - i + 1)
    got = phi("ab-cde fg")
    assert {int(i): round(got[i], 9) for i in np.flatnonzero(got)} == {k: round(v, 9) for k, v in want.items()}


def test_table_is_the_sum_over_landmarks():
    rows = [phi(w) for w in ("nitwit", "river")]
    weights = (0.7 * rows[0] - 0.2 * rows[1]).astype(np.float32)
    kind, _ = coded(["a nit-wit"])
    x = np.zeros_like(rows[0])
    for a, t, w in sequences(kind):
        ends = np.arange(a, len(kind))
        inside = (ends > 20 - WINDOW) & (ends <= 20)
        np.add.at(x, t[inside], w)
    assert window_scores(kind, weights)[20] == pytest.approx(0.7 * x @ rows[0] - 0.2 * x @ rows[1], rel=1e-4)
    assert highest(["", "a nit-wit"], weights)[0][0] <= highest(["", "a nit-wit"], weights)[0][1]


def test_gapped_and_inserted(model):
    found = model.score(["you nitwit", "you n i t w i t", "you nit-wit", "you nitxwit", CLEAN[0], ""])
    assert found[0] > 0.5 and found[1] > 0.5
    assert min(found[2], found[3]) > 3 * max(found[4], found[5])
    assert found[4] < 0.5 and found[5] < 0.5


def test_score_edges(spark, model):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "you nitwit", 5), (None, "x " * 50_000, 5)], "doc_id long, text string, score int")
    got = score(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert score(df.limit(0), model).count() == 0
    none = toxicity.learn(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in score(df, none).collect()} == {0}


def test_toxicity_held_out(spark):
    got = toxicity.op1_toxicity(spark, SF).join(spark.read.parquet(SF + "/labels.parquet"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.6  # the smallest table has few insults to learn from


def test_language_held_out_and_labels_unused(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    model = langid.learn(docs, langid.held_in())
    a = langid.identify(docs.select("doc_id", "text"), model)
    got = {r.doc_id: r.lang_pred for r in a.collect()}
    held = docs.where(~langid.held_in()).collect()
    assert np.mean([got[r.doc_id] == r.lang for r in held]) > 0.97
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).limit(20).select("doc_id", "text"), model).collect()
    assert all(got[r.doc_id] == r.lang_pred for r in b)


def test_language_edges_and_mixture(spark):
    rows = [(i, "the cat and the dog went over the hill " * 3, "en") for i in range(8)]
    rows += [(i, "der hund und die katze laufen über den berg " * 3, "de") for i in range(10, 18)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(train)
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 34 !!", 0.5), (4, "the cat and the dog", 0.5), (4, "the cat and the dog", 0.5),
                                (5, "the cat and the dog went over the hill " * 9 + "der hund und die katze laufen über den berg " * 4, 0.5)],
                               "doc_id long, text string, score double")
    got = langid.identify(df, model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    mixed = next(r for r in got if r.doc_id == 5)
    assert {x.lang for x in mixed.languages} == {"en", "de"} and 0.5 < mixed.score < 0.9
    assert {r.lang_pred for r in langid.identify(df, langid.learn(train.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("size", [8, 20, 40])
def test_language_many(size):
    r = np.random.default_rng(size)
    words = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(3, 9))) for _ in range(60)] for _ in range(size)]
    words = [own + words[0][:20] for own in words]  # some words are common to all
    text = lambda k, n=60: " ".join(r.choice(words[k], n))
    names, table_ = [f"l{k:02}" for k in range(size)], np.zeros((size, langid.BUCKETS))
    for k in range(size):
        bucket, _ = langid.trigrams([text(k) for _ in range(30)])
        table_[k] = np.bincount(bucket, minlength=langid.BUCKETS)
    model = langid.Mixture(names, table_)
    *hist, total = model.histogram([text(k) for k in range(size)] + ["", text(1, 90) + " " + text(2, 45)])
    lang, share, pi = model.predict(*hist)
    assert lang[:size].tolist() == list(range(size)) and total[size] == 0 and min(share[:size]) > 0.9
    assert lang[-1] == 1 and 0.5 < share[-1] < 0.8 and np.argsort(-pi[-1])[1] == 2

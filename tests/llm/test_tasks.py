"""Tasks need the third-party packages alone: queries run from a foreign folder, where executors cannot import this repository."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from cotopic.llm import langid
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from cotopic.session import local_session
spark = local_session(2, 4)
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_where_tasks_have_no_repository(tmp_path):
    names = ["op1_toxicity", "op10_language", "op11_prefix_trie", "op12_html_extraction", "op13_spelling"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names


def test_language_sample(spark, monkeypatch):
    """The sample is the rows of least hash of each language, whatever the number of rows or languages."""
    rng = random.Random(2)
    rows = [(rng.choice(["aa", "aa", "aa", "bb", "bb", "cc"]), " ".join(rng.choices("abcdefgh", k=30)) + str(i)) for i in range(3000)]
    rows += [("aa", "copy of one text")] * 2000 + [("dd", "alone"), (None, "x"), ("ee", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    model = langid.learn(df, per_lang=50)
    assert model.langs == ["aa", "bb", "cc", "dd"]
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    few = langid.learn(df, per_lang=50)
    assert few.langs == ["aa", "bb"]
    plan = df.select("lang", F.xxhash64("text").alias("h")).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" in plan and "h#" in plan.split("hashpartitioning(")[1].split(")")[0]  # dealt by text, not by language


@pytest.mark.parametrize("seed", range(3))
def test_mixture_fit_against_plain_em(spark, seed):
    """Proportions and likelihoods by the textbook, one text and one set of languages at a time."""
    rng = random.Random(seed)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "acegi"}
    rows = [(x, " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))) for x, letters in alphabets.items() for _ in range(60)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    texts = [" ".join("".join(rng.choices(alphabets[x], k=5)) for x in rng.choices(names, k=60)) for names in (["aa"], ["aa", "bb"], ["bb", "cc"], ["cc"])]
    event, n, first, _ = model.histogram(texts)
    ends = [*first[1:].tolist(), len(event)]

    def plain(i, active):
        like, w = model.like[:, event[first[i]:ends[i]]].astype(float), n[first[i]:ends[i]].astype(float)
        p = np.array(active, float) / sum(active)
        for _ in range(langid.STEPS):
            r = p[:, None] * like
            p = (r / r.sum(axis=0) * w).sum(axis=1) / w.sum()
        return p, (w * np.log((p[:, None] * like).sum(axis=0))).sum(), w.sum()

    active = np.ones((3, len(texts)), np.float32)
    pi, fitted = model.fit(model.like[:, event], n, first, active)
    lang, share, chosen = model.predict(event, n, first)
    for i, text in enumerate(texts):
        p, ll, total = plain(i, [1, 1, 1])
        assert np.allclose(pi[:, i], p, atol=2e-3) and abs(fitted[i] - ll) < 1e-3 * abs(ll) + 0.1
        cost = langid.PENALTY * np.log(max(total, 2))
        sets = {s: plain(i, s) for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1))}
        best = max(sets, key=lambda s: sets[s][1] - cost * (sum(s) - 1))
        assert set(np.flatnonzero(chosen[i] > 0.005)) == set(np.flatnonzero(sets[best][0] > 0.005))
        assert lang[i] == int(sets[best][0].argmax()) and abs(share[i] - sets[best][0].max()) < 5e-3

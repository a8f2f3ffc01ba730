"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest

from cotopic.llm import spelling
from cotopic.llm.spelling import affected, decompose, merged_lists, near_words, spelling_variants, word_counts


def one_edit(word, letters="abcdé"):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("aabbcdé") for _ in range(rng.randrange(6, 11)))
        words |= {w, *rng.sample(sorted(x for x in one_edit(w) if len(x) >= 6), 2)}
    return {w: rng.choice([5, 6, 30, 31, 200]) for w in sorted(words)}


@pytest.mark.parametrize("max_list, min_list", [(2048, 64), (3, 2), (0, 500)])
def test_near_words_are_all_found(spark, max_list, min_list):
    """Also where nearly every list is long, and whatever the dictionary."""
    n = vocabulary(1)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r.word, r.near) for r in near_words(df, max_list=max_list, min_list=min_list).collect()}
    assert got == {(w, x) for w in n for x in one_edit(w) & n.keys()}


def test_an_edit_leaves_a_merged_list():
    n = vocabulary(2)
    grams = Counter(f"^{w}$"[i:i + q] for w in n for q in (2, 3, 4) for i in range(len(w) + 3 - q))
    frequent = {g: c for g, c in grams.items() if c > 20}
    for w in n:
        lists = merged_lists(decompose(w, frequent), frequent)
        assert len(lists) - affected(lists) >= 1
        for x in one_edit(w):
            there = set(decompose(x, frequent))
            assert any((p + d, g) in there for p, g in lists for d in (-1, 0, 1))


def test_forms_and_roots(spark):
    n = {"wordings": 1000, "wordingz": 100, "wordinzz": 20, "wordizzz": 4, "another": 9, "anothers": 10, "anothery": 10, "lonely": 7,
         "anotherr": 50, "anotherx": 50}
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["wordizzz"] == ("wordinzz", "wordings", 1, 20)
    assert got["wordinzz"] == ("wordingz", "wordings", 2, 100)
    assert got["wordings"] == (None, "wordings", 1, None)
    assert got["another"] == ("anotherr", "anotherr", 4, 50)  # a tie of counts: the first in code-point order
    assert got["anothers"] == ("anotherr", "anotherr", 4, 50)
    assert got["lonely"] == (None, "lonely", 0, None)
    assert set(got) == set(n)
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_word_counts_of_whole_texts(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["Wording", "wording", "ÉTUDES", "études", "naïveté", "short", "x", "CamelCase", "÷×ÀÀÀÀ", "straße", "日本wordings"]
    texts = [" ".join(rng.choice(pool) + rng.choice(["", ".", "_"]) for _ in range(300)) for _ in range(40)]
    texts += [None, "", "wording" * 50_000, "wording " * 60_000, "a" * 2_000_000, texts[0], texts[0]]
    rows = [(None if i % 11 == 5 else i, t, 7) for i, t in enumerate(texts)]
    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.word: r.n for r in word_counts(df, noise=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert spelling.TEXT_PART < 2_000_000  # long texts are read in several parts
    assert word_counts(df.limit(0)).count() == 0

"""Skewed corpus (one keyword in a third of articles, one outlet with a third, one title
copied a third of the time) against a pandas brute force; plans pre-aggregate."""

import random
from collections import defaultdict

import pytest

from cotopic.operators import relation_articles, relation_sources, relations, topic_hits
from cotopic.schema import NEWS


def U(d, rest):
    return f"https://archive.example/noFrame/replay/{d}000000/{rest}"


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1, 1501):
        kw = {"t": rng.randint(3, 9)}
        if i % 3 == 0:
            kw["hot"] = rng.randint(1, 9)
        for _ in range(rng.randint(0, 4)):
            kw[f"k{rng.randint(1, 40)}"] = rng.randint(1, 6)
        source = "big" if i % 3 == 1 else f"s{rng.randint(1, 30)}"
        slug = "same-story" if i % 3 == 2 else f"story-{i}"
        url = U(f"2020{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", f"https://www.o{i % 7}.example/{slug}")
        rows.append((202001 + i % 12, source, url, i, 1.0, kw, rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0, None])))
    return rows, spark.createDataFrame(rows, NEWS)


def brute(rows):
    hits = [r for r in rows if (r[5].get("t") or 0) > 4]
    count, tone, rated, srcs = defaultdict(int), defaultdict(float), defaultdict(int), defaultdict(int)
    for r in hits:
        for k, n in r[5].items():
            count[k] += n
            srcs[(k, r[1])] += 1
            if r[6] is not None:
                tone[k] += r[6] * n
                rated[k] += n
    keep = {k for k, c in count.items() if c >= 5}
    rel = {k: (count[k], tone[k] / rated[k] if rated[k] else None) for k in keep}
    return hits, rel, {ks: v for ks, v in srcs.items() if ks[0] in keep}


def test_relations_and_sources_match_brute_force(skewed):
    rows, news = skewed
    _, want_rel, want_src = brute(rows)
    hits = topic_hits(news, "t")
    got = {r.keyword: (r["count"], r.sentiment) for r in relations(hits).collect()}
    assert set(got) == set(want_rel)
    for k, (c, s) in want_rel.items():
        assert got[k][0] == c and (s is None and got[k][1] is None or got[k][1] == pytest.approx(s))
    src = {(r.keyword, r.source): r.articles for r in relation_sources(hits).collect()}
    assert src == want_src


def test_copied_title_collapses_to_one_row_per_keyword(skewed):
    rows, news = skewed
    arts = relation_articles(topic_hits(news, "t"), include_topic=True).where("title = 'same-story'").collect()
    per_kw = defaultdict(int)
    for a in arts:
        per_kw[a.keyword] += 1
    assert per_kw and all(v == 1 for v in per_kw.values())
    hits, _, _ = brute(rows)
    copies = [r for r in hits if r[2].endswith("/same-story")]
    latest = max(copies, key=lambda r: (r[2].split("/")[5], [-ord(ch) for ch in r[2]]))
    assert {a.archive for a in arts if a.keyword == "t"} == {latest[2]}


def test_hot_keys_are_combined_before_every_shuffle(skewed):
    _, news = skewed
    plan = relations(topic_hits(news, None))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") >= 4  # mentions, both tone sums, articles: all summed before the shuffle

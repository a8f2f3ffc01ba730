"""The other operators against plain versions, exact round trips and the registered SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cotopic.llm import catalogue
from cotopic.llm.hostrules import apply_host_rules
from cotopic.llm.linedup import drop_repeated_lines
from cotopic.llm.mixing import entropy, entropy_exponent, find_exponent, mix, repeats, weights
from cotopic.llm.packing import OpenBins, pack
from cotopic.llm.tokens import token_counts
from cotopic.llm.vafile import search
from pyspark.sql import functions as F
from tests.compare import compare, duck

SF = "/root/testdata/sf0.01"
ODD = [None, "", "   ", "a" * 3000, "aaaa aaa aa a", "it's 'S I'LL 123 45 ½ ²", "<|endoftext|>x <|startoftext|>",
       "日本語 한국어 \u0085x 🙂🙂 \x00\x1f", "two\r\n\tlines  \n\n x", "ΣΟΦΟΣ İ ſ é", "x " * 20_000]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_sql(spark, name):
    problems, _, _ = compare(entry.queries()[name](spark, SF), duck(SF), catalogue.ORACLE[name])
    assert not problems, problems


def test_registered():
    assert {re.match(r"op(\d+)_", k)[1] for k in catalogue.QUERIES} == {str(i) for i in range(1, 14)}
    assert set(catalogue.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_token_counts(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").select("text").limit(150).collect()
    texts = ODD + [r.text for r in docs]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(df).collect()}
    assert [got[i] for i in range(len(texts))] == [(len((t or "").encode()), w) for t, w in zip(texts, want)]
    assert token_counts(df.limit(0)).count() == 0


def test_packing_round_trip(spark):
    texts = ODD + ["word " * n for n in (1, 500, 1022, 1023, 1024, 1025, 2047, 2048, 5000)] + ["again"] * 3
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(3, "again", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = Counter()
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cut = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            left[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = pack(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == left
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= 1024
    assert pack(df.limit(0)).count() == 0


def test_open_bins_are_best_fit():
    r = random.Random(1)
    bins, free, closed = OpenBins(100, 5), {}, set()
    for _ in range(3000):
        size = r.randint(1, 100)
        number, at = bins.put(size)
        if size == 100:  # a sequence by itself: no open bin closes for it
            assert at == 0 and number not in free and number not in closed
            closed.add(number)
            continue
        fits = [f for f in free.values() if f >= size]
        if fits:
            assert free[number] == min(fits) and at == 100 - free[number]
        else:
            assert number not in free and number not in closed and at == 0
            if len(free) == 5:
                low = min(free.values())
                gone = [n for n in free if free[n] == low and n not in [x for b in bins.by_free for x in b]]
                closed.add(gone[0])
                del free[gone[0]]
            free[number] = 100
        free[number] -= size
        if not free[number]:
            closed.add(number)
            del free[number]
        assert len(free) <= 5
    assert bins.next < 1.15 * math.ceil(3000 * 50.5 / 100)


def test_lines(spark):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    r = random.Random(3)
    pool = ["A common line of text", "a common line of text  ", "short", "ééééééééé", "éééééééééé", "\x1cother line kept", "", "Another Line Here"]
    rows = [(i, "\n".join(r.choices(pool + [f"line number {i}"], k=r.randint(0, 6))) if i % 7 else None, 1) for i in range(80)]
    rows += [(5, rows[4][1], 1), (3, "A common line of text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").repartition(5)
    own = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own[key(x)].add(i)
    want = []
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if len(key(x)) < 10 or min(own[key(x)]) == i]
        want.append((i, "\n".join(stay) if t is not None else None, len(parts), len(parts) - len(stay)))
    order = lambda x: tuple(str(v) for v in x)
    got = [(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in drop_repeated_lines(df, batches=7).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert drop_repeated_lines(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "A common line of text"), (1, "A common line of text")], "doc_id long, text string")
    assert {x.text for x in drop_repeated_lines(lone).collect()} == {"A common line of text"}


def test_mixing(spark):
    tokens = [900.0, 100.0, 50.0]
    a = find_exponent(tokens, max_repeats=2.0)
    assert repeats(tokens, weights(tokens, a)) <= 2.0 < repeats(tokens, weights(tokens, a - 1e-5))
    e = find_exponent(tokens, target_entropy=0.9)
    assert entropy(weights(tokens, e)) >= 0.9 > entropy(weights(tokens, e + 1e-5))
    rows = [(i, "w " * (i % 5), "hot" if i % 3 else None if i % 2 else "rare", 9) for i in range(300)] + [(1, "w", "hot", 9), (500, None, "empty", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mix(df).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out if r.copy == 0) == Counter(r[:3] for r in rows)
    per = Counter()
    for r in out:
        per[r.source] += r.n_tokens
    base = Counter()
    for _, t, s, _ in rows:
        base[s] += len((t or "").split())
    rates = [per[s] / base[s] for s in base if base[s]]
    assert min(rates) >= 1 and max(rates) <= 2.05
    cut = mix(df, budget=100).collect()
    assert 95 <= sum(r.n_tokens for r in cut) <= 115
    assert mix(df.limit(0)).count() == 0


def test_mixing_any_number_of_sources(spark):
    n = 100_500  # a source a document, and a hot one
    df = spark.range(n + 5000).selectExpr("id AS doc_id", f"if(id < {n}, concat('host', id), 'hot') AS source", "repeat('w ', int(1 + id % 3)) AS text")
    got = mix(df).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.min("weight").alias("w"), F.countDistinct("doc_id").alias("d"))
    base = df.groupBy("source").agg(F.sum(F.length("text") / 2).alias("t"), F.count("*").alias("c"))
    rows = got.join(base, "source").collect()
    assert len(rows) == n + 1 and all(r.d == r.c for r in rows)
    tokens = [r.t for r in rows]
    exponent, all_ = find_exponent([min(tokens), max(tokens)]), sum(tokens)
    powers = [(t / all_) ** exponent for t in tokens]
    norm = sum(powers)
    ws = [p / norm for p in powers]
    total = max(t / w for t, w in zip(tokens, ws))
    for r, w in zip(rows, ws):
        assert math.isclose(r.w, w, rel_tol=1e-9) and w * total - 1 < r.n < w * total + 4


def test_mixing_entropy_over_a_table(spark):
    tokens = [900, 100, 50, 50, 7]
    df = spark.createDataFrame([(t,) for t in tokens], "_t long")
    top, least = math.log(5), entropy(weights(tokens, 1.0))
    for target in [0.0, least, least + 0.01, 0.9, 1.2, 1.5, top + 1]:
        assert abs(entropy_exponent(df, sum(tokens), target) - find_exponent(tokens, target)) < 1.5e-6
    docs = spark.createDataFrame([(i, "w " * t, f"s{i}") for i, t in enumerate(tokens)], "doc_id long, text string, source string")
    got = {r.source: r.weight for r in mix(docs, target_entropy=1.2).collect()}
    assert [round(got[f"s{i}"], 5) for i in range(5)] == [round(w, 5) for w in weights(tokens, find_exponent(tokens, 1.2))]


def test_host_rules(spark):
    good, junk = " ".join(f"word{i}" for i in range(60)), "spam and eggs " * 40
    rows = [(i, junk, "bad", 1) for i in range(400)] + [(1000, good, "bad", 1), (1001, junk, "tiny", 1), (1002, good, None, 1), (1003, None, None, 1), (1004, "", "ok", 1)]
    rows += [(2000 + i, good, "ok", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in apply_host_rules(df).collect()}
    assert len(got) == len(rows)
    assert not got[1000].base_failed and not got[1000].kept  # its host is rejected
    assert got[1002].kept and got[2000].kept and not got[1003].kept and not got[1004].kept
    assert 0.2 < got[1001].host_rate < 1 and got[1].host_rate > 0.95  # one document shrinks towards the corpus
    assert got[1].n_repeat_words == got[1].n_words == 120 and got[2000].n_repeat_words == 0
    assert apply_host_rules(df.limit(0)).count() == 0
    more = apply_host_rules(df.selectExpr("*", "'x' AS rejected", "2 AS host_rate", "3 AS host", "4 AS documents", "5 AS n_words"))
    assert {(r.doc_id, r.kept, r.rejected) for r in more.collect()} == {(i, r.kept, "x") for i, r in got.items()}


def test_search(spark):
    r = np.random.default_rng(2)
    vecs = {i: [float(x) for x in r.normal(size=8) / 4] for i in range(300)}
    for i in range(100, 160):
        vecs[i] = vecs[100]  # copies: ties go by id
    rows = [(i, v, "x") for i, v in vecs.items()]
    rows += [(900, None, "x"), (901, [1.0] * 7 + [None], "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] * 8, "x"), (None, [9.0] * 8, "x"), (904, [0.5, 0.5], "x"), (905, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(4)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vecs.items()} | {904: [512, 512], 905: []}
    want = []
    for q in whole:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(near)]
    got = search(df, F.col("vec_id") % 20 == 0, query_block=7).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    assert search(df.limit(0), F.lit(True)).count() == 0


def test_pipeline_language_without_labels(spark):
    texts = [None, "", "12 34 !!", "a", "the cat", "1 \u00e9", "\u4f60\u597d", "\U00020000"]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()} == {3, 4, 5, 6, 7}


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), f"t-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    sizes = [len(kept[n]) for n in names]
    assert sizes[0] >= sizes[1] >= sizes[2] and kept["near_copies"] == kept["mixture"] == kept["packed"]
    assert docs.where("length > 1024 or offset + length > 1024").count() == 0

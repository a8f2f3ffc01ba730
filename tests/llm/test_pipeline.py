"""The corpus pipeline against plain versions of its stages, and its edges."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute

LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"term{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def corpus(seed=11, n=160):
    r = random.Random(seed)
    words = {"en": "the cat and dog went over hill with some bread from old town".split(),
             "de": "der hund und die katze laufen über den berg mit brot aus altstadt".split()}
    rows = []
    for i in range(1, n):
        lang = r.choice(["en", "de"])
        text = "\n".join(" ".join(r.choices(words[lang], k=r.randint(3, 30))) for _ in range(r.randint(1, 8)))
        if r.random() < 0.3:
            text += "\nSubscribe to our weekly letter  "
        rows.append((i, text, lang, r.choice(["hot", "hot", "hot", "rare", None])))
    copies = [(1000 + k, x[1] + ("" if k % 2 else "\nshort"), x[2], "hot") for k, x in enumerate(rows[:30])]
    odd = [(2000, None, "en", "hot"), (2001, "", None, "rare"), (2002, "12 34 !!", "en", None), (2003, "\n\n", "de", "hot"),
           (2004, "a long text of cats " * 4000, "en", "rare"), (2005, "One Line Of Its Own", None, "hot")]
    return rows + copies + odd


def by_id(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def test_run_against_plain_stages(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    rows = [r for r, had, lost in brute.lines(rows) if lost < had]
    rows = brute.one_of_each(rows)
    rows = brute.mixed([(i, t, s) for i, t, _, s in rows], corpus_pipeline.MIX_REPEATS)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute.cut_pieces(rows, lambda t: tok.encode(t, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(b[-1]) <= 1024


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stage_edges(spark, stage):
    name, run = stage
    odd = [(None, None, None, None), (1, LONG, "en", "web"), (1, LONG, "en", "web"), (2, "", "de", None), (3, "é " * 50_000, None, "x"), (None, OTHER, "en", "x")]
    docs = frame(spark, odd)
    more = docs.selectExpr("*", "1 AS n_lines", "2 AS copy", "3 AS lang_pred", "4 AS fp", "5 AS rejected", "6 AS length")
    a, b = run(spark, docs, ""), run(spark, more, "")
    assert a.columns == b.columns and (name == "packed" or a.columns == corpus_pipeline.COLUMNS)
    assert by_id(a.collect()) == by_id(b.collect())
    kept = {(r.doc_id, getattr(r, "text", None)) for r in a.collect()}
    assert (1, LONG if name != "packed" else None) in kept  # clean documents stay
    assert run(spark, docs.limit(0), "").count() == 0


def test_near_copies_keeps_one_of_each_class(spark):
    def kept(rows):
        out = corpus_pipeline.near_copies(spark, frame(spark, [(i, t, "en", "web") for i, t in rows]), "")
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert kept([(1, LONG), (2, LONG), (None, OTHER)]) == [(1, LONG), (None, OTHER)]
    assert kept([(1, LONG), (None, LONG), (None, OTHER)]) == [(1, LONG), (None, OTHER)]
    assert kept([(1, LONG), (1, LONG), (1, OTHER)]) == [(1, OTHER), (1, LONG), (1, LONG)]
    assert len(kept([(4, LONG), (4, LONG.upper()), (5, LONG)])) == 1
    assert len(kept([(None, LONG), (None, LONG.upper())])) == 1

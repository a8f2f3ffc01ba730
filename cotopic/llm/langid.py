"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods.

Every document is taken as a mixture of the learned languages. Its character trigrams (letters in lower
case, any other run one blank) have likelihoods under each language; expectation-maximisation estimates
the proportions that explain them best. The set of languages is chosen by penalised likelihood: from all languages
the one of least proportion is dropped and the rest fitted again, down to the best single one, and the
set of highest ``log likelihood - penalty * (languages - 1) * log(trigrams)`` wins. The prediction is its
language of largest proportion.

Trigrams are hashed to ``BUCKETS`` buckets. Buckets whose likelihood ratios agree after rounding by a fixed ``STEP`` are one
event (the mixture likelihood depends on the ratios only), however many events that gives. A document is a sparse histogram
over events, and the documents of a block are fitted together over the events they have. Learning reads a bounded sample of
labelled rows; scoring is one scan without a shuffle. The model, at most ``4 * BUCKETS`` bytes a language and
as much for the events, goes with the tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from cotopic.llm.common import BLOCK_ROWS, crc32_mod, giving_back, per_block, table, text_blocks, written

BUCKETS = 1 << 17
SAMPLE_PER_LANG = 2000  # labelled texts a language is learned from, at most
MAX_LANGS = 256  # languages learned, at most
STEP = 0.5  # log likelihood ratios are rounded to multiples of it
BLOCK_CELLS = 1 << 20  # events of documents times languages that are fitted at once, a document at least
STEPS = 30
PENALTY = 8.0
UNKNOWN = "und"


_LETTERS: list[np.ndarray] = []  # filled on first use; a plain variable, so that tasks need no module of ours


def letter_table() -> np.ndarray:
    """Whether a code point below 65536 is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _LETTERS[0]


def letters(texts: list[str]):
    """Code points of the texts, lower-cased, runs of other characters as one 0 before and after each
    word, and the text each belongs to."""
    texts = [t.lower() for t in texts]
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    is_letter = letter_table()[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF):
        is_letter[i] = chr(cp[i]).isalpha()
    cp = np.where(is_letter, cp, 0).astype(np.uint32)
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the last of a run of others stands for the run
    if len(cp):
        keep[1:] |= is_letter[:-1] & ~is_letter[1:]
    return cp[keep], doc[keep]


def trigrams(texts: list[str]):
    """``bucket, text`` of every trigram with a letter in its middle."""
    cp, doc = letters(texts)
    if len(cp) < 1:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    left = np.where(np.concatenate(([False], doc[1:] == doc[:-1])), np.concatenate(([0], cp[:-1])), 0).astype(np.uint32)
    right = np.where(np.concatenate((doc[1:] == doc[:-1], [False])), np.concatenate((cp[1:], [0])), 0).astype(np.uint32)
    mid = cp > 0
    with np.errstate(over="ignore"):
        h = left[mid] * np.uint32(0x9E3779B1) + cp[mid] * np.uint32(0x85EBCA77) + right[mid] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - 17)).astype(np.int32), doc[mid]


def _count_block(rows, texts):
    langs = sorted({r[0] for r in rows})
    code = {x: i for i, x in enumerate(langs)}
    bucket, doc = trigrams(texts)
    of = np.array([code[r[0]] for r in rows], np.int64)
    n = np.bincount(of[doc] * BUCKETS + bucket, minlength=len(langs) * BUCKETS) if len(bucket) else np.zeros(1, np.int64)
    at = np.flatnonzero(n)
    return {"lang": [langs[i] for i in (at // BUCKETS).tolist()], "bucket": at % BUCKETS, "n": n[at]}


class Mixture:
    """Learned languages: an event for each bucket, and each event's relative likelihood per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: languages x buckets."""
        self.langs = langs
        p = counts + 0.5 * (counts.sum(axis=0) > 0)
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
        seen = p.sum(axis=0) > 0
        ratio = p[:, seen] / p[:, seen].sum(axis=0)
        key = np.round(np.maximum(np.log(ratio), -7) / STEP).astype(np.int8)
        kinds, of = np.unique(key.T, axis=0, return_inverse=True)
        mass = np.zeros((len(langs), len(kinds) + 1))
        for k in range(len(langs)):
            mass[k, 1:] = np.bincount(of.ravel(), weights=p[k, seen], minlength=len(kinds))
        mass[:, 0] = 1.0  # buckets never met say nothing
        self.event = np.zeros(counts.shape[1], np.int32)
        self.event[seen] = of.ravel() + 1
        self.like = (mass / mass.sum(axis=0)).astype(np.float32)

    def histogram(self, texts: list[str]):
        """``event, count, first``: the events of each text in order of the texts, where each text's begin, and its number of trigrams.

        Every text has event 0, and those that say nothing count as 0 there.
        """
        bucket, doc = trigrams(texts)
        k = self.like.shape[1]
        key = np.concatenate((np.arange(len(texts)) * k, doc.astype(np.int64) * k + self.event[bucket]))
        at, n = np.unique(key, return_counts=True)
        text, event = np.divmod(at, k)
        return event, np.where(event == 0, 0, n).astype(np.float32), np.searchsorted(text, np.arange(len(texts))), np.bincount(doc, minlength=len(texts))

    def fit(self, like: np.ndarray, n: np.ndarray, first: np.ndarray, active: np.ndarray, steps: int = STEPS):
        """Proportions over each text's ``active`` languages (languages x texts), and the log likelihood. ``like``: languages x events."""
        sizes = np.diff(np.append(first, len(n)))
        total = np.maximum(np.add.reduceat(n, first, dtype=np.float64), 1e-9)
        pi = (active / np.maximum(active.sum(axis=0), 1)).astype(np.float32)

        def mix():
            return np.maximum(np.einsum("ij,ij->j", np.repeat(pi, sizes, axis=1), like), 1e-30)

        for _ in range(steps):
            pi = (pi * (np.add.reduceat(like * (n / mix()), first, axis=1) / total)).astype(np.float32)
            pi = np.maximum(pi, 1e-12) * active
        return pi, np.add.reduceat(n * np.log(mix()), first, dtype=np.float64)

    def predict(self, event: np.ndarray, n: np.ndarray, first: np.ndarray, penalty: float = PENALTY):
        """``language index, its proportion, proportions of the chosen set`` for each text of a histogram."""
        ends = np.append(first[1:], len(n))
        parts, a = [], 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + BLOCK_CELLS // len(self.langs), "right")))
            of = slice(first[a], ends[b - 1])
            parts.append(self._best(self.like[:, event[of]], n[of], first[a:b] - first[a], penalty))
            a = b
        best = np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)
        lang = best.argmax(axis=1)
        return lang, best[np.arange(len(best)), lang], best

    def _best(self, like: np.ndarray, n: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
        """Proportions of each text's chosen set (texts x languages)."""
        m, size = len(first), len(self.langs)
        rows = np.arange(m)
        single = np.add.reduceat(n * np.log(np.maximum(like, 1e-30)), first, axis=1, dtype=np.float64)
        best = np.zeros((size, m), np.float32)
        best[single.argmax(axis=0), rows] = 1
        score = single.max(axis=0)
        cost = penalty * np.log(np.maximum(np.add.reduceat(n, first, dtype=np.float64), 2))
        active = np.ones((size, m), np.float32)
        for k in range(size, 1, -1):
            pi, fitted = self.fit(like, n, first, active)
            better = fitted - cost * (k - 1) > score
            best[:, better], score[better] = pi[:, better], (fitted - cost * (k - 1))[better]
            active[np.where(active > 0, pi, np.inf).argmin(axis=0), rows] = 0
        return (best / np.maximum(best.sum(axis=0), 1e-9)).T


def _by_lang(docs: DataFrame, tops: dict[str, int]) -> DataFrame:
    return docs.sparkSession.createDataFrame(list(tops.items()), "lang string, top long")


def learn(docs: DataFrame, learn_from=None, text_col: str = "text", lang_col: str = "lang",
          per_lang: int = SAMPLE_PER_LANG) -> Mixture | None:
    """A model from the rows where ``learn_from`` holds and text and language are not null.

    At most ``per_lang`` distinct texts of a language are read, those of least hash; which they are depends on
    their text and not on the layout. The ``MAX_LANGS`` languages of most distinct texts are learned (ties: by name), so at most
    that many counts, and as many tables, go to the driver. None when there is no such row.

    No task sorts a language: its texts are counted first, hashes above a bound that leaves about twice the sample are
    left out, and only the rest is ranked.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    hashes = written(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), "lang-hashes")
    sizes = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not sizes:
        return None
    tops: dict[str, int] = {}
    wide, left = 2, {r.lang: r.n for r in sizes}
    order = Window.partitionBy("lang").orderBy("h")
    while left:  # a language whose bound left too few is tried again with a wider one
        bounds = {x: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * wide * per_lang // n) for x, n in left.items()}
        few = hashes.join(F.broadcast(_by_lang(docs, bounds)), "lang").where(F.col("h") <= F.col("top")).select("lang", "h")
        cut = (few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
               .groupBy("lang").agg(F.max("h").alias("top"), F.count(F.lit(1)).alias("k")).collect())
        tops |= {r.lang: r.top for r in cut if r.k >= min(per_lang, left[r.lang])}
        left = {x: n for x, n in left.items() if x not in tops}
        wide *= 4
    rows = rows.join(F.broadcast(_by_lang(docs, tops)), "lang").where(F.xxhash64("text") <= F.col("top")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    counts = (rows.dropDuplicates().mapInArrow(per_block(_count_block, schema, "lang"), "lang string, bucket long, n long")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(tops)
    code = {x: i for i, x in enumerate(langs)}
    table_ = np.zeros((len(langs), BUCKETS))
    if counts.num_rows:
        at = np.array([code[x] for x in counts.column("lang").to_pylist()])
        table_[at, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return Mixture(langs, table_)


def _guesses(model: Mixture | None, penalty: float):
    """Iterator function from arrays of texts to arrays of ``lang_pred, score, languages``: a few texts at once become Python values."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def rows(texts):
        if model is None:
            return [{"lang_pred": UNKNOWN, "score": 0.0, "languages": []} for _ in texts]
        event, n, first, total = model.histogram(texts)
        lang, share, pi = model.predict(event, n, first, penalty)
        out = []
        for i in range(len(texts)):
            if not total[i]:
                out.append({"lang_pred": UNKNOWN, "score": 0.0, "languages": []})
                continue
            order = [j for j in np.argsort(-pi[i], kind="stable") if pi[i, j] > 0.005]
            out.append({"lang_pred": model.langs[lang[i]], "score": float(min(1.0, share[i])),
                        "languages": [{"lang": model.langs[j], "share": float(pi[i, j])} for j in order]})
        return out

    def guess(columns):
        for column in columns:
            done = [pa.array([], kind)]
            for a in range(0, len(column), BLOCK_ROWS):
                few = column.slice(a, BLOCK_ROWS).to_pylist()
                for _, texts in text_blocks([None] * len(few), few):
                    done.append(pa.array(rows(texts), kind))
            yield pa.concat_arrays(done)
    return guess


def identify(docs: DataFrame, model: Mixture | None, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the proportion of that language) and ``languages``
    (the chosen set with its proportions, largest first).

    Null texts and texts without a letter are ``und`` with score 0 and no languages; so is everything when
    nothing was learned. Columns of ``docs`` with these names are replaced.
    """
    if docs.schema[text_col].dataType.typeName() != "string":
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    docs = docs.drop("lang_pred", "score", "languages")
    kind = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    guess = F.arrow_udf(giving_back(_guesses(model, penalty)), kind, ArrowUDFType.SCALAR_ITER)
    return docs.withColumn("_g", guess(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], "_g.*")


def held_in(doc_id: str = "doc_id"):
    """Rows that may be learned from."""
    return ~F.coalesce(crc32_mod(doc_id, 4) == 2, F.lit(False))


def op10_language(spark, sf_dir) -> DataFrame:
    """Contract query: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, held_in())
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (~held_in()).alias("held_out"), "lang_pred", "score", "languages")

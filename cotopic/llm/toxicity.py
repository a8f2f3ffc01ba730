"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

Kernel: ``K(x, z)`` sums over all sequences of four symbols the products of their weights in ``x`` and ``z``; a sequence
weighs ``DECAY ** span`` at each place where its symbols stand in order within ``SPAN`` characters. So letters may
stand apart: inserted characters lower a match and do not undo it. Words spelled out letter by letter
are closed up first. Letters are folded to their base form; what is no
letter is one symbol, so that a word's ends count.

Model: landmarks ``z`` are words of the labelled sentences; a window ``x`` of ``WINDOW`` characters of a sentence
has the Nystroem features ``K(z, z')^-1/2 K(z, x)``, and a squared-hinge support vector machine is trained on
them. Labels belong to documents, insults to a few words of a sentence: a toxic document counts by the window of its
sentences that scores highest, clean ones by theirs (multiple-instance training, repeated until windows settle).

Scoring: the decision ``sum_m a_m K(z_m, x)`` is linear in the weights of ``x``'s sequences, so it is kept as one
table over (hashed) sequences - the same number, without a pass per landmark - and a text is scored by one sweep
over its characters, all sentences, in a scan without a shuffle. A document's score is the
calibrated decision of its highest window, seen against its other windows and its length. Learning reads a bounded sample of labelled rows.
"""

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import crc32_mod, table, text_blocks

SLOTS = 1 << 17  # a sequence's place in a table, by hash
# Symbols - 0: beyond the text; 1-26: a-z; 27-30: other letters, hashed; 31: no letter.
OTHER = 31
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x165667B1)
SPAN = 6
DECAY = 0.75
WINDOW = 12
LANDMARKS = 384
MAX_TOXIC, MAX_CLEAN = 1500, 3000  # labelled rows learned from, at most
ROUNDS = 4
GAPS = [(a, b, c) for a in range(3, SPAN) for b in range(2, a) for c in range(1, b)]  # distances of a sequence's symbols from its last


_KINDS: list[np.ndarray] = []  # filled on first use; a plain variable, so that tasks need no module of ours


def kinds_table() -> np.ndarray:
    if _KINDS:
        return _KINDS[0]
    out = np.full(1 << 16, OTHER, np.uint8)
    out[0] = 0
    for i in range(1 << 16):
        ch = chr(i)
        if ch.isalpha():
            base = unicodedata.normalize("NFD", ch.lower())[0]
            base = {"ß": "s", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ı": "i"}.get(base, base)
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + i % 4
    _KINDS.append(out)
    return out


def coded(texts: list[str]):
    """Letter kinds of the texts, each followed by ``WINDOW`` blanks, and the texts' starts."""
    cp = np.frombuffer("".join(" " + t.replace("\0", " ") + " " + "\0" * WINDOW for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds_table()[np.minimum(cp, 0xFFFF)]
    size = np.array([len(t) + 2 + WINDOW for t in texts], np.int64)
    letter = (kind > 0) & (kind < OTHER)
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    drop = np.zeros(len(kind), bool)
    if len(kind) > 2:
        drop[1:-1] = ~letter[1:-1] & alone[:-2] & alone[2:]  # "i d i o t", "i.d.i.o.t"
    if drop.any():
        before = np.concatenate(([0], np.cumsum(drop)))
        ends = np.cumsum(size)
        size = size - (before[ends] - before[ends - size])
        kind = kind[~drop]
    return kind, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)


def slot(first, second, third, last):
    """A sequence's slot, from the products of its symbols with ``_ODD``."""
    with np.errstate(over="ignore"):
        h = first + second + third + last
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - 17)).astype(np.int64)


def products(kind: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(kind.astype(np.uint32) + np.uint32(1)) * np.uint32(m) for m in _ODD]


def sequences(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """For each choice of gaps: its first end position, the slots of the sequences that end from there on, and their weight."""
    p = products(kind)
    n = len(kind)
    for a, b, c in GAPS:
        if n > a:
            yield a, slot(p[0][:n - a], p[1][a - b:n - b], p[2][a - c:n - c], p[3][a:]), DECAY ** (a + 1)


def phi(text: str) -> np.ndarray:
    """The sequence weights of a word between blanks."""
    kind = coded([text])[0][:-WINDOW]
    out = np.zeros(SLOTS)
    for _, t, w in sequences(kind):
        np.add.at(out, t, w)
    return out


def window_scores(kind: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every character the decision of the ``WINDOW`` characters that end there (without bias)."""
    at = np.zeros(len(kind), np.float32)
    for a, t, w in sequences(kind):
        at[a:] += np.float32(w) * weights[t]
    total = np.concatenate((np.zeros(WINDOW), np.cumsum(at, dtype=np.float64)))
    return total[WINDOW:] - total[:-WINDOW]


def highest(texts: list[str], weights: np.ndarray):
    """Each text's highest window decision and the window itself, as letter kinds."""
    kind, start = coded(texts)
    score = window_scores(kind, weights)
    best = np.maximum.reduceat(score, start)
    at = np.array([s + int(np.argmax(score[s:e])) for s, e in zip(start, np.append(start[1:], len(score)))], np.int64)
    pad = np.concatenate((np.zeros(WINDOW + SPAN, np.uint8), kind))
    return best, pad[at[:, None] + np.arange(1, WINDOW + SPAN + 1)[None, :]]


def window_features(windows: np.ndarray, column: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Kernel of each window (rows of symbols) with each basis row; ``column`` has a slot's column there, 0: none."""
    out = np.zeros((len(windows), len(basis)))
    p = products(windows)
    n = windows.shape[1]
    for a, b, c in GAPS:
        t = column[slot(p[0][:, :n - a], p[1][:, a - b:n - b], p[2][:, a - c:n - c], p[3][:, a:])]
        for m in range(len(basis)):
            out[:, m] += DECAY ** (a + 1) * basis[m][t].sum(axis=1)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 30):
    """Squared-hinge support vector machine in the primal, by Newton steps; the last column of ``x`` is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        c = cost * weight[on]
        grad = ridge @ w - x[on].T @ (c * 2 * margin[on] * y[on])
        step = np.linalg.solve(ridge + 2 * (x[on] * c[:, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def evidence(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """What a text is judged by: its highest window's decision, the mean and spread of all its windows' decisions - what is
    high in one language is common in another - and the logarithm of its length, by which a highest value grows."""
    kind, start = coded(texts)
    score = window_scores(kind, weights)
    size = np.diff(np.append(start, len(score)))
    mean = np.add.reduceat(score, start) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(score * score, start) / size - mean ** 2, 0))
    return np.column_stack((np.maximum.reduceat(score, start), mean, spread, np.log(size)))


class Toxicity:
    """Weights over sequences, and the calibration of a document's evidence."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, shift: float):
        self.weights, self.scale, self.shift = weights.astype(np.float32), scale, shift

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(texts, self.weights) @ self.scale + self.shift, -40, 40)))


def gapped(windows: np.ndarray) -> np.ndarray:
    """Each window once more, with a character inserted between two letters (the place goes by the row)."""
    out = windows.copy()
    for i, row in enumerate(out):
        letter = (row > 0) & (row < OTHER)
        at = np.flatnonzero(letter[1:] & letter[:-1]) + 1
        if len(at):
            k = at[len(at) // 3 + i % max(1, len(at) // 3)]
            row[:k - 1] = row[1:k].copy()
            row[k - 1] = OTHER if i % 2 else 1 + i % 26
    return out


def words_of(text: str) -> set[str]:
    """Distinct words of the sentences, in lower case."""
    return set("".join(c if c.isalpha() else " " for c in text.lower()).split())


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50):
    """Slopes and shift of a logistic curve through the labels of the sample."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - (y > 0)) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Toxicity:
    """Learn from texts of both labels. Without either label nothing can be told: every score is the base rate's."""
    if not toxic or not clean:
        return Toxicity(np.zeros(SLOTS), np.zeros(4), 40.0 if toxic else -40.0)
    in_toxic = Counter(w for t in toxic for w in words_of(t) if 3 <= len(w) <= 2 * WINDOW)
    in_clean = Counter(w for t in clean for w in words_of(t))
    n1, n0 = len(toxic), len(clean)

    def odds(w):  # how much likelier the word is in a toxic document
        return np.log((in_toxic[w] + 0.5) / (n1 + 1)) - np.log((in_clean[w] + 0.5) / (n0 + 1))
    marked = sorted(in_toxic, key=lambda w: (-in_toxic[w] * max(0.0, odds(w)), w))[:landmarks // 2]
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3]
    step = max(1, len(common[:4000]) // (landmarks - len(marked)))
    marks = list(dict.fromkeys(marked + common[:4000:step]))[:landmarks]
    basis = [phi(w) for w in marks]  # never zero: a word has three letters and blanks around it
    slots = np.unique(np.concatenate([np.flatnonzero(x) for x in basis]))  # what the landmarks have
    column = np.zeros(SLOTS, np.int32)
    column[slots] = np.arange(1, len(slots) + 1)
    basis = np.array([np.concatenate(([0], x[slots])) for x in basis])
    basis /= np.sqrt((basis ** 2).sum(axis=1, keepdims=True))
    value, vector = np.linalg.eigh(basis @ basis.T)
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])

    def spread(x):  # columns back to slots
        return x[column].astype(np.float32)

    # the first windows: around the likeliest word of a toxic document; in clean ones anywhere
    weights = spread(sum(max(0.0, odds(w)) * row for w, row in zip(marks, basis) if w in in_toxic))
    negative, shown = None, set()
    for _ in range(rounds):
        _, pos = highest_blocks(toxic, weights)
        _, neg = highest_blocks(clean, weights)
        negative = neg if negative is None else np.unique(np.concatenate((negative, neg)), axis=0)
        both = np.concatenate((pos, gapped(pos)))
        x = np.concatenate((both, negative))
        y = np.concatenate((np.ones(len(both)), -np.ones(len(negative))))
        f = window_features(x, column, basis) @ root
        f = np.column_stack((f, np.ones(len(f))))
        v = train_svm(f, y, np.where(y > 0, 1 / len(both), 1 / len(negative)) * 100)
        weights = spread((root @ v[:-1]) @ basis)
        key = pos.tobytes()
        if key in shown:
            break
        shown.add(key)
    seen = np.concatenate([evidence(t, weights) for _, t in text_blocks(toxic + clean, toxic + clean, 1 << 20)])
    scale, shift = calibrate(seen, np.concatenate((np.ones(n1), -np.ones(n0))))
    return Toxicity(weights, scale, shift)


def highest_blocks(texts: list[str], weights: np.ndarray):
    parts = [highest(b, weights) for _, b in text_blocks(texts, texts, 1 << 20)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def learn(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Toxicity:
    """A model from the labelled rows where ``learn_from`` (over ``doc_id``) holds.

    Of each label the ``max_toxic`` or ``max_clean`` rows of least id hash are read, whole texts; null labels and null ids are
    left out. This bounded sample is all that reaches the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    h = F.xxhash64("doc_id")
    some = [known.where(F.col("y") == y).orderBy(h, "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    known = some[0].unionByName(some[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = (texts.join(F.broadcast(known), "doc_id")  # at most max_toxic + max_clean rows
                 .select("y", F.coalesce("text", F.lit("")).alias("text")).toArrow())
    both = sorted(zip(rows.column("y").to_pylist(), rows.column("text").to_pylist()))
    return fit([t for y, t in both if y == 1], [t for y, t in both if y == 0])


def score(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); null and empty texts are scored as
    a text without letters. Columns of ``docs`` with these names are replaced."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            parts = [model.score(t) for _, t in text_blocks([None] * len(text), text.tolist(), 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    docs = docs.drop("score", "predicted")
    udf = F.pandas_udf(run, "double")
    return docs.withColumn("score", udf(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_in(doc_id: str = "doc_id"):
    """Rows whose labels may be learned."""
    return ~F.coalesce(crc32_mod(doc_id, 5) == 0, F.lit(False))


def op1_toxicity(spark, sf_dir) -> DataFrame:
    """Contract query: a toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), held_in())
    return score(docs, model).select("doc_id", (~held_in()).alias("held_out"), "score", "predicted")

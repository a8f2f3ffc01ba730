"""Token counts by rank-synchronous array merging.

Texts are normalised and cut into pre-tokens as the vocabulary's library does. The distinct pre-tokens of a block,
as rows of initial symbols, lie one after the other in one ragged array. In each round every pair of
neighbouring symbols gets its merge rank, every pre-token finds its lowest one, and all places of
that pair in it are merged at once; pre-tokens without a mergeable pair are finished and leave the array. What
remains of a pre-token, in symbols, is its number of tokens. A document's count is the sum over its pre-tokens.

Counting is one scan without a shuffle. Finished pre-tokens are remembered within a task, up to a fixed
number, so memory does not grow with the corpus's vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import giving_back, per_block, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
REMEMBERED = 150_000  # pre-tokens whose count a task keeps

# The byte alphabet of byte-level vocabularies - printable bytes stand for themselves, the others for 256, 257, ...
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    printed = set(_PRINTED)
    return [chr(b) if b in printed else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts the symbols that are left of pre-tokens, for the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(self.ids.values()) + 1
        left = np.array([self.ids[a] for a, _ in merges], np.int64)
        right = np.array([self.ids[b] for _, b in merges], np.int64)
        made = np.array([self.ids[(a[:-len(self.end)] if self.end and a.endswith(self.end) else a) + b] for a, b in merges], np.int64)
        key = left * self.size + right
        key, first = np.unique(key, return_index=True)  # a pair listed twice has its first rank
        self.key, self.rank, self.made = key, first.astype(np.int32), made[first]
        self.result = np.zeros(len(merges), np.int64)
        self.result[self.rank] = self.made
        bits = 1 << 20  # a table that most absent pairs miss at once
        self.maybe = np.zeros(bits, bool)
        self.maybe[self._slot(key)] = True
        letters = byte_letters()
        self.inner = np.array([self.ids.get(c, -1) for c in letters], np.int64)
        self.last = np.array([self.ids.get(c + self.end, -1) for c in letters], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])}
        self.lower, self.nfc, self.blank = "Lowercase" in kinds, "NFC" in kinds, "Replace" in kinds
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pattern = next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split")
        self.known: dict[str, int] = {}

    @staticmethod
    def _slot(key):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; pairs without one get the largest number."""
        key = left * self.size + right
        out = np.full(len(key), np.iinfo(np.int32).max, np.int32)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.maybe[self._slot(key)])
        if len(at):
            k = key[at]
            i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[i] == k
            out[at[hit]] = self.rank[i[hit]]
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[flat]
        stop = np.cumsum(size)
        some = size > 0
        sym[stop[some] - 1] = self.last[flat[stop[some] - 1]]
        seq = np.repeat(np.arange(len(words)), size)
        left_of = np.zeros(len(words), np.int64)
        none = np.iinfo(np.int32).max
        rank = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), none) if len(sym) > 1 else np.empty(0, np.int32)
        while len(sym):
            # rank[i] is that of symbols i and i + 1; each sequence's lowest one
            rank = np.append(rank[:len(sym) - 1], none).astype(np.int32)
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            length = np.diff(np.append(start, len(seq)))
            low = np.minimum.reduceat(rank, start)
            done = low == none
            if done.any():
                left_of[seq[start[done]]] = length[done]
                stay = np.repeat(~done, length)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                if not len(sym):
                    break
                length, low = length[~done], low[~done]
            hit = rank == np.repeat(low, length)
            # of places that overlap (as in a a a) every second goes, from the left
            again = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(again):
                at = np.flatnonzero(hit)
                head = np.concatenate(([True], at[1:] != at[:-1] + 1))
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                hit[at[nth % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.result[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(sym), bool)  # pairs to be ranked again: the merged symbol's, both sides
            fresh[at] = True
            before = at - 1
            prev = np.where(before >= 0, np.where(keep[np.maximum(before, 0)], before, before - 1), -1)
            fresh[prev[prev >= 0]] = True
            sym, seq, rank, fresh = sym[keep], seq[keep], rank[keep], fresh[keep]
            f = np.flatnonzero(fresh[:-1])
            same = seq[f] == seq[f + 1]
            rank[f] = none
            f = f[same]
            rank[f] = self.ranks(sym[f], sym[f + 1])
        return left_of

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, added special tokens left out."""
        import regex

        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # character by character: no final form
        return regex.findall(self.pattern, text)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        found: list[list[str]] = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                parts = re.split("|".join(map(re.escape, self.special)), t)
                total[i] += len(parts) - 1
                found.append([w for p in parts for w in self.split(p)])
            else:
                found.append(self.split(t))
        known = self.known
        new = list({w for words in found for w in words if w not in known})
        for a in range(0, len(new), 1 << 16):
            part = new[a:a + (1 << 16)]
            known.update(zip(part, self.count(part).tolist()))
        get = known.__getitem__
        for i, words in enumerate(found):
            total[i] += sum(map(get, words))
        if len(known) > REMEMBERED:
            known.clear()
        return total


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``.

    ``path``: a byte-level BPE vocabulary file with a split pattern, present on every executor (default: the public
    49k word vocabulary). Null texts are empty and have no tokens; repeated rows are counted each.
    """
    schema = pa.schema([("id", docs.schema[id_col].dataType.typeName() == "long" and pa.int64() or pa.string()),
                        ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    kind = "long" if schema.field("id").type == pa.int64() else "string"

    def run(batches):
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(VOCABULARY)
        merger = Merger(place)

        def block(ids, texts):
            return {"id": [i for i, in ids], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": merger.counts(texts)}
        yield from per_block(block, schema, "id")(batches)

    slim = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(giving_back(run), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_bytes", "n_tokens")


def op6_token_counts(spark, sf_dir) -> DataFrame:
    """Contract query: bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)

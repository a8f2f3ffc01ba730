"""Bounded-space online best-fit packing of tokenised documents.

Documents are tokenised whole, each ending with ``END_ID``; one longer than ``CAPACITY`` is cut into pieces of
``CAPACITY``, the first of which may be shorter. A full piece is a sequence by itself. The others are dealt to packers, which
take them as they come: a fixed number of bins is open, kept by free space with a bitset that tells which
amounts occur. A piece goes into the open bin of least sufficient space; if none has room a new bin is opened,
and when too many are open the fullest closes first.

Token ids never leave the scan: each piece carries its checksum, and a few numbers are shuffled to the packers.
Each packer gets about ``PACKER_PIECES`` pieces, in an order fixed by hash, so a repeated task packs the same.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotopic.llm.common import give_back, giving_back, per_block, table
from cotopic.llm.tokens import byte_letters

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1024
PACKER_PIECES = 250_000
REMEMBERED = 150_000  # words whose ids a task keeps, in each of two generations
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MARK = "\ud800"  # stands between texts: half a character, which no text holds
OTHER, LETTER, NUMBER, BLANK, SPACE, BETWEEN = range(6)  # kinds of characters; BLANK is the space, SPACE any other white space


@cache
def kinds(size: int) -> np.ndarray:
    """The kind of each of the first ``size`` characters."""
    import regex

    out = np.full(size, OTHER, np.uint8)
    every = "".join(map(chr, range(size)))
    for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(runs, every):
            out[m.start():m.end()] = kind
    out[ord(" ")], out[ord(MARK)] = BLANK, BETWEEN
    return out


def _begins() -> np.ndarray:
    """Whether a word begins at a character, by ``8 * kind before + kind``; white space after white space: not by these alone."""
    out = np.zeros(64, bool)
    for before in range(6):
        for kind in range(6):
            out[8 * before + kind] = BETWEEN in (before, kind) or kind != before and before != BLANK
    for before in (BLANK, SPACE):
        out[[8 * before + BLANK, 8 * before + SPACE]] = False
    return out


BEGINS = _begins()


def word_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of ``WORDS`` begin in texts that lie one after the other, a ``MARK`` before and after each."""
    starts = np.ones(len(codes), bool)
    pair = kind[:-1] << 3
    pair |= kind[1:]
    np.take(BEGINS, pair, out=starts[1:])
    # the last of several white-space characters goes with, or stands alone before, what is not white space
    space = (kind == BLANK) | (kind == SPACE)
    at = np.flatnonzero(space[1:] & space[:-1]) + 1
    starts[at[kind[at + 1] <= NUMBER]] = True
    # contractions: an apostrophe that begins a word takes one or two letters
    at = np.flatnonzero(codes == ord("'"))
    at = at[starts[at]]
    first, second = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (first == ord(a)) & (second == ord(b))
    starts[at[one | two] + 1] = False
    starts[at[one] + 2] = True
    starts[at[two] + 3] = True
    return np.flatnonzero(starts)


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words of texts, and the number of every word in that list, from 1; 0 is the mark before and after each text."""
    joined = MARK + "".join([t + MARK for t in texts])
    data = joined.encode("utf-16-le", "surrogatepass")
    if len(data) == 2 * len(joined):
        codes = np.frombuffer(data, "<u2")
        kind = kinds(1 << 16)[codes]
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = kinds(0x110000)[codes]
    starts = word_starts(codes, kind)
    data = joined.encode("utf-8", "surrogatepass")
    wide = np.flatnonzero(codes >= 0x80)  # characters of more than one byte
    more = np.cumsum(1 + (codes[wide] >= 0x800) + (codes[wide] >= 0x10000))
    ends = np.append(starts, len(codes))
    ends += np.append(0, more)[np.searchsorted(wide, ends)]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    return found.dictionary[1:].to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


class Words(dict):
    """Token ids of words as little-endian 32-bit bytes; a word not met before is looked up in ``old``, then encoded."""

    def __init__(self, encode: Callable[[str], bytes], old: dict[str, bytes]):
        self.encode, self.old = encode, old

    def __missing__(self, word: str) -> bytes:
        self[word] = data = self.old.get(word) or self.encode(word)
        return data


class Ids:
    """Token ids of texts as little-endian 32-bit bytes; the library encodes each distinct word once, and texts look it up once a block.

    A word goes to the library's model itself where nothing but the byte letters stands before it, else through the whole
    tokenizer. Words are kept in two generations: one met again moves to the younger, and the older goes when that is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        first = self.tokenizer.pre_tokenizer
        bare = self.tokenizer.normalizer is None and isinstance(first, pre_tokenizers.ByteLevel) and not first.add_prefix_space
        self.known = Words(self._by_model() if bare else self._whole, {})

    def _by_model(self) -> Callable[[str], bytes]:
        from codecs import charmap_decode

        letters, tokens = "".join(byte_letters()), self.tokenizer.model.tokenize
        blank = letters[32]
        packs = [struct.Struct(f"<{n}I").pack for n in range(64)]

        def encode(word):
            if word.isascii() and word.isprintable():  # all but the blank stand for themselves
                found = tokens(word.replace(" ", blank))
            else:
                found = tokens(charmap_decode(word.encode(), "strict", letters)[0])
            ids = [t.id for t in found]
            return packs[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
        return encode

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.old = {}
            self.known = Words(self.known.encode, self.known)
        special = [any(s in t for s in self.special) for t in texts]  # those strings are the tokenizer's to find
        words, number = distinct_words(["" if odd else t for t, odd in zip(texts, special)])
        data = [b"", *map(self.known.__getitem__, words)]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        first = np.cumsum(size) - size
        length = size[number]
        stop = np.cumsum(length)
        place = np.repeat(first[number] - stop + length, length)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(data), "<u4")[place].tobytes()
        ends = (4 * stop[number == 0]).tolist()
        return [self._whole(t) if odd else ids[a:b] for t, odd, (a, b) in zip(texts, special, pairwise(ends))]


_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str | None, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the tokenised documents; ``row`` tells rows of one id apart."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(VOCABULARY)
        ids_of = Ids(place)
        give_back()  # reading a vocabulary takes several times what it is
        gc.disable()  # millions of short-lived strings and no cycles; ``giving_back`` collects at the end

        def block(keys, texts):
            out = {n: [] for n in _PIECES.names}
            for (doc_id, row), data in zip(keys, ids_of.of(texts)):
                data += end
                n = len(data) // 4
                first = n % capacity or capacity
                at, piece = 0, 0
                while at < n:
                    size = first if at == 0 else capacity
                    for name, v in zip(_PIECES.names, (row, doc_id, piece, at, size, zlib.crc32(data[4 * at:4 * (at + size)]))):
                        out[name].append(v)
                    at += size
                    piece += 1
            return out
        yield from per_block(block, _PIECES, "doc_id", "row")(batches)

    slim = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return slim.mapInArrow(giving_back(run), "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by free space. ``mask`` has bit ``f`` set when a bin of free space ``f`` is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """``bin, offset`` for a piece of ``size``."""
        if size == self.capacity:  # a sequence by itself
            number = self.next
            self.next += 1
            return number, 0
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1  # the least sufficient free space
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.next
            self.next += 1
        rest = free - size
        if rest:
            self.by_free[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def _packer(capacity: int, open_bins: int):
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            if not batch.num_rows:
                continue
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            cols = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    Null and empty texts are one piece that holds the end token alone. Repeated rows are packed each; an empty table gives
    no rows. ``path``: vocabulary file, present on every executor. The last bins of each packer stay partly empty.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packers = max(1, -(-docs.count() // packer_pieces))
    found = pieces(slim, path, capacity, end_id)
    order = F.xxhash64("doc_id", "row", "piece")
    dealt = found.repartition(packers, order).sortWithinPartitions(order, "doc_id", "row", "piece")
    return dealt.mapInArrow(giving_back(_packer(capacity, open_bins)), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                                          "sequence_id long, offset long")


def op9_packing(spark, sf_dir) -> DataFrame:
    """Contract query: the place of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))

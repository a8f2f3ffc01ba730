"""Words are cut by arrays exactly as the vocabulary's pattern cuts them, and a block asks for each distinct word once."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from cotopic.llm import packing
from cotopic.llm.packing import VOCABULARY, WORDS, Ids, Words

CHARS = "aZé  \n\t'''strvelmdST1９²½.,!#\x1c\x1d\x85 　漢и́_-​\x00ǅª"


def words_of(texts):
    words, number = packing.distinct_words(texts)
    assert len(words) == len(set(words))
    at = np.flatnonzero(number == 0)
    assert len(at) == len(texts) + 1 and at[0] == 0 and at[-1] == len(number) - 1
    return [[words[i - 1] for i in number[a + 1:b]] for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("more", ["", "😀𝟗𐐀"])
def test_words_are_those_of_the_pattern(more):
    r = random.Random(7)
    cut = regex.compile(WORDS).findall
    assert words_of([]) == []
    for _ in range(1500):
        texts = ["".join(r.choices(CHARS + more, k=r.choice([0, 1, 2, 3, 8, 40]))) for _ in range(r.randint(0, 6))]
        assert words_of(texts) == [cut(t) for t in texts]


def test_every_character_is_of_its_kind():
    cut = regex.compile(WORDS).findall
    texts = [f"a{c}{c}' {c}" for c in map(chr, range(0x110000)) if not 0xd800 <= ord(c) < 0xe000]
    for a in range(0, len(texts), 1 << 16):
        assert words_of(texts[a:a + (1 << 16)]) == [cut(t) for t in texts[a:a + (1 << 16)]]


def test_a_block_asks_for_each_distinct_word_once():
    path = public_tokenizers.path(VOCABULARY)
    ids, asked = Ids(path), []

    class Asked(Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    ids.known = Asked(ids.known.encode, {})
    texts = ["again and again" * 300, "", " and again" * 200]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.of(texts) == want
    assert len(asked) == len(set(asked)) < 6

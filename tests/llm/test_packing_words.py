"""Words go to the vocabulary's model itself, once each, and give the library's ids."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cotopic.llm import packing
from cotopic.llm.packing import VOCABULARY, Ids

TEXTS = ["", " ", "A word, a word; don't  12 345\n\n\tx ", "é ñandú Größe ß", "漢字 и слова ², ³\x1c\x7f\x00", "tail <|endoftext|> end", "long" * 300,
         " ".join(f"w{i}" for i in range(500)), "😀 👍🏽 ́e"]


def test_each_word_is_encoded_once_by_the_model(monkeypatch):
    path = public_tokenizers.path(VOCABULARY)
    ids = Ids(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    met, encode = [], ids.known.encode
    ids.known.encode = lambda w: (met.append(w), encode(w))[1]
    whole, asked = ids._whole, []
    ids._whole = lambda t: (asked.append(t), whole(t))[1]
    assert ids.of(TEXTS) == want
    assert len(met) == len(set(met)) > 500 and asked == [t for t in TEXTS if "<|endoftext|>" in t]
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    n = len(met)
    assert ids.of(TEXTS) == want and len(met) == n  # from the older generation
    assert len(ids.known.old) == n


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_vocabularies_go_through_the_whole_tokenizer(tmp_path, change):
    spec = json.load(open(public_tokenizers.path(VOCABULARY))) | change
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    ids = Ids(str(path))
    tok = Tokenizer.from_file(str(path))
    words = ["Word", " Next", "  ", "12"]
    assert [ids.known[w] for w in words] == [np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
